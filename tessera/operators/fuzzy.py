"""Fuzzy simplicial set: from neighbour distances to a symmetric weighted graph.

Bandwidths are found for each vector by bisection inside one projection (no shuffle beyond the
grouping of its neighbours, no Python); the union of both edge directions is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DOUBLE = 1.7976931348623157e308
TOLERANCE = 1e-5


def _rho(d: Column, local_connectivity: float) -> Column:
    """Distance at which connectivity is certain, interpolated between neighbours."""
    if local_connectivity <= 0:
        return F.lit(0.0)
    at = int(max(local_connectivity - 1, 0))
    part = local_connectivity - 1 - at if local_connectivity > 1 else 0.0
    low = F.get(d, F.lit(at))
    if part:
        low = low + part * (F.coalesce(F.get(d, F.lit(at + 1)), low) - low)
    return F.coalesce(low, F.element_at(d, -1), F.lit(0.0))


def smooth_knn_dist(knn: DataFrame, k: int, local_connectivity: float = 1.0, n_iter: int = 64) -> DataFrame:
    """(src, sigma, rho) of each vector of (src, rank, dst, dist).

    sigma solves sum(exp(-max(d - rho, 0) / sigma)) = log2(k) by at most ``n_iter`` bisections,
    without a lower bound for sigma: if too many neighbours lie at rho it falls to 2**-n_iter.
    """
    lists = knn.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dist"))), lambda x: x["dist"]).alias("d"))
    lists = lists.withColumn("rho", _rho(F.col("d"), local_connectivity))
    lists = lists.withColumn("over", F.transform("d", lambda x: F.greatest(x - F.col("rho"), F.lit(0.0))))
    target = F.log2(F.lit(float(k)))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(MAX_DOUBLE).alias("hi"), F.lit(1.0).alias("mid"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        value = F.aggregate("over", F.lit(0.0), lambda a, x: a + F.exp(-x / s["mid"]))
        done = s["done"] | (F.abs(value - target) < TOLERANCE)
        above = value > target
        lo, hi = F.when(above, s["lo"]).otherwise(s["mid"]), F.when(above, s["mid"]).otherwise(s["hi"])
        mid = F.when(above, (s["lo"] + s["mid"]) / 2).when(s["hi"] == MAX_DOUBLE, s["mid"] * 2).otherwise((s["mid"] + s["hi"]) / 2)
        # the sum is costly, so the step is one struct that a done row passes through
        return F.when(s["done"], s).otherwise(
            F.transform(F.array(F.struct(done.alias("done"), lo.alias("lo"), hi.alias("hi"), mid.alias("mid"))), lambda r: F.struct(F.when(r["done"], s["lo"]).otherwise(r["lo"]).alias("lo"), F.when(r["done"], s["hi"]).otherwise(r["hi"]).alias("hi"), F.when(r["done"], s["mid"]).otherwise(r["mid"]).alias("mid"), r["done"].alias("done")))[0]
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(n_iter)), start, step)
    return lists.select("src", found["mid"].alias("sigma"), "rho")


def directed_edges(knn: DataFrame, bandwidths: DataFrame) -> DataFrame:
    """(src, dst, w) with w = exp(-max(dist - rho, 0) / sigma); loops are skipped."""
    over = F.greatest(F.col("dist") - F.col("rho"), F.lit(0.0))
    w = F.when(F.col("sigma") > 0, F.exp(-over / F.col("sigma"))).when(over > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return knn.where("src <> dst").join(bandwidths, "src").select("src", "dst", w.alias("w"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Probabilistic union a + b - ab of both directions; edges without weight are dropped.

    A directed edge that is given twice counts with its largest weight.
    """
    both = edges.select("src", "dst", F.col("w").alias("a"), F.lit(None).cast("double").alias("b")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(None).cast("double").alias("a"), F.col("w").alias("b")))
    a, b = F.coalesce(F.max("a"), F.lit(0.0)), F.coalesce(F.max("b"), F.lit(0.0))
    return both.groupBy("src", "dst").agg((a + b - a * b).alias("w")).where("w > 0")


def adjacency_list(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, adj) with the neighbours sorted; isolated nodes of ``nodes`` (id) get an empty list."""
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("adj"))
    if nodes is None:
        return lists
    empty = F.array().cast("array<struct<dst:bigint,w:double>>")
    return nodes.select("id").join(lists, "id", "left").select("id", F.coalesce("adj", empty).alias("adj"))


def fuzzy_simplicial_set(knn: DataFrame, effective_k: int, symmetric: bool = True, local_connectivity: float = 1.0) -> DataFrame:
    """(src, dst, w) of the fuzzy graph of a neighbour table; no neighbours, no edges."""
    edges = directed_edges(knn, smooth_knn_dist(knn, effective_k, local_connectivity))
    return symmetrise(edges) if symmetric else edges
