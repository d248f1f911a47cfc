"""Label propagation and the layout it starts from.

Rounds are synchronous: every node reads the labels of the round before, so a round is a join
and two aggregations and its result doesn't depend on partitions. Lineage is cut after each
round in the shared checkpoint folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import sparse
from tessera.operators.onetask import in_one_task
from tessera.params import EmbeddingParams
from tessera.runtime import cut

MAX_HOPS = 64
#: Layouts of at most this many rows are found by one task.
ONE_TASK_ROWS = 1 << 14


def label_prop_iteration(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) after one round over edges (src, dst, w).

    Labelled nodes keep theirs. A node labelled -1 adopts the label with the largest summed
    weight among its neighbours if that is at least 1; ties go to the label whose first
    neighbour comes last.
    """
    votes = edges.join(labels.where("label >= 0").select(F.col("id").alias("dst"), F.col("label").alias("vote")), "dst")
    open_ = labels.where("label < 0").select(F.col("id").alias("src"))
    sums = votes.join(open_, "src", "left_semi").groupBy("src", "vote").agg(F.sum("w").alias("w"), F.min("dst").alias("first")).where("w >= 1")
    best = sums.groupBy(F.col("src").alias("id")).agg(F.max_by("vote", F.struct("w", "first")).alias("vote"))
    return labels.join(best, "id", "left").select("id", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.coalesce("vote", F.col("label"))).alias("label"))


def _hash(seed: int, *columns: Column) -> Column:
    """A number from 0 to 2**40 - 1 that depends on the values alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40))


def label_outliers(edges: DataFrame, labels: DataFrame, seed: int = 0, max_hops: int = MAX_HOPS) -> DataFrame:
    """(id, label) with every node labelled.

    A node labelled -1 takes the label of the nearest labelled node within ``max_hops`` hops,
    the smallest on ties; one that reaches none takes a label drawn by hash from 0 to the
    largest. Without any label nothing changes.
    """
    top = labels.agg(F.max("label").alias("m")).first()["m"]
    if top is None or top < 0:
        return labels
    now = cut(labels)
    left = now.where("label < 0").count()
    for _ in range(max_hops):
        if not left:
            break
        seen = edges.join(now.where("label >= 0").select(F.col("id").alias("dst"), F.col("label").alias("near")), "dst")
        reach = seen.groupBy(F.col("src").alias("id")).agg(F.min("near").alias("near"))
        now = cut(now.join(reach, "id", "left").select("id", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.coalesce("near", F.col("label"))).alias("label")))
        rest = now.where("label < 0").count()
        if rest == left:
            break
        left = rest
    drawn = F.pmod(_hash(seed, F.col("id")), F.lit(top + 1))
    return now.select("id", F.when(F.col("label") < 0, drawn).otherwise(F.col("label")).alias("label"))


def remap_labels(labels: DataFrame) -> DataFrame:
    """(id, label) with labels 0, 1, ... in their order; each -1 gets a label of its own, by id."""
    used = labels.where("label >= 0").select("label").distinct()
    order = _numbered(used, "label")
    n = used.count()
    some = labels.join(order, "label").select("id", F.col("number").alias("label"))
    none = _numbered(labels.where("label < 0").select("id"), "id").select("id", (F.col("number") + n).alias("label"))
    return some.unionByName(none)


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """(column, number): consecutive numbers from 0 in the column's order, without a single task.

    Rows are range-partitioned and numbered within partitions; partition sizes, one row each,
    give the offsets.
    """
    part = cut(df.repartitionByRange(F.col(column)).withColumn("part", F.spark_partition_id()))
    inner = part.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(column)))
    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offset = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    return inner.join(F.broadcast(offset), "part").select(column, (F.coalesce("before", F.lit(0)) + F.col("k") - 1).cast("long").alias("number"))


def seed_labels(nodes: DataFrame, parts: int, seed: int) -> DataFrame:
    """(id, label): the ``parts`` nodes with the smallest hash get labels 0, 1, ...; others -1."""
    drawn = nodes.select("id", _hash(seed, F.col("id")).alias("h"))
    chosen = drawn.orderBy("h", "id").limit(parts)
    numbered = _numbered(chosen.select(F.struct("h", "id").alias("key")), "key").select(F.col("key.id").alias("id"), F.col("number").alias("label"))
    return nodes.select("id").join(numbered, "id", "left").select("id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


def _on_arrays(edges: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """``run(graph, x, ids)`` in one task over edges (src, dst, w) and rows (id, pos)."""
    empty = F.array().cast("array<double>")
    nodes = rows.select(F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("dst"), F.lit(0.0).alias("w"), "pos")
    links = edges.select(F.lit(1).alias("kind"), F.col("src").alias("id"), "dst", "w", empty.alias("pos"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        from tessera.operators.coarsening import Graph

        a, e = pdf[pdf.kind == 0], pdf[pdf.kind == 1]
        ids = a["id"].to_numpy()
        if not len(ids):
            return pd.DataFrame()
        i, j = np.searchsorted(ids, e["id"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy())
        x = np.stack(a["pos"].to_numpy()).astype(float)
        return run(Graph(i.astype(np.int64), j.astype(np.int64), e["w"].to_numpy().astype(float), len(ids)), x, ids)

    return in_one_task(nodes.unionByName(links), kernel, schema, ["kind", "id", "dst"])


def label_prop_partition(edges: DataFrame, nodes: DataFrame, parts: int, n_iter: int = 20, seed: int = 42, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(id, label): a partition of ``nodes`` (id) into at most ``parts`` groups.

    ``parts`` of 0 or less leaves every node to itself. Up to ``one_task_rows`` nodes the rounds
    run in one task, beyond that each is a join; both give the same partition.
    """
    if nodes.count() <= one_task_rows:

        def run(g, x, ids):
            from tessera.operators.coarsening import partition

            return pd.DataFrame({"id": ids, "label": partition(g, ids, parts, n_iter, seed)})

        return _on_arrays(edges, nodes.select("id", F.array(F.lit(0.0)).alias("pos")), run, "id long, label long")
    now = cut(seed_labels(nodes, max(parts, 0), seed))
    left = now.where("label < 0").count()
    for _ in range(n_iter if parts > 0 else 0):
        now = cut(label_prop_iteration(edges, now))
        rest = now.where("label < 0").count()
        if rest == left:  # a round depends on the labels alone
            break
        left = rest
    return remap_labels(label_outliers(edges, now, seed + 2000))


def unit_range(rows: DataFrame) -> DataFrame:
    """(id, pos) with every column scaled to [-1, 1]; constant columns stay."""
    wide = sparse.from_dense(rows)
    ends = wide.groupBy("j").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), (F.col("v") - (F.col("lo") + F.col("hi")) / 2) / ((F.col("hi") - F.col("lo")) / 2)).otherwise(F.col("v"))
    scaled = wide.join(F.broadcast(ends), "j").select("i", "j", v.alias("v"))
    return scaled.groupBy(F.col("i").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("pos"))


def pca_init(rows: DataFrame, dim: int) -> DataFrame:
    """(id, pos) on the leading ``dim`` principal axes of (id, pos), scaled to the unit range.

    Second moments are one aggregation over rows, so only a d x d matrix reaches the driver. Signs
    are fixed: the largest entry of each axis is positive. Missing axes are zero.
    """
    x = sparse.from_dense(rows)
    mean = x.groupBy("j").agg(F.avg("v").alias("m"))
    size = rows.count()
    if not size:
        return rows
    d = rows.select(F.max(F.size("pos"))).first()[0]
    means = np.zeros(d)
    for r in mean.collect():
        means[r["j"]] = r["m"]

    def moments(batches):
        total = np.zeros((d, d))
        for pdf in batches:
            v = np.stack(pdf["pos"].to_numpy()) - means if len(pdf) else np.zeros((0, d))
            total += v.T @ v
        yield pd.DataFrame({"k": np.arange(d), "row": list(total)})

    cov = np.zeros((d, d))
    for r in rows.select("pos").mapInPandas(moments, "k int, row array<double>").select("k", F.posexplode("row").alias("j", "v")).groupBy("k", "j").agg(F.sum("v").alias("v")).collect():
        cov[r["k"], r["j"]] = r["v"]
    value, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(-value, kind="stable")[: min(dim, size, d)]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] + 1e-300)
    full = np.zeros((d, dim))
    full[:, : axes.shape[1]] = axes

    def project(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "pos": list((np.stack(pdf["pos"].to_numpy()) - means) @ full)})

    return unit_range(rows.mapInPandas(project, "id long, pos array<double>"))


def random_init(nodes: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """(id, pos): uniform in [-1, 1], then of unit length; drawn by hash of (seed, id, column)."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda c: _hash(seed, F.col("id"), c).cast("double") / F.lit(float(1 << 39)) - 1)
    drawn = nodes.select("id", raw.alias("pos"))
    length = F.sqrt(F.aggregate("pos", F.lit(0.0), lambda a, x: a + x * x))
    return drawn.withColumn("n", length).select("id", F.when(F.col("n") > 0, F.transform("pos", lambda x: x / F.col("n"))).otherwise(F.col("pos")).alias("pos"))


def coarsen_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, j, v): edges between parts, weights divided by the root of the first part's size and
    clipped to [0, 1]; not symmetric, the diagonal is kept."""
    part = labels.select("id", "label")
    size = part.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    a = edges.join(part.select(F.col("id").alias("src"), F.col("label").alias("i")), "src").join(part.select(F.col("id").alias("dst"), F.col("label").alias("j")), "dst")
    sums = a.groupBy("i", "j").agg(F.sum("w").alias("w")).join(size.select(F.col("label").alias("i"), "n"), "i")
    return sums.select("i", "j", F.least(F.greatest(F.col("w") / F.sqrt("n"), F.lit(0.0)), F.lit(1.0)).alias("v"))


def coarsen_data(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, pos): mean of each part."""
    wide = sparse.from_dense(rows).join(labels.select(F.col("id").alias("i"), "label"), "i")
    means = wide.groupBy("label", "j").agg(F.avg("v").alias("v"))
    return means.groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("pos"))


def expand_layout(edges: DataFrame, labels: DataFrame, layout: DataFrame, scaling: float = 0.1) -> DataFrame:
    """(id, pos) of the nodes from the layout of their parts.

    Half the part's place, half the mean of the places of the parts around a node, weighted by
    w(i,j) w(j,i) / root of the part's size; columns are centred and scaled.
    """
    part = labels.select("id", "label")
    size = part.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    g = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v"))
    both = sparse.hadamard(g, sparse.transpose(g))
    member = part.join(size, "label").select(F.col("id").alias("i"), F.col("label").alias("j"), (1 / F.sqrt("n")).alias("v"))
    around = sparse.matmul_dense(sparse.normalise_rows_l1(sparse.matmul(both, member)), layout).select(F.col("i").alias("id"), F.col("pos").alias("near"))
    own = part.join(layout.select(F.col("id").alias("label"), F.col("pos").alias("own")), "label").select("id", "own")
    mixed = own.join(around, "id", "left").select("id", F.when(F.col("near").isNull(), F.transform("own", lambda x: x / 2)).otherwise(F.zip_with("own", "near", lambda x, y: (x + y) / 2)).alias("pos"))
    wide = sparse.from_dense(mixed)
    mean = wide.groupBy("j").agg(F.avg("v").alias("m"))
    moved = wide.join(F.broadcast(mean), "j").select("i", "j", ((F.col("v") - F.col("m")) * scaling).alias("v"))
    return moved.groupBy(F.col("i").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("pos"))


def label_prop_init(edges: DataFrame, rows: DataFrame, dim: int, params: EmbeddingParams | None = None, seed: int = 42, parts: int | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(id, pos): a start for the layout of ``rows`` (id, pos) by recursive coarsening of their graph.

    Levels of at most ``one_task_rows`` nodes, and all below them, are worked off in one task.
    """
    from tessera.operators.embedding import node_embedding

    params = params or EmbeddingParams()
    edges, rows = cut(edges), cut(rows)
    n = rows.count()
    if not n:
        return rows
    if parts is None:
        parts = min(min(max(int(8 * n**0.5), 256), 16384), n)
    if n <= one_task_rows:

        def run(g, x, ids):
            from tessera.operators.coarsening import initial_layout

            return pd.DataFrame({"id": ids, "pos": list(initial_layout(g, x, ids, dim, params, seed, parts))})

        return _on_arrays(edges, rows, run, "id long, pos array<double>")
    d = rows.select(F.size("pos")).first()[0]
    if n < params.base_init_threshold or parts < 1:
        return pca_init(rows, dim) if dim <= d else random_init(rows.select("id"), dim, seed)
    labels = cut(label_prop_partition(edges, rows.select("id"), parts, params.n_label_prop_iter, seed, one_task_rows))
    groups = labels.agg(F.max("label")).first()[0] + 1
    if groups >= n and n >= params.base_init_threshold and parts >= n:
        parts = max(parts // 2, 1)  # nothing was drawn together: ask for fewer parts below
    small = coarsen_graph(edges, labels).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w"))
    means = coarsen_data(rows, labels)
    start = label_prop_init(small, means, dim, params, seed + 3000, max(parts // 4, 1), one_task_rows)
    epochs = min(params.n_epochs, 255)
    coarse = EmbeddingParams(n_epochs=epochs, initial_alpha=0.001 * epochs)
    placed = node_embedding(small, start, coarse, seed + 4000, one_task_rows)
    return expand_layout(edges, labels, placed, params.scaling)
