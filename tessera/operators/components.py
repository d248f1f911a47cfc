"""Connected components of a large link table by alternating stars.

Links never leave the executors. A large star hangs each neighbour larger than a node on
the smallest node around it, a small star does the same with the smaller neighbours; a few
alternations turn every component into one star around its smallest node. Lineage is cut
after each, in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import HOT_ROWS, cut, join_counted


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _around(links: DataFrame, low: DataFrame, hot_rows: int | None) -> DataFrame:
    """Links (a, b) beside the smallest node around a; ``low`` has it and the number of a's links.

    The middle of a large star has very many links, so it is kept out of the shuffle. The
    table of low is made once more for that, which only large graphs need.
    """
    return links.join(low, "a") if hot_rows is None else join_counted(links, cut(low), "a", "n", hot_rows)


def _large_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _around(both, low, hot_rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    hung = _around(down, low, hot_rows).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b): each linked node but the smallest of its component, and that smallest node.

    ``links`` has two columns a and b of one orderable type; direction, repeats and loops
    don't matter. No links, no rows.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    before = _state(edges)
    while before[0]:
        most = hot_rows if 2 * before[0] > hot_rows else None  # no node can have more links than there are
        edges = cut(_small_star(_large_star(edges, most), most))
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``nodes`` (id); component is its smallest node."""
    stars = components(links).select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.select("id").join(stars, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    """(component, size) of (id, component)."""
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
