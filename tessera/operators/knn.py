"""k nearest neighbours of every vector of a table.

The table is cut into blocks of bounded size by a hash of the identifier. A task for each block builds
its index, which is written to the shared checkpoint folder once. Queries are cut into groups; every
pair of a block and a group meets in one task, which searches the index for the group's rows, and the k
best over all blocks are picked by one window per row. No vector reaches the driver, memory is
bounded by the block, and the search is spread evenly whatever the data look like. With a single
block, a task's answer is already final and the window is left out.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.search import INDEXES
from tessera.params import NearestNeighbourParams, resolve_method
from tessera.runtime import cut

#: Bytes of vectors in one block.
BLOCK_BYTES = 64 << 20
#: Candidates whose exact distances a task takes at a time.
PAIRS_AT_ONCE = 1 << 17
METRICS = ("euclidean", "cosine")
SCHEMA = "src long, rank int, dst long, dist double"


def ranked(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """(src, rank, dst, dist) of the ``k`` nearest of (src, dst, dist), ties by dst."""
    w = Window.partitionBy("src").orderBy("dist", "dst")
    out = pairs.withColumn("rank", F.row_number().over(w))
    return (out if k is None else out.where(F.col("rank") <= k)).select("src", "rank", "dst", "dist")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; a zero vector becomes a direction of its own, at right angles to all others."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([x / np.where(n > 0, n, 1), (n == 0).astype(float)], axis=1)


def _distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(1))
    scale = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.where(scale > 0, 1 - (a * b).sum(1) / np.where(scale > 0, scale, 1), 1.0)


class _Block:
    def __init__(self, ids: np.ndarray, x: np.ndarray, method: str, metric: str, k: int, params: NearestNeighbourParams, seed: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.metric, self.k = ids[order], x[order], metric, k
        self.index = INDEXES[method](_unit(self.x) if metric == "cosine" else self.x, params, seed, k + 1)

    def search(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows (src, rank, dst, dist): the k nearest in the block; a vector isn't its own neighbour."""
        most = min(self.k + 1, len(self.ids))
        at, row = self.index.query(_unit(q) if self.metric == "cosine" else q, most)
        if self.metric == "cosine" and (zero := ~q.any(axis=1)).any():
            # a zero vector is as far from everything: the smallest ids are its neighbours
            at, row = at[~zero[at]], row[~zero[at]]
            at = np.concatenate([at, np.repeat(np.flatnonzero(zero), most)])
            row = np.concatenate([row, np.tile(np.arange(most), int(zero.sum()))])
        keep = ids[at] != self.ids[row]
        at, row = at[keep], row[keep]
        pieces = (slice(a, a + PAIRS_AT_ONCE) for a in range(0, len(at), PAIRS_AT_ONCE))
        dist = np.concatenate([np.zeros(0), *(_distance(q[at[p]], self.x[row[p]], self.metric) for p in pieces)])
        order = np.lexsort((self.ids[row], dist, at))
        at, row, dist = at[order], row[order], dist[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
        top = rank <= self.k
        return ids[at[top]], rank[top].astype(np.int32), self.ids[row[top]], dist[top]


def knn(df: DataFrame, k: int, method: str = "kmknn", metric: str = "euclidean", params: NearestNeighbourParams | None = None, seed: int = 42, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(src, rank, dst, dist): up to ``k`` neighbours of each row of (id, embedding), itself excluded.

    "exhaustive" and "kmknn" are exact, with ties broken by dst; the others are approximate
    within each block. Distances are Euclidean, or one minus cosine similarity (1 for a zero
    vector). Identifiers must be unique; copies of a vector under another id are neighbours at 0.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known are {METRICS}")
    if k < 1:
        raise ValueError("k must be at least 1")
    method = resolve_method(method)
    params = params or NearestNeighbourParams()
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"), F.min(F.size("embedding")).alias("least")).first()
    if size["n"] and size["d"] != size["least"]:
        raise ValueError("vectors differ in length")
    if not size["n"]:
        return df.sparkSession.createDataFrame([], SCHEMA)
    blocks = max(1, -(-size["n"] * (size["d"] or 1) * 8 // block_bytes))
    # as many groups as blocks, or as keep all cores busy
    groups = max(blocks, -(-df.sparkSession.sparkContext.defaultParallelism // blocks))

    def build(rows: pa.Table) -> pa.Table:
        block = _Block(rows.column("id").to_numpy(), _matrix(rows.column("embedding").combine_chunks()), method, metric, k, params, seed)
        return pa.table({"block": rows.column("block").slice(0, 1), "index": pa.array([pickle.dumps(block)], pa.binary())})

    def search(asked: pa.Table, known: pa.Table) -> pa.Table:
        parts = [tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, float))]
        if known.num_rows:
            block = pickle.loads(known.column("index")[0].as_buffer())
            step = block.index.together
            for a in range(0, asked.num_rows, step):
                part = asked.slice(a, step)
                parts.append(block.search(part.column("id").to_numpy(), _matrix(part.column("embedding").combine_chunks())))
        return pa.table({c: np.concatenate([p[j] for p in parts]) for j, c in enumerate(("src", "rank", "dst", "dist"))})

    rows = df.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    indexes = cut(rows.groupBy("block").applyInArrow(build, "block long, index binary"))
    tiles = indexes.select("block", "index", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    queries = df.select("id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(groups)).cast("int").alias("grp"))
    out = queries.groupBy("block", "grp").cogroup(tiles.groupBy("block", "grp")).applyInArrow(search, SCHEMA)
    return out if blocks == 1 else ranked(out.drop("rank"), k)


def nested(knn_rows: DataFrame) -> DataFrame:
    """(src, indices, distances): the neighbour lists by rank."""
    lists = knn_rows.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "dist"))).alias("l"))
    return lists.select("src", F.transform("l", lambda x: x["dst"]).alias("indices"), F.transform("l", lambda x: x["dist"]).alias("distances"))
