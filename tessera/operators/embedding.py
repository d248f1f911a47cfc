"""Node layout by attraction along edges and sampled repulsion, with Adam steps.

An epoch computes all gradients from frozen coordinates and then steps, so it can be cut by
nodes: each task owns the edges of its nodes and reads the whole layout. Which edges are due and
how many repulsions they draw follows from the epoch's number alone, and draws are hashes of
(seed, node, neighbour, epoch, draw), so the result doesn't depend on partitions. Up to
``ONE_TASK_ROWS`` nodes one task runs all epochs; beyond that, every epoch is a job over
node partitions with the layout broadcast (n x dim x 8 bytes).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import mixed
from tessera.operators.knn import _matrix
from tessera.operators.labelprop import ONE_TASK_ROWS
from tessera.operators.onetask import in_one_task
from tessera.params import EmbeddingParams
from tessera.runtime import cut


class Block:
    """Edges of some nodes: ``node`` and ``other`` are row numbers in the whole layout."""

    def __init__(self, node: np.ndarray, other: np.ndarray, w: np.ndarray, w_max: float, params: EmbeddingParams, seed: int):
        order = np.lexsort((other, node))
        self.node, self.other, w = node[order], other[order], w[order]
        self.period = np.where(w > 0, w_max / np.where(w > 0, w, 1), 1e8)
        rate = params.negative_sample_rate
        self.negative = self.period * 1.5 / rate if rate > 0 else np.full(len(w), np.inf)
        self.params, self.seed = params, seed

    def gradient(self, x: np.ndarray, epoch: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradients (n x dim) and which nodes have a due edge."""
        p = self.params
        grad, active = np.zeros_like(x), np.zeros(len(x), dtype=bool)
        times = np.floor(epoch / self.period)
        due = np.flatnonzero(times > np.floor((epoch - 1) / self.period)) if epoch else np.zeros(0, np.int64)
        if not len(due):
            return grad, active
        i, j = self.node[due], self.other[due]
        active[i] = True
        diff = x[i] - x[j]
        d2 = (diff * diff).sum(1)
        d = np.sqrt(d2)
        pull = np.where(d2 < 1e-8, 0.0, (-2 * p.noise_level * d - 2) / (2 * d2 - 0.5 * d + 1))
        np.add.at(grad, i, pull[:, None] * diff)
        # repulsion: owed so far, less what the edge's last due epoch had drawn
        owed = np.maximum(np.floor(epoch / self.negative[due]) - 1, 0)
        last = np.ceil((times[due] - 1) * self.period[due])
        paid = np.where(times[due] >= 2, np.maximum(np.floor(last / self.negative[due]) - 1, 0), 0)
        count = np.where(i < j, np.maximum(owed - paid, 0), 0).astype(np.int64)
        if count.sum():
            gamma = 0.5 + epoch / max(p.n_epochs - 1, 1)
            draw = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            a = np.repeat(i, count)
            b = (mixed(self.seed, a, np.repeat(j, count), epoch, draw) % np.uint64(len(x))).astype(np.int64)
            away = x[a] - x[b]
            e2 = (away * away).sum(1)
            push = np.where((a != b) & (e2 > 0.01), gamma * 4 / ((1 + 0.25 * e2) * np.maximum(e2, 1e-300)), 0.0)
            np.add.at(grad, a, np.clip(push[:, None] * away, -4, 4))
        return grad, active


class Adam:
    def __init__(self, shape: tuple[int, int], params: EmbeddingParams):
        self.m, self.v, self.p = np.zeros(shape), np.zeros(shape), params

    def step(self, x: np.ndarray, grad: np.ndarray, active: np.ndarray, epoch: int) -> np.ndarray:
        """The layout after the epoch; nodes without a due edge stay where they are."""
        p, t = self.p, epoch + 1
        rate = p.initial_alpha * (1 - epoch / p.n_epochs)
        root = np.sqrt(1 - p.beta2**t)
        bias, eps = root / (1 - p.beta1**t), p.eps * root
        g = grad[active]
        self.m[active] += (1 - p.beta1) * (g - self.m[active])
        self.v[active] += (1 - p.beta2) * (g * g - self.v[active])
        out = x.copy()
        out[active] += rate * bias * self.m[active] / (np.sqrt(self.v[active]) + eps)
        return out


def run_epochs(x: np.ndarray, block: Block, params: EmbeddingParams) -> np.ndarray:
    adam = Adam(x.shape, params)
    for epoch in range(params.n_epochs):
        x = adam.step(x, *block.gradient(x, epoch), epoch)
    return x


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as an array of lists."""
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def _upper(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, by its (smaller, larger) row."""
    return edges.where("src < dst").groupBy("src", "dst").agg(F.max("w").alias("w"))


def node_embedding(edges: DataFrame, start: DataFrame, params: EmbeddingParams | None = None, seed: int = 42, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(id, pos) after all epochs from ``start`` (id, pos) over edges (src, dst, w).

    Only rows with src < dst count; others mirror them. Without such an edge, or with no epochs,
    the start comes back.
    """
    params = params or EmbeddingParams()
    upper = _upper(edges)
    n = start.count()
    if not params.n_epochs or not n:
        return start
    if n <= one_task_rows:
        rows = start.select(F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("dst"), F.lit(0.0).alias("w"), "pos")
        links = upper.select(F.lit(1).alias("kind"), F.col("src").alias("id"), "dst", "w", F.array().cast("array<double>").alias("pos"))

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes, e = pdf[pdf.kind == 0], pdf[pdf.kind == 1]
            ids = nodes["id"].to_numpy()
            x = np.stack(nodes["pos"].to_numpy()).astype(float)
            if len(e):
                i, j, w = np.searchsorted(ids, e["id"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy()), e["w"].to_numpy()
                block = Block(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w]), w.max(), params, seed)
                x = run_epochs(x, block, params)
            return pd.DataFrame({"id": ids, "pos": list(x)})

        return in_one_task(rows.unionByName(links), kernel, "id long, pos array<double>", ["kind", "id", "dst"])
    return _by_epochs(upper, start, params, seed, n)


def _by_epochs(upper: DataFrame, start: DataFrame, params: EmbeddingParams, seed: int, n: int) -> DataFrame:
    from tessera.operators.labelprop import _numbered

    spark = start.sparkSession
    number = cut(_numbered(start.select("id"), "id"))
    near, far = number.select(F.col("id").alias("src"), F.col("number").alias("i")), number.select(F.col("id").alias("dst"), F.col("number").alias("j"))
    one = upper.join(near, "src").join(far, "dst").select("i", "j", "w")
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    lists = cut(both.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("adj")).repartition(spark.sparkContext.defaultParallelism, "i"))
    w_max = one.agg(F.max("w")).first()[0]
    if w_max is None:
        return start
    rows = start.join(number, "id").select("number", "pos").toArrow().sort_by("number")
    x = _matrix(rows.column("pos").combine_chunks())
    adam = Adam(x.shape, params)
    for epoch in range(params.n_epochs):
        shared = spark.sparkContext.broadcast(x)

        def gradients(batches, epoch=epoch, shared=shared):
            for batch in batches:
                adj = batch.column("adj")
                node = np.repeat(batch.column("i").to_numpy(), adj.value_lengths().to_numpy())
                j, w = (f.to_numpy(zero_copy_only=False) for f in adj.flatten().flatten())
                grad, active = Block(node, j, w, w_max, params, seed).gradient(shared.value, epoch)
                at = np.flatnonzero(active)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(at), _lists(grad[at])], names=["i", "g"])

        got = lists.mapInArrow(gradients, "i long, g array<double>").toArrow()
        at = got.column("i").to_numpy()
        grad, active = np.zeros_like(x), np.zeros(n, dtype=bool)
        if len(at):
            grad[at], active[at] = _matrix(got.column("g").combine_chunks()), True
        x = adam.step(x, grad, active, epoch)
        shared.unpersist()
    placed = spark.createDataFrame(pa.table({"number": np.arange(n), "pos": _lists(x)}))
    return number.join(placed, "number").select("id", "pos")


def attract_step(edges: DataFrame, layout: DataFrame, noise_level: float = 0.5) -> DataFrame:
    """(id, grad): attraction alone, of all edges at once, as joins and one aggregation."""
    upper = _upper(edges)
    both = upper.select("src", "dst").unionByName(upper.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    a, b = layout.select(F.col("id").alias("src"), F.col("pos").alias("x")), layout.select(F.col("id").alias("dst"), F.col("pos").alias("y"))
    pairs = both.join(a, "src").join(b, "dst").withColumn("diff", F.zip_with("x", "y", lambda p, q: p - q))
    pairs = pairs.withColumn("d2", F.aggregate("diff", F.lit(0.0), lambda s, v: s + v * v))
    pull = F.when(F.col("d2") < 1e-8, 0.0).otherwise((-2 * noise_level * F.sqrt("d2") - 2) / (2 * F.col("d2") - 0.5 * F.sqrt("d2") + 1))
    flat = pairs.withColumn("pull", pull).select(F.col("src").alias("id"), "pull", F.posexplode("diff").alias("c", "v"))
    sums = flat.groupBy("id", "c").agg(F.sum(F.col("pull") * F.col("v")).alias("g"))
    return sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "g"))), lambda e: e["g"]).alias("grad"))
