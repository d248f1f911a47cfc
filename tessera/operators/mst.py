"""Minimum spanning tree over mutual reachability distances, and single linkage.

Ties are common here, so edges have a total order (weight, smaller id, larger id) and the tree
is unique whatever computes it. Up to ``ONE_TASK_ROWS`` points one task grows it point by point
in O(n^2) time and O(n) memory. Beyond that, rounds join components: their best edges out are found
against broadcast blocks of bounded size, in which boxes of points are passed over that can't hold an
edge as good as a known one. Up to ``BLOCK_ROWS`` points there is one block, which is broadcast once; a round sends out
the components alone. Vectors of ``WIDE`` dimensions or more, whose boxes rule out little, are compared by matrix products that bound
their distances, and each keeps a list of its neighbours. Beyond that, a walk over the tree's edges in one task names the joined components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.knn import _matrix, knn
from tessera.operators.labelprop import ONE_TASK_ROWS
from tessera.operators.onetask import in_one_task
from tessera.runtime import cut


#: Points that a task searches for at a time, and points of one block.
AT_ONCE, BLOCK_ROWS = 1 << 16, 1 << 18
#: Dimensions from which products bound distances, neighbours that are then listed, boxes of a product, pairs of exact distances at a time.
WIDE, LISTED, TOGETHER, PAIRS = 8, 16, 32, 1 << 15
#: Wide points whose tree one task grows.
WIDE_ONE_TASK = 1 << 11
#: Rows of descendants that are made at a time, and that a task makes on average.
PIECE, TASK_ROWS = 1 << 17, 1 << 25


def knn_lowdim(points: DataFrame, k: int) -> DataFrame:
    """(src, rank, dst, dist2): exact neighbours with squared distances, itself excluded."""
    return knn(points, k, "kmknn").select("src", "rank", "dst", (F.col("dist") * F.col("dist")).alias("dist2"))


def core_distance(points: DataFrame, min_samples: int) -> DataFrame:
    """(id, core): distance to the ``min_samples``-th neighbour, or to the last if there are fewer.

    0 for min_samples 0 and for a single point.
    """
    if min_samples < 1:
        return points.select("id", F.lit(0.0).alias("core"))
    far = knn(points, min_samples, "kmknn").groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("core"))
    return points.select("id").join(far, "id", "left").select("id", F.coalesce("core", F.lit(0.0)).alias("core"))


def mutual_reachability(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """(src, dst, mr): the greatest of the distance and both core distances."""
    a, b = core.select(F.col("id").alias("src"), F.col("core").alias("ca")), core.select(F.col("id").alias("dst"), F.col("core").alias("cb"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", F.greatest("dist", "ca", "cb").alias("mr"))


def _gap(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances between all rows of ``q`` and of ``x``, summed as ``_distance`` does."""
    if x.shape[1] >= 8:
        return np.sqrt(((x[None] - q[:, None]) ** 2).sum(2))
    d = np.zeros((len(q), len(x)))
    for j in range(x.shape[1]):
        d += (x[None, :, j] - q[:, None, j]) ** 2
    return np.sqrt(d, out=d)


class Boxes:
    """Points in boxes of at most ``LEAF`` rows, halved along their widest side."""

    LEAF = 128

    def __init__(self, ids: np.ndarray, x: np.ndarray, core: np.ndarray):
        order, ends, todo = np.arange(len(ids)), [], [(0, len(ids))]
        while todo:
            a, b = todo.pop()
            if b - a <= self.LEAF:
                ends.append(b)
                continue
            some = order[a:b]
            wide = int(np.argmax(x[some].max(0) - x[some].min(0))) if x.shape[1] else 0
            m = (b - a) // 2
            if x.shape[1]:
                order[a:b] = some[np.argpartition(x[some, wide], m)]
            todo += [(a + m, b), (a, a + m)]
        self.order, self.ids, self.x, self.core = order, ids[order], x[order], core[order]
        self.starts = np.array([0, *ends[:-1]], int)[: len(ends) if len(ids) else 0]
        self.ends = np.array(ends, int)[: len(self.starts)]
        self.low, self.high = (f.reduceat(self.x, self.starts, axis=0) if len(ids) else self.x for f in (np.minimum, np.maximum))
        self.least_core = np.minimum.reduceat(self.core, self.starts) if len(ids) else self.core

    def factors(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows about their mean as (-2 x, x squared), that mean and the largest square; made where they are used, not sent."""
        if "made" not in self.__dict__:
            mean = self.x.mean(0)
            x = self.x - mean
            square = (x * x).sum(1)
            self.made = np.concatenate([-2 * x, square[:, None]], axis=1), mean, square.max()
        return self.made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "made"}

    def rows(self, boxes: np.ndarray) -> np.ndarray:
        """The places of all points of ``boxes``."""
        return np.concatenate([np.arange(self.starts[b], self.ends[b]) for b in boxes])

    def parts(self, comp: np.ndarray) -> np.ndarray:
        """The component of each box whose points share one, else -1."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        least, most = np.minimum.reduceat(comp, self.starts), np.maximum.reduceat(comp, self.starts)
        return np.where(least == most, least, -1)


def _exact(x: np.ndarray, q: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distances of the pairs (row of ``x``, row of ``q``), equal to those of ``_gap``."""
    pieces = (slice(a, a + PAIRS) for a in range(0, len(at), PAIRS))
    return np.concatenate([np.zeros(0), *(np.sqrt(((x[row[p]] - q[at[p]]) ** 2).sum(1)) for p in pieces)])


def _factor(known: Boxes, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What gives the squared distances less the queries' own squares as products with the factors; these squares; how far both may be off."""
    _, mean, most = known.factors()
    q = q - mean
    own = (q * q).sum(1)
    return np.concatenate([q, np.ones((len(q), 1))], axis=1), own, 8 * (q.shape[1] + 8) * np.finfo(float).eps * (own + most)


def _bounds(known: Boxes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least distance of each known box to the box from ``low`` to ``high``."""
    apart = np.maximum(np.maximum(known.low - high, low - known.high), 0)
    return np.sqrt((apart * apart).sum(1)) * (1 - 1e-12)


def nearest_other(known: Boxes, comp: np.ndarray, asked: Boxes, own: np.ndarray, limit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(w, id) of the best edge of each asked point to a known one of another component; (inf, -1) without one.

    Components are numbered from 0. ``limit``, if any, has a weight for each: edges above it are left out, and it is lowered to
    the best edge found, so a point whose component has a better edge may go without. Boxes are taken by
    their distance until none can hold an edge as good.
    """
    best, other = np.full(len(own), np.inf), np.full(len(own), -1, np.int64)
    limited = limit is not None
    limit = limit if limited else np.full(max(comp.max(initial=-1), own.max(initial=-1)) + 1, np.inf)
    same, mine = known.parts(comp), asked.parts(own)
    for g, (a, b) in enumerate(zip(asked.starts, asked.ends, strict=True)):
        if known.x.shape[1] >= WIDE and len(same):
            _nearest_of_group(known, comp, asked, own, limit, limited, np.flatnonzero((same < 0) | (same != mine[g])), g, best, other)
            continue
        apart = np.maximum(np.maximum(known.low - asked.high[g], asked.low[g] - known.high), 0)
        bound = np.maximum(np.sqrt((apart * apart).sum(1)) * (1 - 1e-12), np.maximum(known.least_core, asked.least_core[g]))
        here = own[a:b]
        may = np.flatnonzero((bound <= limit[here].max()) & ((same < 0) | (same != mine[g])))
        for box in may[np.argsort(bound[may], kind="stable")]:
            most = np.minimum(best[a:b], limit[here])
            who = np.flatnonzero(bound[box] <= most)
            if not len(who):
                if bound[box] > most.max():
                    break
                continue
            s, e = known.starts[box], known.ends[box]
            at = a + who
            w = np.maximum(np.maximum(_gap(known.x[s:e], asked.x[at]), known.core[s:e][None]), asked.core[at][:, None])
            w[comp[s:e][None] == own[at][:, None]] = np.inf
            low = w.min(1)
            hit = np.flatnonzero((low <= most[who]) & np.isfinite(low))
            if not len(hit):
                continue
            at, w, low = at[hit], w[hit], low[hit]
            # ties by (smaller id, larger id): one end is the same, so the smallest other id decides
            tied = np.where(w == low[:, None], known.ids[s:e][None], np.iinfo(np.int64).max).min(1)
            better = (low < best[at]) | ((low == best[at]) & (tied < other[at]))
            best[at[better]], other[at[better]] = low[better], tied[better]
            if limited:
                np.minimum.at(limit, own[at[better]], low[better])
    return best, other


def _nearest_of_group(known: Boxes, comp, asked: Boxes, own, limit, limited: bool, may: np.ndarray, g: int, best: np.ndarray, other: np.ndarray) -> None:
    """``nearest_other`` of the asked box ``g`` among the boxes ``may``, for wide vectors: products rule out all but few pairs."""
    a, b = asked.starts[g], asked.ends[g]
    bound = np.maximum(_bounds(known, asked.low[g], asked.high[g]), np.maximum(known.least_core, asked.least_core[g]))
    q, core, here = asked.x[a:b], asked.core[a:b], own[a:b]
    wide, square, off = _factor(known, q)
    factors = known.factors()[0]
    may = may[bound[may] <= limit[here].max()]
    may = may[np.argsort(bound[may], kind="stable")]
    for c in range(0, len(may), TOGETHER):
        most = np.minimum(best[a:b], limit[here])
        some = may[c : c + TOGETHER]
        some = some[bound[some] <= most.max()]
        if not len(some):
            break
        who = np.flatnonzero(bound[some[0]] <= most)
        row = known.rows(some)
        d = wide[who] @ factors[row].T
        apart = comp[row][None] != here[who][:, None]
        if (free := np.flatnonzero(np.isinf(most[who]))).size:
            # any edge out is a bound
            v = np.where(apart[free], np.maximum(d[free] + square[who[free]][:, None], known.core[row][None] ** 2), np.inf)
            col = v.argmin(1)
            ok = np.isfinite(v[np.arange(len(free)), col])
            to, at = row[col[ok]], who[free[ok]]
            most[at] = np.maximum(np.maximum(_exact(known.x, q, to, at), known.core[to]), core[at])
        at, col = np.nonzero((d <= (most**2 * (1 + 1e-12) - square + off)[who][:, None]) & apart)
        at, to = who[at], row[col]
        near = known.core[to] <= most[at]
        at, to = at[near], to[near]
        w = np.maximum(np.maximum(_exact(known.x, q, to, at), known.core[to]), core[at])
        near = w <= most[at]
        at, to, w = at[near], known.ids[to[near]], w[near]
        # ties by (smaller id, larger id): one end is the same, so the smallest other id decides
        order = np.lexsort((to, w, at))
        order = order[np.unique(at[order], return_index=True)[1]]
        at, to, w = a + at[order], to[order], w[order]
        better = (w < best[at]) | ((w == best[at]) & (to < other[at]))
        best[at[better]], other[at[better]] = w[better], to[better]
        if limited:
            np.minimum.at(limit, own[at[better]], w[better])


def near_lists(known: Boxes, boxes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the ``k`` nearest of each point of ``boxes``, itself excluded; there are more than k points."""
    factors, near, dist = known.factors()[0], [np.zeros((0, k), np.int64)], [np.zeros((0, k))]
    for g in boxes:
        a, b = known.starts[g], known.ends[g]
        wide, square, off = _factor(known, known.x[a:b])
        bound = _bounds(known, known.low[g], known.high[g])
        bound[g] = -1  # the own box comes first
        order = np.argsort(bound, kind="stable")
        best, found = np.full((b - a, k), np.inf), []
        for c in range(0, len(order), TOGETHER):
            some = order[c : c + TOGETHER]
            some = some[np.maximum(bound[some], 0) ** 2 <= (best[:, -1] + square + off).max()]
            if not len(some):
                break
            row = known.rows(some)
            d = wide @ factors[row].T
            if not c:
                np.fill_diagonal(d, np.inf)
            who = np.flatnonzero(d.min(1) < best[:, -1])
            best[who] = np.sort(np.partition(np.concatenate([best[who], d[who]], axis=1), k - 1, axis=1)[:, :k], axis=1)
            at, col = np.nonzero(d <= (best[:, -1] + 2 * off)[:, None])
            ok = np.isfinite(d[at, col])
            found.append((at[ok], row[col[ok]], d[at[ok], col[ok]]))
        at, row, d = (np.concatenate([f[j] for f in found]) for j in range(3))
        keep = d <= best[at, -1] + 2 * off[at]
        at, row = at[keep], row[keep]
        d = _exact(known.x, known.x[a:b], row, at)
        order = np.lexsort((known.ids[row], d, at))
        at, row, d = at[order], row[order], d[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        near.append(row[first].reshape(-1, k))
        dist.append(d[first].reshape(-1, k))
    return np.concatenate(near), np.concatenate(dist)


def _gathered(batches) -> Iterator[pa.Table]:
    """Batches put together up to some ``AT_ONCE`` rows."""
    some: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            some.append(batch)
        if some and (batch is None or sum(b.num_rows for b in some) >= AT_ONCE):
            rows, some = pa.Table.from_batches(some).combine_chunks(), []
            if rows.num_rows:
                yield rows


def nearest_other_component(points: DataFrame, block_rows: int = BLOCK_ROWS, limits: DataFrame | None = None) -> DataFrame:
    """(id, other, w) for each of (id, embedding, core, comp): its best edge to another component.

    Edges are compared by (w, smaller id, larger id). One component, no rows. With ``limits`` (comp, most), a component's
    edges above ``most`` are left out, and so are points whose component has a better edge.
    """
    spark = points.sparkSession
    n = points.count()
    blocks = max(1, -(-n // block_rows))
    bounds = limits.toPandas() if limits is not None else None
    least = None if bounds is None else spark.sparkContext.broadcast((np.sort(bounds["comp"].to_numpy()), bounds.sort_values("comp")["most"].to_numpy()))
    out = None
    for b in range(blocks if n else 0):
        part = points if blocks == 1 else points.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        rows = part.select("id", "embedding", "core", "comp").orderBy("id").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        ids, core, comp = (rows.column(c).to_numpy() for c in ("id", "core", "comp"))
        boxes = Boxes(ids, _matrix(rows.column("embedding").combine_chunks()), core)
        shared = spark.sparkContext.broadcast((boxes, comp[boxes.order]))

        def search(batches, shared=shared):
            known, comp = shared.value
            for rows in _gathered(batches):
                ids, core, own = (rows.column(c).to_numpy() for c in ("id", "core", "comp"))
                asked = Boxes(ids, _matrix(rows.column("embedding").combine_chunks()), core)
                own = own[asked.order]
                names = np.unique(np.concatenate([comp, own]))
                limit = None
                if least is not None:
                    limit, (keys, most) = np.full(len(names), np.inf), least.value
                    at = np.searchsorted(names, keys).clip(max=len(names) - 1)
                    here = names[at] == keys
                    limit[at[here]] = most[here]
                best, other = nearest_other(known, np.searchsorted(names, comp), asked, np.searchsorted(names, own), limit)
                ok = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(asked.ids[ok]), pa.array(other[ok]), pa.array(best[ok])], names=["id", "other", "w"])

        found = points.select("id", "embedding", "core", "comp").mapInArrow(search, "id long, other long, w double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "id long, other long, w double")
    if blocks == 1:
        return out
    order = F.struct("w", F.least("id", "other"), F.greatest("id", "other"))
    return out.groupBy("id").agg(F.min_by(F.struct("other", "w"), order).alias("b")).select("id", "b.other", "b.w")


def grow_tree(ids: np.ndarray, x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree's edges (u, v, w) of points in ascending order of their ids, u < v."""
    n = len(ids)
    best = np.full(n, np.inf)
    source = np.zeros(n, dtype=np.int64)
    out = np.zeros(n, dtype=bool)
    u, v, w = np.zeros(max(n - 1, 0), np.int64), np.zeros(max(n - 1, 0), np.int64), np.zeros(max(n - 1, 0))
    at = 0
    rows = np.arange(n)
    for k in range(n - 1):
        out[at] = True
        d = np.maximum(np.sqrt(((x - x[at]) ** 2).sum(1)), np.maximum(core, core[at]))
        lo, hi = np.minimum(rows, at), np.maximum(rows, at)
        slo, shi = np.minimum(rows, source), np.maximum(rows, source)
        better = (d < best) | ((d == best) & ((lo < slo) | ((lo == slo) & (hi < shi))))
        best[better], source[better] = d[better], at
        best[out] = np.inf
        low = np.flatnonzero(best == best[~out].min())
        low = low[~out[low]]
        a, b = np.minimum(low, source[low]), np.maximum(low, source[low])
        at = low[np.lexsort((b, a))[0]]
        u[k], v[k], w[k] = ids[min(at, source[at])], ids[max(at, source[at])], best[at]
    return u, v, w


def far_neighbour(known: Boxes, boxes: np.ndarray, k: int) -> np.ndarray:
    """The distance of each point of ``boxes`` to its ``k``-th neighbour, itself excluded; there are more than k points."""
    out = []
    for g in boxes:
        a, b = known.starts[g], known.ends[g]
        apart = np.maximum(np.maximum(known.low - known.high[g], known.low[g] - known.high), 0)
        bound = np.sqrt((apart * apart).sum(1)) * (1 - 1e-12)
        bound[g] = -1  # the own box comes first
        best = np.full((b - a, k), np.inf)
        for box in np.argsort(bound, kind="stable"):
            who = np.flatnonzero(bound[box] < best[:, -1])
            if not len(who):
                break
            d = _gap(known.x[known.starts[box] : known.ends[box]], known.x[a + who])
            if box == g:
                np.fill_diagonal(d, np.inf)
            near = np.flatnonzero(d.min(1) < best[who, -1])
            best[who[near]] = np.sort(np.partition(np.concatenate([best[who[near]], d[near]], axis=1), k - 1, axis=1)[:, :k], axis=1)
        out.append(best[:, -1])
    return np.concatenate([np.zeros(0), *out])


def _in_pieces(spark, n: int, kernel, schema: str) -> pa.Table:
    """The rows that ``kernel`` makes of each piece, given as a slice, of 0 to n - 1."""
    pieces = min(4 * spark.sparkContext.defaultParallelism, n) or 1

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield kernel(slice(p * n // pieces, (p + 1) * n // pieces))

    return spark.range(0, pieces, 1, pieces).mapInArrow(run, schema).toArrow()


def _in_one_block(points: DataFrame, min_samples: int) -> DataFrame:
    """``mst`` of at least two points that fit one block: its boxes are broadcast once, a round sends out the components.

    A point's best edge stays its best until both ends are in one component, and what was its best bounds all later ones.
    So a round searches only for points whose best edge is gone and may be as good as the best known of their component.
    """
    spark = points.sparkSession
    rows = points.select("id", "embedding").orderBy("id").toArrow().combine_chunks()
    ids = rows.column("id").to_numpy()
    n = len(ids)
    boxes = Boxes(ids, _matrix(rows.column("embedding").combine_chunks()), np.zeros(n))
    near, reach = np.zeros((n, 0), np.int64), np.zeros(n)  # of each point: places in its list, and what is nearer than this is there
    if boxes.x.shape[1] >= WIDE:
        shared, k = spark.sparkContext.broadcast(boxes), min(max(min_samples, LISTED), n - 1)

        def lists(piece: slice) -> pa.RecordBatch:
            known = shared.value
            at = np.arange(len(known.starts))[piece]
            near, dist = near_lists(known, at, k)
            first = known.starts[at[0]] if len(at) else 0
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(first, first + len(near)), k)), pa.array(near.ravel()), pa.array(dist.ravel())], names=["at", "near", "dist"])

        got = _in_pieces(spark, len(boxes.starts), lists, "at long, near long, dist double")
        order = np.argsort(got.column("at").to_numpy(), kind="stable")
        near, edge = (got.column(c).to_numpy()[order].reshape(n, k) for c in ("near", "dist"))
        if k < n - 1:
            reach = edge[:, -1].copy()
        else:
            reach = np.full(n, np.inf)
        if min_samples > 0:
            boxes.core[:] = edge[:, min(min_samples, k) - 1]
            boxes.least_core = np.minimum.reduceat(boxes.core, boxes.starts)
        edge = np.maximum(np.maximum(edge, boxes.core[:, None]), boxes.core[near])
        shared.unpersist()
    elif min_samples > 0:
        shared, k = spark.sparkContext.broadcast(boxes), min(min_samples, n - 1)

        def cores(piece: slice) -> pa.RecordBatch:
            known = shared.value
            at = np.arange(len(known.starts))[piece]
            core = far_neighbour(known, at, k)
            first = known.starts[at[0]] if len(at) else 0
            return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(core))), pa.array(core)], names=["at", "core"])

        got = _in_pieces(spark, len(boxes.starts), cores, "at long, core double")
        boxes.core[got.column("at").to_numpy()] = got.column("core").to_numpy()
        boxes.least_core = np.minimum.reduceat(boxes.core, boxes.starts)
        shared.unpersist()
    known = spark.sparkContext.broadcast(boxes)
    place = np.empty(n, np.int64)  # of a point in the boxes, by its number among the ids
    place[boxes.order] = np.arange(n)
    comp = np.arange(n)
    # of each point: the best known edge, whether no other can be better, and what all of its edges weigh at least
    w, other, sure, least = np.full(n, np.inf), np.full(n, -1, np.int64), np.zeros(n, bool), np.zeros(n)
    tree = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    while len(tree[0]) < n - 1:
        crossing = (other >= 0) & (comp[other] != comp)
        sure &= crossing
        w[~crossing], other[~crossing] = np.inf, -1
        if near.shape[1]:
            out = np.where(comp[near] != comp[:, None], edge, np.inf)
            low = out.min(1)
            listed = np.flatnonzero(~sure & np.isfinite(low) & (low <= w))
            by = np.where(out[listed] == low[listed, None], boxes.ids[near[listed]], np.iinfo(np.int64).max).argmin(1)
            w[listed], other[listed], sure[listed] = low[listed], near[listed, by], low[listed] < reach[listed]
            crossing = other >= 0
            least = np.where(sure, least, np.maximum(least, reach))
        limit = np.full(n, np.inf)
        at = np.flatnonzero(crossing)
        np.minimum.at(limit, comp[at], w[at])
        np.minimum.at(limit, comp[other[at]], w[at])
        asked = np.flatnonzero(~sure & (least <= limit[comp]))
        sent = spark.sparkContext.broadcast((comp, asked, limit))

        def search(piece: slice, sent=sent) -> pa.RecordBatch:
            b, (comp, asked, limit) = known.value, sent.value
            at, limit = asked[piece], limit.copy()
            some = Boxes(b.ids[at], b.x[at], b.core[at])
            at = at[some.order]
            best, to = nearest_other(b, comp, some, comp[at], limit)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(to), pa.array(best), pa.array(limit[comp[at]])], names=["at", "other", "w", "most"])

        got = _in_pieces(spark, len(asked), search, "at long, other long, w double, most double")
        at, to, best, most = (got.column(c).to_numpy() for c in ("at", "other", "w", "most"))
        hit = np.isfinite(best)
        found = at[hit]
        w[found], other[found], sure[found] = best[hit], place[np.searchsorted(ids, to[hit])], best[hit] <= most[hit]
        least[at] = np.maximum(least[at], np.minimum(best, most))
        at = np.flatnonzero(other >= 0)
        lo, hi = np.minimum(boxes.ids[at], boxes.ids[other[at]]), np.maximum(boxes.ids[at], boxes.ids[other[at]])
        order = np.lexsort((hi, lo, w[at]))
        first = order[np.unique(comp[at][order], return_index=True)[1]]
        # the two components that an edge joins may both have chosen it
        first = first[np.unique(np.stack([lo[first], hi[first]]), axis=1, return_index=True)[1]]
        tree = [np.concatenate(t) for t in zip(tree, (lo[first], hi[first], w[at][first]), strict=True)]
        comp = _joined(comp, comp[at[first]], comp[other[at[first]]])
        sent.unpersist()
    known.unpersist()
    return cut(spark.createDataFrame(pa.table(dict(zip("uvw", tree, strict=True)))))


def mst(points: DataFrame, min_samples: int, one_task_rows: int = ONE_TASK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v, w), u < v: the minimum spanning tree of (id, embedding) under mutual reachability.

    n - 1 edges; none for fewer than two points.
    """
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if (size["d"] or 0) >= WIDE:
        one_task_rows = min(one_task_rows, WIDE_ONE_TASK)
    if max(one_task_rows, 1) < size["n"] <= block_rows:
        return _in_one_block(points, min_samples)
    ready = cut(points.select("id", "embedding").join(core_distance(points, min_samples), "id"))
    n = ready.count()
    if n <= one_task_rows:

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf["embedding"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            u, v, w = grow_tree(pdf["id"].to_numpy(), x, pdf["core"].to_numpy())
            return pd.DataFrame({"u": u, "v": v, "w": w})

        return in_one_task(ready, kernel, "u long, v long, w double", ["id"])
    ready, parts = cut(_placed(ready)), 2 * points.sparkSession.sparkContext.defaultParallelism
    dealt = lambda df: cut(df.repartition(parts, "place"))  # noqa: E731  neighbours meet in a task
    tree, labelled = None, dealt(ready.withColumn("comp", F.col("id")))
    near = cut(mutual_reachability(knn(points, max(min_samples, 1), "kmknn"), ready.select("id", "core")))
    while True:
        # the best known edge out of a component bounds the search for a better one
        comp = labelled.select("id", "comp")
        ends = near.join(comp.select(F.col("id").alias("src"), F.col("comp").alias("a")), "src").join(comp.select(F.col("id").alias("dst"), F.col("comp").alias("b")), "dst").where("a <> b")
        limits = ends.select(F.col("a").alias("comp"), "mr").unionByName(ends.select(F.col("b").alias("comp"), "mr")).groupBy("comp").agg(F.min("mr").alias("most"))
        edges = nearest_other_component(labelled, limits=limits).join(comp, "id")
        lo, hi = F.least("id", "other"), F.greatest("id", "other")
        best = edges.groupBy("comp").agg(F.min(F.struct("w", lo.alias("u"), hi.alias("v"))).alias("e")).select("e.u", "e.v", "e.w").distinct()
        tree = cut(best if tree is None else tree.unionByName(best))
        if tree.count() == n - 1:
            return tree
        labelled = dealt(ready.join(tree_components(ready, tree), "id"))


def _placed(points: DataFrame, sample: int = 20_000) -> DataFrame:
    """Points with a ``place``, the same for points near each other: a few halvings of a bounded sample."""
    n, depth = points.count(), (8 * points.sparkSession.sparkContext.defaultParallelism).bit_length()
    some = points.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(max(1, n // sample))) == 0).select("embedding").toArrow()
    x = _matrix(some.column("embedding").combine_chunks())

    def place(x: np.ndarray, depth: int, name: int):
        if not depth or len(x) < 2 or not x.shape[1]:
            return F.lit(name)
        wide = int(np.argmax(x.max(0) - x.min(0)))
        at = float(np.median(x[:, wide]))
        left = x[:, wide] < at
        return F.when(F.col("embedding")[wide] < at, place(x[left], depth - 1, 2 * name)).otherwise(place(x[~left], depth - 1, 2 * name + 1))

    return points.withColumn("place", place(x, depth, 0))


def _joined(name: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Names after the components that each (u, v) lies in are joined; a name is its smallest member's number."""
    name = name.copy()
    while len(u):
        low = np.minimum(name[u], name[v])
        np.minimum.at(name, name[u], low)
        np.minimum.at(name, name[v], low)
        while (name[name] != name).any():
            name = name[name]
        apart = name[u] != name[v]
        u, v = u[apart], v[apart]
    return name


def tree_components(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, comp) of the nodes (id) under a forest's edges (u, v); comp is the smallest node.

    A walk in one task with about 60 bytes an edge, as in ``linkage``.
    """
    links = tree.select("u", "v").unionByName(nodes.select(F.col("id").alias("u"), F.col("id").alias("v")))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["u"].to_numpy())
        u, v = (np.searchsorted(ids, pdf[c].to_numpy()) for c in ("u", "v"))
        return pd.DataFrame({"id": ids, "comp": ids[_joined(np.arange(len(ids)), u, v)]})

    return in_one_task(links, kernel, "id long, comp long", ["u", "v"])


def merge_edges(u: np.ndarray, v: np.ndarray, w: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """Single linkage rows of a tree's edges; leaf numbers are places in the sorted ids."""
    order = np.lexsort((np.maximum(u, v), np.minimum(u, v), w))
    a, b = np.searchsorted(ids, u[order]), np.searchsorted(ids, v[order])
    n = len(ids)
    up = np.arange(n)  # union-find over points
    name, size = np.arange(n), np.ones(n, dtype=np.int64)
    out = {c: np.zeros(len(order), np.int64) for c in ("merge_id", "left", "right")} | {"distance": w[order], "size": np.zeros(len(order), np.int64)}

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(i), find(j)
        out["left"][k], out["right"][k] = max(name[x], name[y]), min(name[x], name[y])
        if size[x] < size[y]:
            x, y = y, x
        up[y] = x
        size[x] += size[y]
        name[x] = n + k
        out["merge_id"][k], out["size"][k] = n + k, size[x]
    return pd.DataFrame(out)


def linkage(tree: DataFrame) -> DataFrame:
    """(merge_id, left, right, distance, size) of a spanning tree (u, v, w).

    Leaves are numbered 0 to n - 1 in the order of their ids; merge k makes node n + k; left is
    the larger number. The merging is sequential and runs in one task with about 60 bytes an edge.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, w = (pdf[c].to_numpy() for c in ("u", "v", "w"))
        return merge_edges(u, v, w, np.unique(np.concatenate([u, v])))

    return in_one_task(tree, kernel, "merge_id long, left long, right long, distance double, size long", ["w", "u", "v"])


def descendants(link: DataFrame) -> DataFrame:
    """(node, leaf) for all inner nodes of a dendrogram.

    All leaves are laid out in one order, of which each node holds a range, in one task with about 60 bytes an edge. The
    order is broadcast, and ranges are written out in bounded pieces by all tasks, so no task holds the rows.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        merges = list(zip(*(pdf[c].tolist() for c in ("merge_id", "left", "right")), strict=True))
        top = int(pdf[["merge_id", "left", "right"]].to_numpy().max()) + 1 if len(pdf) else 0
        size, low = [1] * top, [-1] * top
        for m, a, b in merges:
            size[m] = size[a] + size[b]
        end = 0
        for m, a, b in reversed(merges):
            if low[m] < 0:  # a root
                low[m], end = end, end + size[m]
            low[a], low[b] = low[m], low[m] + size[a]
        low, size = np.array(low, np.int64), np.array(size, np.int64)
        node = np.flatnonzero(low >= 0)
        return pd.DataFrame({"node": node, "low": low[node], "size": size[node]})

    spark = link.sparkSession
    laid = cut(in_one_task(link, kernel, "node long, low long, size long", ["merge_id"]))
    leaves = laid.where("size = 1").select("node", "low").toArrow()
    order = np.empty(leaves.num_rows, np.int64)
    order[leaves.column("low").to_numpy()] = leaves.column("node").to_numpy()
    shared = spark.sparkContext.broadcast(order)

    def write(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, low, size = (batch.column(c).to_numpy() for c in ("node", "low", "size"))
            # as many ranges at a time as make one piece
            held = np.cumsum(size) // PIECE
            for some in np.split(np.arange(len(size)), np.flatnonzero(np.diff(held)) + 1):
                if len(some):
                    leaf = np.concatenate([shared.value[a : a + n] for a, n in zip(low[some].tolist(), size[some].tolist(), strict=True)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[some], size[some])), pa.array(leaf)], names=["node", "leaf"])

    inner = laid.where("size > 1")
    total = inner.agg(F.sum("size")).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PIECE).cast("long"))).alias("start")
    pieces = inner.select("node", "low", "size", start).select("node", (F.col("low") + F.col("start")).alias("low"), F.least(F.col("size") - F.col("start"), F.lit(PIECE)).alias("size"))
    return pieces.repartition(parts).mapInArrow(write, "node long, leaf long")
