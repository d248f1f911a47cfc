"""Condensed trees, cluster layers and their persistence.

A cluster is named by the dendrogram node at which it is born (the root by the last merge), so names
don't depend on the order in which a tree is walked. The walks over a dendrogram of n - 1 rows
are kernels over flat arrays that run in one task; everything that is relational in nature (leaves,
labels, strengths, persistence curves, peaks, similarity of layers) is a DataFrame operator.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.onetask import in_one_task
from tessera.runtime import cut

NOISE = -1


@dataclass(frozen=True)
class Condensed:
    """Rows (parent, child, lambda, child_size); points are children of size 1."""

    parent: np.ndarray
    child: np.ndarray
    lam: np.ndarray
    size: np.ndarray
    root: int

    @property
    def is_cluster(self) -> np.ndarray:
        return self.size > 1


def condense_arrays(left: np.ndarray, right: np.ndarray, distance: np.ndarray, size: np.ndarray, min_size: int) -> Condensed:
    """Walk the dendrogram down from the root: a split into two large sides makes two clusters,
    a small side falls out of the cluster point by point."""
    if min_size < 2:
        raise ValueError("clusters need at least two points")
    n = len(left) + 1
    total = np.concatenate([np.ones(n, np.int64), size])
    cluster = np.full(2 * n - 1, -1, np.int64)
    fell = np.full(2 * n - 1, np.nan)
    rows: list[tuple[int, int, float, int]] = []
    root = 2 * n - 2
    if n < 2:
        return Condensed(*(np.zeros(0, k) for k in (np.int64, np.int64, float, np.int64)), root)
    cluster[root] = root
    for k in range(n - 2, -1, -1):
        node, sides = n + k, (int(left[k]), int(right[k]))
        here = int(cluster[node])
        lam = 1 / distance[k] if distance[k] > 0 else np.inf
        large = [total[s] >= min_size for s in sides]
        for s, big in zip(sides, large, strict=True):
            if not np.isnan(fell[node]):
                cluster[s], fell[s] = here, fell[node]
            elif all(large):
                cluster[s] = s
                rows.append((here, s, lam, int(total[s])))
            else:
                cluster[s] = here
                if not big:
                    fell[s] = lam
    points = np.arange(n)
    made = [np.array([r[c] for r in rows], dtype=t) for c, t in enumerate((np.int64, np.int64, float, np.int64))]
    return Condensed(np.concatenate([made[0], cluster[:n]]), np.concatenate([made[1], points]), np.concatenate([made[2], fell[:n]]), np.concatenate([made[3], np.ones(n, np.int64)]), root)


def leaf_clusters(c: Condensed) -> np.ndarray:
    """Clusters without clusters below that own points, ascending; the root if nothing splits."""
    if not c.is_cluster.any():
        return np.array([c.root])
    return np.setdiff1d(np.unique(c.parent[~c.is_cluster]), c.parent[c.is_cluster])


def label_arrays(c: Condensed, selected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels and strengths of points 0 to n - 1 for selected clusters.

    A point belongs to the nearest selected cluster above it; the root and none are noise.
    """
    selected = np.unique(selected)
    above = dict(zip(c.child[c.is_cluster].tolist(), c.parent[c.is_cluster].tolist(), strict=True))
    number = {s: k for k, s in enumerate(selected.tolist())}
    owner: dict[int, int] = {c.root: NOISE}

    def owned(cluster: int) -> int:
        way = []
        while cluster not in owner:
            if cluster in number:
                owner[cluster] = number[cluster]
                break
            way.append(cluster)
            cluster = above.get(cluster, c.root)
        for w in way:
            owner[w] = owner[cluster]
        return owner[cluster]

    points = ~c.is_cluster
    order = np.argsort(c.child[points], kind="stable")
    parent, lam = c.parent[points][order], c.lam[points][order]
    labels = np.fromiter((owned(int(p)) for p in parent), np.int64, len(parent))
    top = np.full(len(selected), 0.0)
    direct = np.isin(parent, selected)
    np.maximum.at(top, np.searchsorted(selected, parent[direct]), lam[direct])
    most = np.where(labels >= 0, top[np.maximum(labels, 0)] if len(top) else 0.0, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(np.isinf(most), 0.0, np.minimum(lam, most) / np.where(most > 0, most, 1))
    strengths = np.where(labels < 0, 0.0, np.where((most == 0) | np.isinf(lam), 1.0, share))
    return labels, strengths


@dataclass(frozen=True)
class Barcode:
    """For which minimum sizes each cluster is there: born below, gone at size_death."""

    cluster: np.ndarray
    birth: np.ndarray
    death: np.ndarray
    parent: np.ndarray
    lam: np.ndarray

    def active(self, size: float) -> np.ndarray:
        return self.cluster[(self.birth <= size) & (self.death > size)]


def barcode_arrays(c: Condensed, min_size: int, n: int) -> Barcode:
    """Bars of all clusters, the root first; empty if nothing splits."""
    at = np.flatnonzero(c.is_cluster)
    if not len(at):
        return Barcode(*(np.zeros(0, k) for k in (np.int64, float, float, np.int64, float)))
    birth: dict[int, float] = {}
    death, lam, up = {c.root: float(n)}, {c.root: 0.0}, {c.root: c.root}
    sides: dict[int, list[int]] = {}
    for k in at.tolist():
        sides.setdefault(int(c.parent[k]), []).append(k)
    for p, pair in sides.items():
        gone = float(min(c.size[k] for k in pair))
        for k in pair:
            child = int(c.child[k])
            death[child], up[child] = gone, p
            lam[child] = float(np.exp(-1 / c.lam[k]))
    for cluster in sorted(death):  # names grow towards the root
        below = [int(c.child[k]) for k in sides.get(cluster, [])]
        birth[cluster] = max([float(min_size), *(max(birth[b], death[b]) for b in below)])
    names = [c.root, *sorted(k for k in death if k != c.root)]
    return Barcode(np.array(names), *(np.array([d[k] for k in names]) for d in (birth, death, up, lam)))


def persistence_arrays(b: Barcode) -> tuple[np.ndarray, np.ndarray]:
    """Distinct births, and at each the total persistence of the bars that cover it."""
    sizes = np.unique(b.birth)
    total = np.zeros(len(sizes))
    for birth, death, lam in zip(b.birth[1:], b.death[1:], b.lam[1:], strict=True):
        if death > birth:
            total[(sizes >= birth) & (sizes < death)] += (death - birth) * lam
    return sizes, total


def peak_positions(values: np.ndarray) -> list[int]:
    """Places of strict inner maxima; the middle one of a plateau, rounded down."""
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    tails = np.append(heads[1:], len(values)) - 1
    v = values[heads]
    return [int((heads[k] + tails[k]) // 2) for k in range(1, len(heads) - 1) if v[k] > v[k - 1] and v[k] > v[k + 1]]


def jaccard(b: Barcode, size_a: float, size_b: float) -> float:
    x, y = b.active(size_a), b.active(size_b)
    both, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
    return both / either if either else 0.0


def diverse(peaks: list[int], sizes: np.ndarray, total: np.ndarray, b: Barcode, threshold: float, most: int) -> list[int]:
    """Peaks by falling persistence, without those too like a peak taken before."""
    taken: list[int] = []
    for p in sorted(peaks, key=lambda k: (-total[k], k)):
        if len(taken) >= most:
            break
        if all(jaccard(b, sizes[p], sizes[t]) <= threshold for t in taken):
            taken.append(p)
    return taken


def layers_arrays(c: Condensed, n: int, min_size: int, threshold: float, max_layers: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(labels, strengths, persistence) of the base layer and of diverse peaks, finest first."""
    out = [(*label_arrays(c, leaf_clusters(c)), 0.0)]
    b = barcode_arrays(c, min_size, n)
    if len(b.cluster):
        sizes, total = persistence_arrays(b)
        for p in diverse(peak_positions(total), sizes, total, b, threshold, max(max_layers - 1, 0)):
            out.append((*label_arrays(c, b.active(sizes[p])), float(total[p])))
    return sorted(out, key=lambda x: -(x[0].max(initial=-1) + 1))


def search_arrays(left, right, distance, size, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and strengths at the minimum size that leaves about ``target`` clusters."""
    n = len(left) + 1
    if n < 4:
        return np.full(n, NOISE), np.zeros(n)
    # every split of two large sides makes one leaf more, so leaves are counted without a walk down the tree
    total = np.concatenate([np.ones(n, np.int64), size])
    smaller = np.minimum(total[left], total[right])

    def off(m: int) -> int:
        return abs(1 + np.count_nonzero(smaller >= m) - target)

    def labels(m: int) -> tuple[np.ndarray, np.ndarray]:
        c = condense_arrays(left, right, distance, size, m)
        return label_arrays(c, leaf_clusters(c))

    lo, hi = 2, n // 2
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if 1 + np.count_nonzero(smaller >= mid) < target:
            hi = mid
        else:
            lo = mid
    if off(lo) != off(hi):
        return labels(min(lo, hi, key=off))
    fine, coarse = labels(lo), labels(hi)
    return fine if (fine[0] >= 0).sum() >= (coarse[0] >= 0).sum() else coarse


_LINK = ["merge_id"]
CONDENSED = "parent long, child long, lambda double, child_size long"


def _arrays(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [pdf[c].to_numpy() for c in ("left", "right", "distance", "size")]


def condense_tree(link: DataFrame, min_size: int) -> DataFrame:
    """(parent, child, lambda, child_size) of a dendrogram (merge_id, left, right, distance, size).

    Points are children of size 1 and numbered as the dendrogram's leaves. lambda is 1 over the
    distance, infinite at 0. ``min_size`` must be at least 2. No merges, no rows.
    """
    if min_size < 2:
        raise ValueError("clusters need at least two points")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame()
        c = condense_arrays(*_arrays(pdf), min_size)
        return pd.DataFrame({"parent": c.parent, "child": c.child, "lambda": c.lam, "child_size": c.size})

    return in_one_task(link, kernel, CONDENSED, _LINK)


def extract_leaves(condensed: DataFrame) -> DataFrame:
    """(cluster): clusters without clusters below that own points; the root if nothing splits."""
    split = condensed.where("child_size > 1").select(F.col("parent").alias("cluster")).distinct()
    owners = condensed.where("child_size = 1").select(F.col("parent").alias("cluster")).distinct()
    return owners.join(split, "cluster", "left_anti")


def cluster_labels(condensed: DataFrame, selected: DataFrame) -> DataFrame:
    """(id, label): each point's nearest selected cluster above, by rank of its name; -1 for the
    root and none. Ancestors are found by pointer jumping, in rounds that double the reach."""
    root = condensed.agg(F.max("parent")).first()[0]
    up = condensed.where("child_size > 1").select(F.col("child").alias("cluster"), F.col("parent").alias("next"))
    chosen = selected.select(F.col("cluster").alias("cluster")).where(F.col("cluster") != F.lit(root)).distinct()
    every = up.select("cluster").unionByName(condensed.select(F.lit(root).alias("cluster")).limit(1)).distinct()
    mark = chosen.withColumn("own", F.lit(True))
    now = every.join(mark, "cluster", "left").join(up, "cluster", "left")
    # a chosen cluster and the root point at themselves: they are where a search ends
    now = cut(now.select("cluster", F.when(F.col("own") | F.col("next").isNull(), F.col("cluster")).otherwise(F.col("next")).alias("next")))
    while True:
        jump = now.select(F.col("cluster").alias("next"), F.col("next").alias("far"))
        new = cut(now.join(jump, "next").select("cluster", F.col("far").alias("next"), (F.col("far") != F.col("next")).alias("moved")))
        now = new.select("cluster", "next")
        if new.where("moved").isEmpty():
            break
    rank = chosen.select("cluster", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("long").alias("label"))
    owner = now.join(F.broadcast(rank).withColumnRenamed("cluster", "next"), "next", "left").select(F.col("cluster").alias("parent"), F.coalesce("label", F.lit(NOISE).cast("long")).alias("label"))
    return condensed.where("child_size = 1").join(owner, "parent").select(F.col("child").alias("id"), "label")


def death_lambda(condensed: DataFrame, selected: DataFrame) -> DataFrame:
    """(cluster, max_lambda) over the points that selected clusters own directly."""
    own = condensed.where("child_size = 1").select(F.col("parent").alias("cluster"), "lambda")
    return own.join(selected.select("cluster").distinct(), "cluster").groupBy("cluster").agg(F.max("lambda").alias("max_lambda"))


def membership_strength(condensed: DataFrame, selected: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, strength), 0 to 1: a point's lambda over the largest of its cluster; noise has 0."""
    root = condensed.agg(F.max("parent")).first()[0]
    rank = selected.select("cluster").where(F.col("cluster") != F.lit(root)).distinct().select("cluster", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("long").alias("label"))
    top = rank.join(death_lambda(condensed, selected), "cluster", "left").select("label", F.coalesce("max_lambda", F.lit(0.0)).alias("top"))
    points = condensed.where("child_size = 1").select(F.col("child").alias("id"), "lambda").join(labels, "id").join(F.broadcast(top), "label", "left")
    inf = F.lit(float("inf"))
    share = F.when(F.col("top") == inf, F.lit(0.0)).otherwise(F.least("lambda", "top") / F.col("top"))
    return points.select("id", F.when(F.col("label") < 0, 0.0).when((F.col("top") == 0) | (F.col("lambda") == inf), 1.0).otherwise(share).alias("strength"))


def barcode(condensed: DataFrame, min_size: int) -> DataFrame:
    """(cluster_id, size_birth, size_death, parent, lambda_death); the root is its own parent."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame()
        c = Condensed(*(pdf[k].to_numpy() for k in ("parent", "child", "lambda", "child_size")), int(pdf["parent"].max()))
        b = barcode_arrays(c, min_size, int((pdf["child_size"] == 1).sum()))
        return pd.DataFrame({"cluster_id": b.cluster, "size_birth": b.birth, "size_death": b.death, "parent": b.parent, "lambda_death": b.lam})

    return in_one_task(condensed, kernel, "cluster_id long, size_birth double, size_death double, parent long, lambda_death double", ["parent", "child"])


def total_persistence(bars: DataFrame) -> DataFrame:
    """(size, persistence) at each distinct birth: a range join of births with the bars covering them.

    There are at most as many births as distinct sizes below n, so the side of births is small.
    """
    sizes = bars.select(F.col("size_birth").alias("size")).distinct()
    live = bars.where("cluster_id <> parent AND size_death > size_birth").select("size_birth", "size_death", ((F.col("size_death") - F.col("size_birth")) * F.col("lambda_death")).alias("p"))
    covers = (F.col("size") >= F.col("size_birth")) & (F.col("size") < F.col("size_death"))
    return sizes.join(live, covers, "left").groupBy("size").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("persistence"))


def find_peaks(curve: DataFrame) -> DataFrame:
    """(position, size, persistence) of strict inner maxima of (size, persistence); middle of a plateau."""
    w = Window.orderBy("size")
    rows = curve.select("size", "persistence", (F.row_number().over(w) - 1).alias("position"))
    change = F.when(F.lag("persistence").over(w) == F.col("persistence"), 0).otherwise(1)
    runs = rows.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    flat = runs.groupBy("run").agg(F.min("position").alias("a"), F.max("position").alias("b"), F.first("persistence").alias("persistence"))
    v = Window.orderBy("run")
    near = flat.select("a", "b", "persistence", F.lag("persistence").over(v).alias("before"), F.lead("persistence").over(v).alias("after"))
    tops = near.where("persistence > before AND persistence > after").select(F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("position"))
    return rows.join(F.broadcast(tops), "position").select(F.col("position").cast("long").alias("position"), "size", "persistence")


def layer_jaccard(bars: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, jaccard) for pairs a < b of (size): likeness of the sets of clusters that are there."""
    live = sizes.join(bars, (F.col("size_birth") <= F.col("size")) & (F.col("size_death") > F.col("size"))).select("size", "cluster_id")
    n = live.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    counted = sizes.join(n, "size", "left").select("size", F.coalesce("n", F.lit(0)).alias("n"))
    x, y = live.select(F.col("size").alias("a"), "cluster_id"), live.select(F.col("size").alias("b"), "cluster_id")
    both = x.join(y, "cluster_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    pairs = counted.select(F.col("size").alias("a"), F.col("n").alias("na")).join(counted.select(F.col("size").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    joined = pairs.join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    either = F.col("na") + F.col("nb") - F.col("both")
    return joined.select("a", "b", F.when(either > 0, F.col("both") / either).otherwise(0.0).alias("jaccard"))


def diverse_peaks(bars: DataFrame, threshold: float, most: int) -> DataFrame:
    """(place, size, persistence): peaks of the persistence curve, by the order they are taken."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame()
        pdf = pd.concat([pdf[pdf.cluster_id == pdf.parent], pdf[pdf.cluster_id != pdf.parent]])
        b = Barcode(*(pdf[k].to_numpy() for k in ("cluster_id", "size_birth", "size_death", "parent", "lambda_death")))
        sizes, total = persistence_arrays(b)
        taken = diverse(peak_positions(total), sizes, total, b, threshold, most)
        return pd.DataFrame({"place": np.arange(len(taken)), "size": sizes[taken], "persistence": total[taken]})

    return in_one_task(bars, kernel, "place long, size double, persistence double", ["cluster_id"])


def active_clusters(bars: DataFrame, size: float) -> DataFrame:
    return bars.where((F.col("size_birth") <= size) & (F.col("size_death") > size)).select(F.col("cluster_id").alias("cluster"))


ASSIGNED = "layer int, id long, label long, strength double, persistence double"


def cluster_layers(link: DataFrame, min_size: int, threshold: float = 0.2, max_layers: int = 10) -> DataFrame:
    """(layer, id, label, strength, persistence): all layers of a dendrogram, finest first."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf) + 1
        if not len(pdf):
            return pd.DataFrame()
        found = layers_arrays(condense_arrays(*_arrays(pdf), min_size), n, min_size, threshold, max_layers)
        return pd.concat([pd.DataFrame({"layer": np.int32(k), "id": np.arange(n), "label": labels, "strength": strengths, "persistence": p}) for k, (labels, strengths, p) in enumerate(found)])

    if min_size < 2:
        raise ValueError("clusters need at least two points")
    return in_one_task(link, kernel, ASSIGNED, _LINK)


def search_n_clusters(link: DataFrame, target: int) -> DataFrame:
    """One layer with about ``target`` clusters, by bisection over the minimum cluster size."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame()
        labels, strengths = search_arrays(*_arrays(pdf), target)
        return pd.DataFrame({"layer": np.int32(0), "id": np.arange(len(labels)), "label": labels, "strength": strengths, "persistence": 0.0})

    return in_one_task(link, kernel, ASSIGNED, _LINK)
