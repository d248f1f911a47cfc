"""In-memory neighbour indexes over one bounded block of vectors (NumPy).

All take unit or raw vectors and answer with Euclidean distances; the caller maps the cosine
metric to unit vectors. ``query`` returns flat arrays (query number, block row); the caller
ranks them by exact distances, so an index only has to propose candidates.
"""

from __future__ import annotations

import heapq
from dataclasses import replace

import numpy as np

from tessera.params import NearestNeighbourParams


#: Distances held at a time.
PAIRS = 1 << 21
#: Rows on which a method's budget is tried, and what is asked there beyond the least recall.
TRIED, MARGIN = 128, 0.04


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)[None, :]
    return np.maximum(d, 0, out=d)


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in lists]
    return np.repeat(np.arange(len(lists)), sizes), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)


def _slack(q: np.ndarray) -> np.ndarray:
    return 1e-9 * (1 + (q * q).sum(1))  # products round; exact distances decide later


def every(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of every row whose distance is not above the k-th smallest, in pieces."""
    if len(x) <= k:
        return _flat([np.arange(len(x))] * len(q))
    step, found = max(1, PAIRS // len(x)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, len(q), step):
        d = squared(q[a : a + step], x)
        at, row = np.nonzero(d <= (np.partition(d, k - 1, axis=1)[:, k - 1] + _slack(q[a : a + step]))[:, None])
        found.append((at + a, row))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre, in pieces."""
    step = max(1, PAIRS // max(1, len(c)))
    return np.concatenate([np.zeros(0, np.int64), *(squared(x[a : a + step], c).argmin(1) for a in range(0, len(x), step))])


def centres(x: np.ndarray, n_list: int, seed: int, rounds: int = 12, sample: int = 20_000) -> np.ndarray:
    """Lloyd's centres from a bounded sample."""
    rng = np.random.default_rng(seed)
    s = x[np.sort(rng.choice(len(x), sample, replace=False))] if len(x) > sample else x
    c = s[np.sort(rng.choice(len(s), min(n_list, len(s)), replace=False))]
    for _ in range(rounds):
        near = nearest(s, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, s)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def tried(x: np.ndarray, k: int, seed: int, most: int = TRIED) -> tuple[np.ndarray, np.ndarray]:
    """A bounded sample of rows and, as (place in the sample, row), the k - 1 true neighbours of each in the block."""
    some = np.sort(np.random.default_rng((seed, 1)).choice(len(x), min(len(x), most), replace=False))
    step, near = max(1, PAIRS // len(x)), []
    for a in range(0, len(some), step):
        d = squared(x[some[a : a + step]], x)
        d[np.arange(len(d)), some[a : a + step]] = np.inf
        near.append(np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x)) - 1])
    return some, np.concatenate(near)


class Exhaustive:
    """Every row whose distance is not above the k-th smallest."""

    #: Queries answered at a time.
    together = 512

    def __init__(self, x: np.ndarray, params: NearestNeighbourParams, seed: int, k: int):
        self.x = x

    def query(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return every(q, self.x, k)

    def raise_budget(self, name: str, params: NearestNeighbourParams, seed: int, k: int) -> None:
        """Double the budget until a sample of the rows finds its true neighbours."""
        if params.least_recall <= 0 or len(self.x) <= k:
            return
        some, near = tried(self.x, k, seed)
        while getattr(self, name) < self.enough():
            at, row = self.query(self.x[some], k)
            share = np.isin(np.repeat(np.arange(len(some)), near.shape[1]) * len(self.x) + near.ravel(), at * len(self.x) + row).mean()
            if share >= min(1, params.least_recall + MARGIN):
                return
            setattr(self, name, 2 * getattr(self, name))


class Lists(Exhaustive):
    """Rows by their nearest centre; the search compares parts of lists with groups of queries.

    A list is ordered by distance to its centre and cut into parts, rings around the centre. Each query first sees
    the parts around it until they hold k rows, which bounds its k-th distance; then every part it may see that may hold
    a nearer row is compared with all queries that can't rule it out, as one matrix product.
    """

    PART = 4096

    def __init__(self, x: np.ndarray, params: NearestNeighbourParams, seed: int, k: int):
        self._file(x, params.n_list or max(1, int(np.sqrt(len(x)))), seed)

    def _file(self, x: np.ndarray, n_list: int, seed: int) -> None:
        self.x = x
        self.c = centres(x, n_list, seed)
        self.near = nearest(x, self.c)
        self.size = np.bincount(self.near, minlength=len(self.c))
        r = np.sqrt(((x - self.c[self.near]) ** 2).sum(1))
        order = np.lexsort((r, self.near))
        parts, centre = [], []
        for j, end in enumerate(np.cumsum(self.size)):
            for a in range(end - self.size[j], end, self.PART):
                parts.append(order[a : min(a + self.PART, end)])
                centre.append(j)
        self.parts, self.centre = parts, np.array(centre, int)
        self.low, self.high = (np.array([r[p[e]] for p in parts]) for e in (0, -1))
        self.part_size = np.array([len(p) for p in parts])
        self.together = max(16, min(512, (1 << 22) // max(1, len(parts))))

    def _among(self, q: np.ndarray, k: int, lists: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows not above each query's k-th smallest distance, among the ``lists`` it may see."""
        slack = _slack(q)
        away = np.sqrt(squared(q, self.c))[:, self.centre]
        bound = np.maximum(np.maximum(away - self.high, self.low - away), 0)
        may = np.ones(bound.shape, dtype=bool) if lists is None else lists[:, self.centre]
        order = np.argsort(np.where(may, away + bound, np.inf), axis=1, kind="stable")
        reached = np.cumsum(self.part_size[order], axis=1)
        early = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(early, order, reached < k, axis=1)
        last = np.minimum((reached < k).sum(1), len(self.parts) - 1)
        early[np.arange(len(q)), order[np.arange(len(q)), last]] = True
        # squared distances less the query's own square, so that one product gives them
        own = (q * q).sum(1)
        wide = np.concatenate([q, np.ones((len(q), 1))], axis=1)
        best = np.full((len(q), k), np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        least = np.ascontiguousarray((np.maximum(bound - 1e-6 * (1 + away), 0) ** 2 - own[:, None]).T)
        factors, ends = self._factors(), np.cumsum(self.part_size)
        for turn in (early & may, ~early & may):
            for j, asked in enumerate(np.ascontiguousarray(turn.T)):
                who = np.flatnonzero(asked & (least[j] <= best[:, -1] + slack))
                if not len(who):
                    continue
                d = (wide if len(who) == len(q) else wide[who]) @ factors[ends[j] - self.part_size[j] : ends[j]].T
                low = d.min(1)
                if len(better := np.flatnonzero(low < best[who, -1])):
                    best[who[better]] = np.sort(np.partition(np.concatenate([best[who[better]], d[better]], axis=1), k - 1, axis=1)[:, :k], axis=1)
                hit = np.flatnonzero(low <= best[who, -1] + slack[who])
                if not len(hit):
                    continue
                who, d = who[hit], d[hit]
                at, row = np.nonzero(d <= (best[who, -1] + slack[who])[:, None])
                found.append((who[at], self.parts[j][row], d[at, row]))
        at, row, d = (np.concatenate([f[c] for f in found]) for c in range(3))
        keep = d <= best[at, -1] + slack[at]
        return at[keep], row[keep]

    def _factors(self) -> np.ndarray:
        """Rows in the order of the parts as (-2 x, x squared); made where the index is searched, not written with it."""
        if "made" not in self.__dict__:
            x = self.x[np.concatenate([*self.parts, np.zeros(0, np.int64)]).astype(np.int64)]
            self.made = np.concatenate([-2 * x, (x * x).sum(1)[:, None]], axis=1)
        return self.made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "made"}


class KmKnn(Lists):
    """Exact: a query may see all lists; parts are skipped when the triangle rules out all of their rows."""

    def query(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self._among(q, k)


class Ivf(Lists):
    """The rows of the lists nearest to the query.

    Unless their number is given, it is the least that finds the true neighbours of a sample of the rows.
    """

    def __init__(self, x: np.ndarray, params: NearestNeighbourParams, seed: int, k: int):
        super().__init__(x, params, seed, k)
        self.probes = min(params.n_probes or max(1, int(np.sqrt(len(self.c)))), len(self.c))
        if not params.n_probes and params.least_recall > 0 and len(x) > k > 1:
            some, near = tried(x, k, seed)
            place = np.argsort(np.argsort(squared(x[some], self.c), axis=1, kind="stable"), axis=1)
            needed = place[np.arange(len(some))[:, None], self.near[near]] + 1
            self.probes = max(self.probes, int(np.quantile(needed, min(1, params.least_recall + MARGIN), method="higher")))

    def query(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.probes >= len(self.c):
            return self._among(q, k)
        lists = np.zeros((len(q), len(self.c)), dtype=bool)
        np.put_along_axis(lists, np.argsort(squared(q, self.c), axis=1, kind="stable")[:, : self.probes], True, axis=1)
        return self._among(q, k, lists)


class Forest(Exhaustive):
    """Trees of random hyperplanes, searched by margin until the budget is spent.

    A tree is a few flat arrays: a node's plane lies between two rows, its children are nodes, a leaf is a range of the
    tree's order of rows. Unless the budget is given, it is doubled until it finds the true neighbours of a sample.
    Many queries are answered together: the margins of all leaves come from one product with the planes, and a leaf is
    compared with all queries that take it as one more. So leaves grow with the block, and there are some hundred a tree.
    """

    together = 8192
    #: Queries whose margins are held, further rows whose exact distances decide, candidates that are held at a time.
    MARGINS, SPARE, HELD = 128, 8, 1 << 20

    def __init__(self, x: np.ndarray, params: NearestNeighbourParams, seed: int, k: int, leaf: int | None = None):
        self.x = x
        self.budget = params.search_budget or k * params.n_tree
        self.trees = [self._grow(np.random.default_rng((seed, t)), leaf or max(k, 16, len(x) >> 8)) for t in range(params.n_tree)]
        if not params.search_budget:
            self.raise_budget("budget", params, seed, k)

    def _grow(self, rng: np.random.Generator, leaf: int) -> tuple[np.ndarray, ...]:
        order = np.arange(len(self.x), dtype=np.int32)
        pair, cut, child = [], [], []  # of a leaf: pair is (-1, -1), child its range
        todo = [(0, len(order), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(pair)
            if parent >= 0:
                child[parent][side] = node
            pair.append((-1, -1))
            cut.append(0.0)
            child.append([a, b])
            for _ in range(5 if b - a > leaf else 0):
                rows = order[a:b]
                u, v = rng.choice(rows, 2, replace=False)
                normal = self.x[u] - self.x[v]
                at = (self.x[u] + self.x[v]) @ normal / 2
                left = self.x[rows] @ normal < at
                n = int(left.sum())
                if 0 < n < len(rows):  # else copies of one vector
                    pair[node], cut[node] = (u, v), at
                    order[a:b] = np.concatenate([rows[left], rows[~left]])
                    todo += [(a + n, b, node, 1), (a, a + n, node, 0)]
                    break
        return np.array(pair, np.int32), np.array(cut), np.array(child, np.int32), order

    def enough(self) -> int:
        return len(self.x) * len(self.trees)

    def query(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.budget >= self.enough():  # all leaves of a tree are all rows
            return every(q, self.x, k)
        made, n = self._planes(), len(self.x)
        factors, ends, rows = made["factors"], made["ends"], made["rows"]
        size = np.diff(ends, prepend=0)
        x = q - made["mean"]
        parts = [self._taken(x[a : a + self.MARGINS], size) for a in range(0, len(q), self.MARGINS)]
        who = np.concatenate([np.zeros(0, np.int32), *(at + np.int32(i * self.MARGINS) for i, (at, _) in enumerate(parts))])
        leaf = np.concatenate([np.zeros(0, np.int32), *(leaf for _, leaf in parts)])
        del parts
        order = np.argsort(leaf, kind="stable")
        who, first = who[order], np.searchsorted(leaf[order], np.arange(len(size) + 1))
        own, wide = (x * x).sum(1), np.concatenate([x, np.ones((len(q), 1))], axis=1)
        # squared distances are told apart by this much, so that equal ones are ordered by their rows
        grain = 1e-11 * (1 + own + made["most"])
        most, kept = np.full(len(q), np.inf), min(k + self.SPARE, n)
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float))
        held, count, flush = [best], 0, set((made["roots"].searchsorted(1 << np.arange(1, 6))).tolist())
        for j in range(len(size)):
            at = who[first[j] : first[j + 1]]
            if len(at):
                row = rows[ends[j] - size[j] : ends[j]]
                d = wide[at] @ factors[row].T + own[at][:, None]
                limit = most[at]
                if len(row) > kept and len(free := np.flatnonzero(np.isinf(limit))):
                    limit[free] = np.partition(d[free], kept - 1, axis=1)[:, kept - 1]
                i, c = np.nonzero(d <= limit[:, None])
                held.append((at[i].astype(np.int64), row[c].astype(np.int64), d[i, c]))
                count += len(i)
            if count > self.HELD or j in flush or j == len(size) - 1:
                at, row, d = (np.concatenate([h[c] for h in held]) for c in range(3))
                _, once = np.unique(at * n + row, return_index=True)  # trees share rows
                at, row, d = at[once], row[once], np.rint(np.maximum(d[once], 0) / grain[at[once]]) * grain[at[once]]
                by = np.lexsort((row, d, at))
                rank = np.arange(len(at)) - np.searchsorted(at[by], at[by])
                last = by[rank == kept - 1]
                most[at[last]] = d[last] + grain[at[last]]
                by = by[rank < kept]
                held, count = [(at[by], row[by], d[by])], 0
        return held[0][0], held[0][1]

    def _taken(self, q: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of queries less the mean: leaves by margin until their rows are the budget."""
        made = self._planes()
        planes = made["normals"] @ q.astype(np.float32).T - made["cuts"][:, None]
        margin, a = np.zeros((made["nodes"], len(q)), np.float32), 0
        for node, left, right in made["levels"]:
            d, above = planes[a : a + len(node)], margin[node]
            margin[left], margin[right] = np.maximum(above, d), np.maximum(above, -d)
            a += len(node)
        margin = np.ascontiguousarray(margin[made["leaves"]].T)
        some = min(len(size), int(1.25 * self.budget / size.mean()) + 8)
        while True:
            near = np.argpartition(margin, some - 1, axis=1)[:, :some] if some < len(size) else np.tile(np.arange(len(size)), (len(q), 1))
            if some == len(size) or size[near].sum(1).min() >= self.budget:
                break
            some = min(len(size), 2 * some)
        near = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(margin, near, axis=1)), axis=1), axis=1)
        at, place = np.nonzero(np.cumsum(size[near], axis=1) - size[near] < self.budget)
        return at.astype(np.int32), near[at, place].astype(np.int32)

    def _planes(self) -> dict:
        """All trees as one, their planes by level; made where the index is searched, not written with it."""
        if "made" in self.__dict__:
            return self.made
        starts = np.cumsum([0, *(len(t[0]) for t in self.trees)])
        pair, child = (np.concatenate([t[c] for t in self.trees]) for c in (0, 2))
        inner = pair[:, 0] >= 0
        child = child + np.where(inner, np.repeat(starts[:-1], np.diff(starts)), 0)[:, None]
        levels, now = [], starts[:-1]
        while len(now := now[inner[now]]):
            levels.append((now, child[now, 0], child[now, 1]))
            now = child[now].ravel()
        by = np.concatenate([np.zeros(0, np.int64), *(node for node, _, _ in levels)])
        leaves = np.flatnonzero(~inner)
        tree = np.searchsorted(starts, leaves, "right") - 1
        mean = self.x.mean(0)
        x = self.x - mean
        square = (x * x).sum(1)
        u, v = x[pair[by, 0]], x[pair[by, 1]]
        self.made = {
            "normals": (u - v).astype(np.float32), "cuts": (((u + v) * (u - v)).sum(1) / 2).astype(np.float32), "levels": levels, "nodes": starts[-1], "leaves": leaves,
            "ends": np.cumsum(child[leaves, 1] - child[leaves, 0]), "rows": np.concatenate([self.trees[t][3][a:b] for t, (a, b) in zip(tree, child[leaves], strict=True)]),
            "roots": tree, "mean": mean, "most": square.max(), "factors": np.concatenate([-2 * x, square[:, None]], axis=1),
        }
        return self.made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "made"}


class BallTree(Lists):
    """Balls around pivots, taken by their least possible distance, then by their pivot's, until the budget is spent.

    The budget is a share of the rows, raised until it finds the true neighbours of a sample.
    """

    def __init__(self, x: np.ndarray, params: NearestNeighbourParams, seed: int, k: int):
        self._file(x, max(1, len(x) // 16), seed)
        self.radius = np.zeros(len(self.c))
        np.maximum.at(self.radius, self.centre, self.high)
        self.budget = max(int(len(x) * params.bt_budget), k + 1)
        if params.least_recall > 0 and len(x) > k > 1:
            some, near = tried(x, k, seed)
            order, before = self._order(x[some])
            place = np.argsort(order, axis=1)
            needed = np.take_along_axis(before, place[np.arange(len(some))[:, None], self.near[near]], axis=1) + 1
            self.budget = max(self.budget, int(np.quantile(needed, min(1, params.least_recall + MARGIN), method="higher")))

    def _order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's balls in their order, and the rows of those before."""
        centre = squared(q, self.c)
        order = np.lexsort((centre, np.maximum(np.sqrt(centre) - self.radius, 0)), axis=1)
        size = self.size[order]
        return order, np.cumsum(size, axis=1) - size

    def query(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.budget >= len(self.x):
            return self._among(q, k)
        order, before = self._order(q)
        lists = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(lists, order, before < self.budget, axis=1)
        return self._among(q, k, lists)


class _Graph(Exhaustive):
    """Best-first search over neighbour lists.

    A beam as wide as the block ends only when it has seen all that can be reached, and links are added until that is
    every row; unless its width is given, it is doubled until it finds the true neighbours of a sample.
    """

    ef: int

    def enough(self) -> int:
        return len(self.x)

    def _beam(self, v: np.ndarray, entry: list[int], links, ef: int) -> list[tuple[float, int]]:
        seen = set(entry)
        d0 = ((self.x[entry] - v) ** 2).sum(1)
        todo = [(float(d), e) for d, e in zip(d0, entry, strict=True)]
        best = [(-d, e) for d, e in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, e = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in links[e] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip(((self.x[new] - v) ** 2).sum(1).tolist(), new, strict=True):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(todo, (dj, j))
                    heapq.heappush(best, (-dj, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, e) for d, e in best)

    def _near(self, beam: list[tuple[float, int]], k: int) -> np.ndarray:
        """A beam's rows up to its k-th, and those as far."""
        last = beam[min(k, len(beam)) - 1][0]
        return np.array([e for d, e in beam if d <= last + 1e-9 * (1 + last)], dtype=np.int64)

    def _reach(self, links, start: int) -> None:
        """Link each row that can't be reached from ``start`` with the nearest that can, both ways."""
        n = len(self.x)
        seen, at = np.zeros(n, dtype=bool), 0
        todo = [start]
        while True:
            for e in todo:
                seen[e] = True
            while todo:
                for j in links[todo.pop()]:
                    if not seen[j]:
                        seen[j] = True
                        todo.append(j)
            while at < n and seen[at]:
                at += 1
            if at == n:
                return
            known = np.flatnonzero(seen)
            near = int(known[squared(self.x[at : at + 1], self.x[known])[0].argmin()])
            links[near].append(at)
            links[at].append(near)
            todo = [at]


class Hnsw(_Graph):
    """Layers of small-world graphs, built by insertion in row order."""

    def __init__(self, x: np.ndarray, params: NearestNeighbourParams, seed: int, k: int):
        self.x, self.m, self.ef = x, params.m, max(params.ef_search, k)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(rng.random(len(x)) + 1e-300) / np.log(max(self.m, 2))).astype(int)
        self.layers: list[dict[int, list[int]]] = [{} for _ in range(level.max(initial=0) + 1)]
        self.entry = -1
        top = -1
        for i in range(len(x)):
            near = [self.entry] if i else []
            for layer in range(top, level[i], -1):
                near = [self._beam(x[i], near, self.layers[layer], 1)[0][1]]
            for layer in range(level[i], -1, -1):
                graph = self.layers[layer]
                graph[i] = []
                if layer > top or not near:
                    continue
                found = self._beam(x[i], near, graph, params.ef_construction)
                near = [e for _, e in found if e != i]
                for e in near[: self.m]:
                    graph[i].append(e)
                    graph[e].append(i)
                    most = 2 * self.m if layer == 0 else self.m
                    if len(graph[e]) > most:
                        d = ((x[graph[e]] - x[e]) ** 2).sum(1)
                        graph[e] = [graph[e][j] for j in np.argsort(d, kind="stable")[:most]]
            if level[i] > top:
                top, self.entry = level[i], i
        self._reach(self.layers[0], self.entry)
        if params.ef_search == NearestNeighbourParams.ef_search:
            self.raise_budget("ef", params, seed, k)

    def query(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.ef >= len(self.x):  # such a beam ends with every row
            return every(q, self.x, k)
        found = []
        for v in q:
            near = [self.entry]
            for graph in self.layers[:0:-1]:
                near = [self._beam(v, near, graph, 1)[0][1]]
            found.append(self._near(self._beam(v, list({*near, self.entry}), self.layers[0], max(self.ef, k)), k))
        return _flat(found)


class NnDescent(_Graph):
    """Neighbour lists improved by neighbours of neighbours until few change.

    The lists begin with the nearest rows in the leaves of a few random trees. In each round a row meets the neighbours
    of those in its list and of those that list it (the nearest ``HEAD`` of each), as far as either entry is new.
    """

    TREES, LEAF, ROWS, HEAD = 8, 64, 256, 12

    def __init__(self, x: np.ndarray, params: NearestNeighbourParams, seed: int, k: int):
        self.x = x
        n = len(x)
        size = min(params.k_build or max(2 * k, 20), n - 1) if n > 1 else 0
        self.ef = params.ef_budget or params.beam_width or 2 * max(k + 1, size, 16)
        rng = np.random.default_rng(seed)
        near, dist = np.tile(np.arange(n)[:, None], (1, size)), np.full((n, size), np.inf, np.float32)  # itself: no neighbour yet
        small = x.astype(np.float32)  # lists only propose: the search compares exact distances
        trees = Forest(x, replace(params, n_tree=self.TREES if size else 0, search_budget=1), seed, k, max(self.LEAF, size + 1)).trees
        for pair, _, child, order in trees:
            for a, b in child[pair[:, 0] < 0].tolist():
                for c in range(a, b, self.ROWS):  # copies of one vector make large leaves: each row meets those around it
                    some = order[c : c + self.ROWS]
                    other = order[max(a, c - self.LEAF) : c + self.ROWS + self.LEAF] if b - a > self.ROWS else some
                    self._meet(small, some, np.tile(other, (len(some), 1)), near, dist)
        new = np.ones(near.shape, dtype=bool)
        for _ in range(30 if size else 0):
            before = near.copy()
            # those that list a row, the nearest ones first, as many as a list has at most
            row = np.repeat(np.arange(n), size)
            by = np.lexsort((dist.ravel(), near.ravel()))
            to = near.ravel()[by]
            rank = np.arange(len(to)) - np.searchsorted(to, to)
            keep = rank < size
            back, back_new = np.tile(np.arange(n)[:, None], (1, size)), np.zeros((n, size), dtype=bool)
            back[to[keep], rank[keep]] = row[by[keep]]
            back_new[to[keep], rank[keep]] = new.ravel()[by[keep]]
            pool, pool_new = np.concatenate([near, back], axis=1), np.concatenate([new, back_new], axis=1)
            for a in range(0, n, self.ROWS):
                mine, fresh = pool[a : a + self.ROWS], pool_new[a : a + self.ROWS]
                cand = np.where(fresh[:, :, None] | new[mine, : self.HEAD], before[mine, : self.HEAD], np.arange(a, a + len(mine))[:, None, None]).reshape(len(mine), -1)
                cand = np.sort(np.concatenate([np.where(back_new[a : a + self.ROWS], back[a : a + self.ROWS], mine[:, :size]), cand], axis=1), axis=1)
                first = np.concatenate([np.ones((len(cand), 1), dtype=bool), cand[:, 1:] != cand[:, :-1]], axis=1)
                at, slot = np.nonzero(first & (cand != np.arange(a, a + len(cand))[:, None]))
                wide = np.tile(np.arange(a, a + len(cand))[:, None], (1, int(np.bincount(at, minlength=1).max(initial=0))))
                wide[at, np.arange(len(at)) - np.searchsorted(at, at)] = cand[at, slot]
                self._meet(small, np.arange(a, a + len(cand)), wide, near, dist)
            new = ~(near[:, :, None] == before[:, None, :]).any(2) if n * size * size <= PAIRS else np.concatenate([~(near[a : a + self.ROWS, :, None] == before[a : a + self.ROWS, None, :]).any(2) for a in range(0, n, self.ROWS)])
            if new.sum() <= params.delta * n * size:
                break
        links: list[set[int]] = [set(r.tolist()) - {i} for i, r in enumerate(near)]
        for i, r in enumerate(near):
            for j in r.tolist():
                if j != i:
                    links[j].add(i)
        self.links = [sorted(s) for s in links]
        if n:
            self._reach(self.links, 0)
        # lists of far groups don't meet, so a search begins at the nearest of many spread rows
        self.entries = np.sort(rng.choice(n, min(n, max(64, 2 * int(n**0.5))), replace=False))
        self.begin = params.n_entry_points or 8
        if not (params.ef_budget or params.beam_width):
            self.raise_budget("ef", params, seed, k)

    def _meet(self, small: np.ndarray, rows: np.ndarray, cand: np.ndarray, near: np.ndarray, dist: np.ndarray) -> None:
        """Better the lists of ``rows`` by their candidates, a row of ``cand`` for each; itself stands for none."""
        size = near.shape[1]
        step = max(1, PAIRS // 8 // max(1, cand.shape[1] * small.shape[1]))
        for a in range(0, len(rows), step):
            r, c = rows[a : a + step], cand[a : a + step]
            gap = small[c]
            gap -= small[r][:, None]
            d = np.einsum("ijk,ijk->ij", gap, gap)
            d[c == r[:, None]] = np.inf
            if c.shape[1] > size:
                by = np.argpartition(d, size - 1, axis=1)[:, :size]
                c, d = np.take_along_axis(c, by, axis=1), np.take_along_axis(d, by, axis=1)
            c, d = np.concatenate([near[r], c], axis=1), np.concatenate([dist[r], d], axis=1)
            by = np.argsort(c, axis=1, kind="stable")  # a row that is there twice counts once
            c, d = np.take_along_axis(c, by, axis=1), np.take_along_axis(d, by, axis=1)
            d[:, 1:][c[:, 1:] == c[:, :-1]] = np.inf
            by = np.argsort(d, axis=1, kind="stable")[:, :size]
            c, d = np.take_along_axis(c, by, axis=1), np.take_along_axis(d, by, axis=1)
            near[r], dist[r] = np.where(np.isinf(d), r[:, None], c), d

    def query(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.ef >= len(self.x):  # such a beam ends with every row
            return every(q, self.x, k)
        near = np.argsort(squared(q, self.x[self.entries]), axis=1, kind="stable")[:, : self.begin]
        return _flat([self._near(self._beam(v, self.entries[b].tolist(), self.links, max(self.ef, k)), k) for v, b in zip(q, near, strict=True)])


INDEXES = {"exhaustive": Exhaustive, "kmknn": KmKnn, "ivf": Ivf, "annoy": Forest, "hnsw": Hnsw, "nndescent": NnDescent, "balltree": BallTree}
