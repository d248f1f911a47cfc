"""The engine's queries over the synthetic tables, and the SQL that must give the same rows.

Every query reads all rows of ``embeddings``. Numbers are rounded to 6 digits and ties have an order.
Stages that follow the layout take the first ``LOW`` of each vector's 64 dimensions as a stand-in for
one, except ``linkage_mst``, ``descendants_mst`` and ``barcode_mst``. The dendrogram stages take as input the tree that joins each vector with the next
(``chain``), whose merges SQL can express as intervals, and, under names in ``_mst``, the spanning tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fuzzy, labelprop, sparse, tree
from tessera.operators.components import component_sizes, connected_components
from tessera.operators.embedding import attract_step, node_embedding
from tessera.operators.knn import knn, nested
from tessera.operators.mst import core_distance, descendants, knn_lowdim, linkage, mst, mutual_reachability, nearest_other_component
from tessera.params import ClusterParams, EmbeddingParams, NearestNeighbourParams
from tessera.plans.cluster import best_layer, cluster, cluster_accuracy, cluster_gpu, layers_of, n_clusters
from tessera.runtime import cut
from tessera.sources.vectors import read_vectors

K, MIN_SAMPLES, MIN_SIZE, LOW, PARTS, AT_SIZE = 15, 5, 3, 4, 40, 4.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(column: str) -> Column:
    return F.round(F.col(column), 6).alias(column)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_vectors(spark, f"{sf_dir}/embeddings.parquet")


def _low(df: DataFrame) -> DataFrame:
    """The first dimensions of each vector as a low-dimensional layout."""
    return df.select("id", F.slice("embedding", 1, LOW).alias("embedding"))


def _wide(df: DataFrame, column: str = "pos") -> DataFrame:
    return df.select("id", F.posexplode(column).alias("c", "v")).select("id", F.col("c").cast("long").alias("c"), r6("v"))


def _graph(df: DataFrame) -> DataFrame:
    return fuzzy.fuzzy_simplicial_set(knn(df, K, "exhaustive"), K)


def _matrix(df: DataFrame) -> DataFrame:
    return cut(_graph(df).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v")))


def _ijv(df: DataFrame) -> DataFrame:
    return df.select("i", "j", r6("v"))


def _seeds(df: DataFrame) -> DataFrame:
    label = F.when((F.col("id") * 7919 + 17) % 5 == 0, F.col("id") % PARTS).otherwise(F.lit(-1))
    return df.select("id", label.cast("long").alias("label"))


def _parts(df: DataFrame) -> DataFrame:
    return df.select("id", (F.col("id") % PARTS).cast("long").alias("label"))


def chain(df: DataFrame) -> DataFrame:
    """(u, v, w): each vector joined with the one of the next id."""
    from tessera.functions.vectors import euclidean

    after = df.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("y"))
    return df.join(after, "id").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), euclidean(F.col("embedding"), F.col("y")).alias("w"))


def _condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tree.condense_tree(linkage(chain(_vectors(spark, sf_dir))), MIN_SIZE))


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tree.barcode(_condensed(spark, sf_dir), MIN_SIZE))


# --- SQL building blocks ------------------------------------------------------------------------

_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_P = "p AS (SELECT a.id AS src, b.id AS dst, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.id <> b.id)"


def _nn(k: int, name: str = "k", source: str = "p") -> str:
    return f"{name} AS (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM {source} QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= {k})"


_SIGMA = f"""
l AS (SELECT src, list(d ORDER BY rank) AS ds, min(d) AS rho FROM k GROUP BY src),
s AS (
  SELECT src, ds, rho, 0 AS it, CAST(0 AS DOUBLE) AS lo, CAST(1.7976931348623157e308 AS DOUBLE) AS hi, CAST(1 AS DOUBLE) AS mid, false AS done FROM l
  UNION ALL
  SELECT src, ds, rho, it + 1,
    CASE WHEN hit OR val > log2({K}) THEN lo ELSE mid END,
    CASE WHEN hit OR val <= log2({K}) THEN hi ELSE mid END,
    CASE WHEN hit THEN mid WHEN val > log2({K}) THEN (lo + mid) / 2 WHEN hi = 1.7976931348623157e308 THEN mid * 2 ELSE (mid + hi) / 2 END,
    hit
  FROM (SELECT *, abs(val - log2({K})) < 1e-5 AS hit FROM (SELECT *, list_sum(list_transform(ds, lambda x: exp(-greatest(x - rho, 0) / mid))) AS val FROM s WHERE it < 64 AND NOT done))
),
b AS (SELECT src, arg_max(mid, it) AS sigma, any_value(rho) AS rho FROM s GROUP BY src)"""
_EDGES = "e AS (SELECT k.src, k.dst, CASE WHEN sigma > 0 THEN exp(-greatest(d - rho, 0) / sigma) WHEN d > rho THEN 0 ELSE 1 END AS w FROM k JOIN b ON b.src = k.src)"
_SYM = """g AS (SELECT * FROM (SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst,
  coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(a.w, 0) * coalesce(b.w, 0) AS w
  FROM e a FULL OUTER JOIN e b ON a.src = b.dst AND a.dst = b.src) WHERE w > 0)"""
_GRAPH = f"WITH RECURSIVE {_V}, {_P}, {_nn(K)}, {_SIGMA}, {_EDGES}, {_SYM}, m AS (SELECT src AS i, dst AS j, w AS v FROM g)"
_SEEDS = f"z AS (SELECT id, CASE WHEN (id * 7919 + 17) % 5 = 0 THEN id % {PARTS} ELSE -1 END AS label FROM v)"
_PARTS = f"z AS (SELECT id, id % {PARTS} AS label FROM v), n AS (SELECT label, count(*) AS n FROM z GROUP BY label)"
_CELLS = "c AS (SELECT id, unnest(range(len(x))) AS c, unnest(x) AS v FROM v)"

# the dendrogram of a chain: the merge at an edge spans the widest interval around it without a later edge
_SIZE = "t AS (SELECT count(*) AS n, min(id) AS a, max(id) AS z FROM v)"
_CHAIN = f"""{_SIZE},
e AS (SELECT a.id - t.a AS i, list_distance(a.x, b.x) AS w, row_number() OVER (ORDER BY list_distance(a.x, b.x), a.id) - 1 AS r FROM v a JOIN v b ON b.id = a.id + 1, t),
lo AS (SELECT e.i, coalesce(max(f.i) + 1, 0) AS lo FROM e LEFT JOIN e f ON f.i < e.i AND f.r > e.r GROUP BY e.i),
hi AS (SELECT e.i, coalesce(min(f.i), any_value(t.n) - 1) AS hi FROM t, e LEFT JOIN e f ON f.i > e.i AND f.r > e.r GROUP BY e.i),
d AS (SELECT e.i, e.w, e.r, t.n + e.r AS id, lo.lo, hi.hi, hi.hi - lo.lo + 1 AS size, e.i - lo.lo + 1 AS size_a, hi.hi - e.i AS size_b
      FROM t, e JOIN lo ON lo.i = e.i JOIN hi ON hi.i = e.i),
sa AS (SELECT d.id, coalesce(max(f.id), any_value(d.i)) AS a FROM d LEFT JOIN d f ON f.i >= d.lo AND f.i < d.i GROUP BY d.id),
sb AS (SELECT d.id, coalesce(max(f.id), any_value(d.i) + 1) AS b FROM d LEFT JOIN d f ON f.i > d.i AND f.i < d.hi GROUP BY d.id),
nodes AS (SELECT d.id, d.w, d.lo, d.hi, d.size, d.size_a, d.size_b, sa.a, sb.b FROM d JOIN sa ON sa.id = d.id JOIN sb ON sb.id = d.id),
leaves AS (SELECT unnest(range(n)) AS leaf, unnest(range(n)) AS place FROM t)"""

# the spanning tree by growing it: edges have a unique rank, the state is each point's least rank to the tree
_TAKEN, _FAR = 9_000_000_000, 8_000_000_000
_MST = f"""{_SIZE}, {_P}, {_nn(MIN_SAMPLES, "k5")}, core AS (SELECT src AS id, max(d) AS core FROM k5 GROUP BY src),
er AS MATERIALIZED (SELECT src AS u, dst AS v, greatest(d, a.core, b.core) AS w, row_number() OVER (ORDER BY greatest(d, a.core, b.core), src, dst) AS r FROM p JOIN core a ON a.id = src JOIN core b ON b.id = dst WHERE src < dst),
pos AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM v),
mat AS MATERIALIZED (SELECT a.k, list(coalesce(er.r, {_FAR}) ORDER BY b.k) AS rs FROM pos a CROSS JOIN pos b LEFT JOIN er ON er.u = least(a.id, b.id) AND er.v = greatest(a.id, b.id) GROUP BY a.k),
grow AS (
  SELECT 1 AS step, list_transform(rs, lambda x, i: CASE WHEN i = 1 THEN {_TAKEN} ELSE x END) AS best, CAST(NULL AS BIGINT) AS r FROM mat WHERE k = 1
  UNION ALL
  SELECT q.step + 1, list_transform(list_zip(q.best, mat.rs), lambda x, i: CASE WHEN x[1] = {_TAKEN} OR i = q.j THEN {_TAKEN} ELSE least(x[1], x[2]) END), q.m
  FROM (SELECT step, best, list_min(best) AS m, list_position(best, list_min(best)) AS j FROM grow WHERE step < (SELECT n FROM t)) q JOIN mat ON mat.k = q.j),
mst AS MATERIALIZED (SELECT er.u, er.v, er.w, er.r FROM grow JOIN er ON er.r = grow.r)"""
# its dendrogram: each edge in turn gives both sides the merge's name; leaves are laid out from the root down
_REAL = f"""{_MST},
ord AS MATERIALIZED (SELECT row_number() OVER (ORDER BY mst.r) - 1 AS s, a.k AS i, b.k AS j, mst.w FROM mst JOIN pos a ON a.id = mst.u JOIN pos b ON b.id = mst.v),
kr AS MATERIALIZED (
  SELECT -1 AS s, (SELECT range(n) FROM t) AS nm, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS w
  UNION ALL
  SELECT q.s, list_transform(q.nm, lambda x: CASE WHEN x = q.a OR x = q.b THEN q.id ELSE x END), q.a, q.b, q.w
  FROM (SELECT o.s, kr.nm, kr.nm[o.i] AS a, kr.nm[o.j] AS b, o.w, t.n + o.s AS id FROM kr JOIN ord o ON o.s = kr.s + 1, t) q),
sz AS (SELECT t.n + s AS id, len(list_filter(nm, lambda x: x = t.n + s)) AS size FROM kr, t WHERE s >= 0 UNION ALL SELECT unnest(range(n)), 1 FROM t),
mg AS MATERIALIZED (SELECT t.n + s AS id, kr.a, kr.b, kr.w, x.size, y.size AS size_a, z.size AS size_b FROM t, kr JOIN sz x ON x.id = (SELECT n FROM t) + kr.s JOIN sz y ON y.id = kr.a JOIN sz z ON z.id = kr.b WHERE s >= 0),
laid AS MATERIALIZED (
  SELECT 2 * n - 2 AS id, CAST(0 AS BIGINT) AS lo FROM t
  UNION ALL
  SELECT unnest([q.a, q.b]), unnest([q.lo, q.lo + q.size_a]) FROM (SELECT mg.a, mg.b, mg.size_a, laid.lo FROM laid JOIN mg ON mg.id = laid.id) q),
nodes AS MATERIALIZED (SELECT mg.id, mg.w, laid.lo, laid.lo + mg.size - 1 AS hi, mg.size, mg.size_a, mg.size_b, mg.a, mg.b FROM mg JOIN laid ON laid.id = mg.id),
leaves AS (SELECT laid.id AS leaf, laid.lo AS place FROM laid, t WHERE laid.id < t.n)"""


def _condensed_sql(m: str) -> str:
    """The condensed tree of ``nodes`` and ``leaves`` at the minimum size ``m``, and what follows from it."""
    return f"""
dn AS (SELECT *, size_a >= {m} AND size_b >= {m} AS split FROM nodes),
root AS (SELECT 2 * n - 2 AS root, n FROM t),
born AS (SELECT a AS id FROM dn WHERE split UNION SELECT b FROM dn WHERE split),
cl AS (SELECT x.id, coalesce(min(y.id), any_value(root.root)) AS cluster FROM root, dn x LEFT JOIN (SELECT * FROM dn WHERE id IN (SELECT id FROM born)) y ON y.lo <= x.lo AND y.hi >= x.hi GROUP BY x.id),
pts AS (SELECT leaves.leaf AS p, any_value(leaves.place) AS place, min(dn.id) AS node FROM leaves JOIN dn ON dn.lo <= leaves.place AND dn.hi >= leaves.place AND dn.size >= {m} GROUP BY leaves.leaf),
cond AS (
  SELECT cl.cluster AS parent, dn.a AS child, 1 / dn.w AS "lambda", dn.size_a AS child_size FROM dn JOIN cl ON cl.id = dn.id WHERE split
  UNION ALL SELECT cl.cluster, dn.b, 1 / dn.w, dn.size_b FROM dn JOIN cl ON cl.id = dn.id WHERE split
  UNION ALL SELECT cl.cluster, pts.p, 1 / dn.w, 1 FROM pts JOIN dn ON dn.id = pts.node JOIN cl ON cl.id = dn.id),
leaf AS (SELECT DISTINCT parent AS cluster FROM cond WHERE child_size = 1 AND parent NOT IN (SELECT parent FROM cond WHERE child_size > 1)),
lab AS (SELECT c.child AS id, coalesce(q.label, -1) AS label FROM cond c LEFT JOIN (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS label FROM leaf, root WHERE cluster <> root) q ON q.cluster = c.parent WHERE c.child_size = 1),
gone AS (SELECT id, least(size_a, size_b) AS death, w, a, b FROM dn WHERE split),
bars AS (
  SELECT x.id AS cluster_id, CAST(greatest({m}, coalesce(max(y.death), 0)) AS DOUBLE) AS size_birth,
    CAST(any_value(x.death) AS DOUBLE) AS size_death, any_value(x.parent) AS parent, any_value(x.lam) AS lambda_death
  FROM (SELECT k.child AS id, g2.death, k.parent, exp(-1 / k."lambda") AS lam, dn.lo, dn.hi FROM cond k JOIN gone g2 ON g2.a = k.child OR g2.b = k.child JOIN dn ON dn.id = k.child WHERE k.child_size > 1
        UNION ALL SELECT root, n, root, 0, 0, n - 1 FROM root WHERE EXISTS (SELECT 1 FROM gone)) x
  LEFT JOIN (SELECT gone.death, dn.lo, dn.hi FROM gone JOIN dn ON dn.id = gone.id) y ON y.lo >= x.lo AND y.hi <= x.hi GROUP BY x.id),
curve AS (SELECT s.size, coalesce(sum((b2.size_death - b2.size_birth) * b2.lambda_death), 0) AS persistence
  FROM (SELECT DISTINCT size_birth AS size FROM bars) s LEFT JOIN (SELECT * FROM bars WHERE cluster_id <> parent AND size_death > size_birth) b2 ON s.size >= b2.size_birth AND s.size < b2.size_death GROUP BY s.size),
cv AS (SELECT size, persistence, row_number() OVER (ORDER BY size) - 1 AS position, lag(persistence) OVER (ORDER BY size) AS before FROM curve),
ru AS (SELECT *, sum(CASE WHEN before = persistence THEN 0 ELSE 1 END) OVER (ORDER BY position) AS run FROM cv),
fl AS (SELECT run, min(position) AS a, max(position) AS b, any_value(persistence) AS p FROM ru GROUP BY run),
pk AS (SELECT CAST(floor((a + b) / 2) AS BIGINT) AS position FROM (SELECT *, lag(p) OVER (ORDER BY run) AS x, lead(p) OVER (ORDER BY run) AS y FROM fl) WHERE p > x AND p > y)
"""


def _diverse_sql(threshold: float, most: int) -> str:
    """Peaks by falling persistence, without those too like one that was taken: ``picked``."""
    return f"""
cand AS (SELECT row_number() OVER (ORDER BY cv.persistence DESC, cv.position) AS k, cv.size, cv.persistence FROM cv JOIN pk ON pk.position = cv.position),
held AS (SELECT cand.k, b.cluster_id FROM cand JOIN bars b ON b.size_birth <= cand.size AND b.size_death > cand.size),
alike AS (SELECT x.k, list(y.k) AS ks FROM cand x JOIN cand y ON y.k < x.k
  WHERE (SELECT count(*) FROM held p JOIN held q ON p.cluster_id = q.cluster_id WHERE p.k = x.k AND q.k = y.k) > {threshold} * (SELECT count(DISTINCT cluster_id) FROM held WHERE k = x.k OR k = y.k) GROUP BY x.k),
pick AS (
  SELECT 0 AS k, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT c.k, CASE WHEN len(pick.taken) < {most} AND NOT list_has_any(pick.taken, coalesce(alike.ks, [])) THEN list_append(pick.taken, c.k) ELSE pick.taken END
  FROM pick JOIN cand c ON c.k = pick.k + 1 LEFT JOIN alike ON alike.k = c.k),
picked AS (SELECT cand.k, cand.size, cand.persistence, row_number() OVER (ORDER BY cand.k) - 1 AS place FROM cand WHERE list_contains((SELECT taken FROM pick ORDER BY k DESC LIMIT 1), cand.k))
"""


_TREE = f"WITH RECURSIVE {_V}, {_CHAIN}, {_condensed_sql(str(MIN_SIZE))}"
_W = f"v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:{LOW}] AS x FROM embeddings)"
_LOW_TREE = f"WITH RECURSIVE {_W}, {_REAL}, {_condensed_sql(str(MIN_SIZE))}"
_WHOLE_TREE = f"WITH RECURSIVE {_V}, {_REAL}"
# layers of the real tree: selected clusters by layer, a point's label by the innermost that holds it
_LAYERS = """
sel AS (SELECT 0 AS layer, cluster FROM leaf, root WHERE cluster <> root UNION ALL SELECT picked.place + 1, b.cluster_id FROM root, picked JOIN bars b ON b.size_birth <= picked.size AND b.size_death > picked.size WHERE b.cluster_id <> root.root),
lay AS (SELECT 0 AS layer, CAST(0 AS DOUBLE) AS persistence UNION ALL SELECT place + 1, persistence FROM picked),
num AS (SELECT sel.layer, sel.cluster, row_number() OVER (PARTITION BY sel.layer ORDER BY sel.cluster) - 1 AS label, dn.lo, dn.hi FROM sel JOIN dn ON dn.id = sel.cluster),
inn AS (SELECT lay.layer, pts.p, arg_min(num.label, num.cluster) AS label, min(num.cluster) AS cluster FROM lay CROSS JOIN pts JOIN num ON num.layer = lay.layer AND num.lo <= pts.place AND num.hi >= pts.place GROUP BY lay.layer, pts.p),
tops AS (SELECT parent AS cluster, max("lambda") AS most FROM cond WHERE child_size = 1 GROUP BY parent),
given AS (SELECT lay.layer, lay.persistence, c.child AS p, coalesce(inn.label, -1) AS label, CASE WHEN inn.label IS NULL THEN 0 WHEN tops.most IS NULL THEN 1 ELSE least(c."lambda", tops.most) / tops.most END AS strength
  FROM lay CROSS JOIN (SELECT * FROM cond WHERE child_size = 1) c LEFT JOIN inn ON inn.layer = lay.layer AND inn.p = c.child LEFT JOIN tops ON tops.cluster = inn.cluster),
ranked AS (SELECT layer, row_number() OVER (ORDER BY max(label) DESC, layer) - 1 AS number FROM given GROUP BY layer)"""
_AT_TARGET = """
sp AS (SELECT id, lo, hi, least(size_a, size_b) AS s FROM nodes),
bis AS (
  SELECT CAST(2 AS BIGINT) AS lo, n // 2 AS hi FROM t
  UNION ALL
  SELECT CASE WHEN q.c < {target} THEN q.lo ELSE q.mid END, CASE WHEN q.c < {target} THEN q.mid ELSE q.hi END
  FROM (SELECT any_value(b.lo) AS lo, any_value(b.hi) AS hi, (any_value(b.lo) + any_value(b.hi)) // 2 AS mid, count(*) FILTER (WHERE sp.s >= (b.lo + b.hi) // 2) + 1 AS c FROM (SELECT lo, hi FROM bis WHERE hi - lo > 1) b CROSS JOIN sp GROUP BY b.lo, b.hi) q),
ms AS (SELECT unnest([lo, hi]) AS m FROM bis WHERE hi - lo <= 1),
sides AS (SELECT ms.m, unnest([nodes.lo, nodes.lo + nodes.size_a]) AS lo, unnest([nodes.lo + nodes.size_a - 1, nodes.hi]) AS hi FROM ms JOIN nodes ON least(nodes.size_a, nodes.size_b) >= ms.m),
ends AS (SELECT sides.m, sum(sides.hi - sides.lo + 1) AS labelled FROM sides WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.s >= sides.m AND sp.lo >= sides.lo AND sp.hi <= sides.hi) GROUP BY sides.m),
chosen AS (SELECT ms.m FROM ms LEFT JOIN ends ON ends.m = ms.m ORDER BY abs((SELECT count(*) + 1 FROM sp WHERE sp.s >= ms.m) - {target}), coalesce(ends.labelled, 0) DESC, ms.m LIMIT 1)"""


# --- sources and search ---------------------------------------------------------------------------


@query("scan_vectors", f"WITH {_V}, {_CELLS} SELECT id, c, round(v, 6) AS v FROM c")
def scan_vectors(spark, sf_dir):
    return _wide(_vectors(spark, sf_dir), "embedding")


def _neighbours(method: str, metric: str = "euclidean", params: NearestNeighbourParams | None = None):
    return lambda spark, sf_dir: knn(_vectors(spark, sf_dir), K, method, metric, params).select("src", F.col("rank").cast("long").alias("rank"), "dst", r6("dist"))


_EXACT = f"WITH {_V}, {_P}, {_nn(K)} SELECT src, rank, dst, round(d, 6) AS dist FROM k"
_COSINE = f"WITH {_V}, p AS (SELECT a.id AS src, b.id AS dst, 1 - list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) AS d FROM v a JOIN v b ON a.id <> b.id), {_nn(K)} SELECT src, rank, dst, round(d, 6) AS dist FROM k"
for _name, _method, _metric, _sql in (
    ("knn_exhaustive_euclidean", "exhaustive", "euclidean", _EXACT),
    ("knn_exhaustive_cosine", "exhaustive", "cosine", _COSINE),
    ("knn_exhaustive_gpu", "exhaustive_gpu", "euclidean", _EXACT),
    ("knn_kmknn", "kmknn", "euclidean", _EXACT),
    ("knn_kmknn_cosine", "kmknn", "cosine", _COSINE),
    ("knn_unknown_name", "no such method", "euclidean", _EXACT),
    ("knn_ivf", "ivf", "euclidean", None),
    ("knn_ivf_gpu", "ivf_gpu", "euclidean", None),
    ("knn_annoy", "annoy", "euclidean", None),
    ("knn_hnsw", "hnsw", "euclidean", None),
    ("knn_nndescent", "nndescent", "euclidean", None),
    ("knn_nndescent_gpu", "nndescent_gpu", "euclidean", None),
    ("knn_balltree", "balltree", "euclidean", None),
):
    query(_name, _sql)(_neighbours(_method, _metric))
# with budgets that let them see every row the approximate methods are exact
_FULL = NearestNeighbourParams(n_probes=1 << 20, search_budget=1 << 40, bt_budget=1.0, ef_search=1 << 20, ef_budget=1 << 20)
for _method in ("ivf", "annoy", "hnsw", "nndescent", "balltree"):
    query(f"knn_{_method}_full_budget", _EXACT)(_neighbours(_method, "euclidean", _FULL))


@query("knn_nested", f"WITH {_V}, {_P}, {_nn(K)} SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY rank) AS indices, count(*) AS n FROM k GROUP BY src")
def knn_nested(spark, sf_dir):
    return nested(knn(_vectors(spark, sf_dir), K)).select("src", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), F.size("distances").cast("long").alias("n"))


# --- fuzzy graph ----------------------------------------------------------------------------------


@query("smooth_knn_dist", f"WITH RECURSIVE {_V}, {_P}, {_nn(K)}, {_SIGMA} SELECT src, round(sigma, 6) AS sigma, round(rho, 6) AS rho FROM b")
def smooth_knn_dist(spark, sf_dir):
    return fuzzy.smooth_knn_dist(knn(_vectors(spark, sf_dir), K, "exhaustive"), K).select("src", r6("sigma"), r6("rho"))


@query("fuzzy_directed", f"WITH RECURSIVE {_V}, {_P}, {_nn(K)}, {_SIGMA}, {_EDGES} SELECT src, dst, round(w, 6) AS w FROM e")
def fuzzy_directed(spark, sf_dir):
    near = cut(knn(_vectors(spark, sf_dir), K, "exhaustive"))
    return fuzzy.directed_edges(near, fuzzy.smooth_knn_dist(near, K)).select("src", "dst", r6("w"))


@query("fuzzy_symmetrise", f"WITH {_V}, {_P}, {_nn(K)}, e AS (SELECT src, dst, 1 / (1 + d) AS w FROM k), {_SYM} SELECT src, dst, round(w, 6) AS w FROM g")
def fuzzy_symmetrise(spark, sf_dir):
    near = knn(_vectors(spark, sf_dir), K, "exhaustive").select("src", "dst", (1 / (1 + F.col("dist"))).alias("w"))
    return fuzzy.symmetrise(near).select("src", "dst", r6("w"))


@query("fuzzy_simplicial_set", f"{_GRAPH} SELECT src, dst, round(w, 6) AS w FROM g")
def fuzzy_simplicial_set(spark, sf_dir):
    return _graph(_vectors(spark, sf_dir)).select("src", "dst", r6("w"))


@query("adjacency_list", f"{_GRAPH} SELECT v.id, count(g.dst) AS degree, coalesce(string_agg(CAST(g.dst AS VARCHAR), ',' ORDER BY g.dst), '') AS neighbours FROM v LEFT JOIN g ON g.src = v.id GROUP BY v.id")
def adjacency(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    lists = fuzzy.adjacency_list(_graph(df), df)
    return lists.select("id", F.size("adj").cast("long").alias("degree"), F.array_join(F.transform("adj", lambda a: a["dst"].cast("string")), ",").alias("neighbours"))


# --- sparse algebra -------------------------------------------------------------------------------


@query("csr_from_coo", f"WITH {_V}, {_P}, {_nn(K)} SELECT src % 50 AS i, dst % 50 AS j, round(sum(d), 6) AS v FROM k GROUP BY ALL")
def csr_from_coo(spark, sf_dir):
    near = knn(_vectors(spark, sf_dir), K, "exhaustive")
    return _ijv(sparse.from_coo(near.select((F.col("src") % 50).alias("i"), (F.col("dst") % 50).alias("j"), F.col("dist").alias("v"))))


@query("partition_indicator", f"SELECT vec_id AS i, vec_id % {PARTS} AS j, CAST(1 AS DOUBLE) AS v FROM embeddings")
def partition_indicator(spark, sf_dir):
    return sparse.partition_indicator(_parts(_vectors(spark, sf_dir)))


def _on_graph(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, f"{_GRAPH} {sql}")(lambda spark, sf_dir: _ijv(f(_matrix(_vectors(spark, sf_dir)))))


_on_graph("sparse_transpose", "SELECT j AS i, i AS j, round(v, 6) AS v FROM m", sparse.transpose)
_on_graph("sparse_matmul", "SELECT a.i, b.j, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.j = b.i GROUP BY a.i, b.j", lambda a: sparse.matmul(a, a))
_on_graph("sparse_hadamard", "SELECT a.i, a.j, round(a.v * b.v, 6) AS v FROM m a JOIN m b ON a.i = b.j AND a.j = b.i", lambda a: sparse.hadamard(a, sparse.transpose(a)))
_on_graph("sparse_norm_cols_l2", "SELECT i, j, round(v / sqrt(sum(v * v) OVER (PARTITION BY j)), 6) AS v FROM m", sparse.normalise_cols_l2)
_on_graph("sparse_norm_rows_l1", "SELECT i, j, round(v / sum(abs(v)) OVER (PARTITION BY i), 6) AS v FROM m", sparse.normalise_rows_l1)
_on_graph("sparse_clip", "SELECT i, j, round(least(greatest(v, 0.2), 0.6), 6) AS v FROM m", lambda a: sparse.clip(a, 0.2, 0.6))


@query("sparse_nnz", f"{_GRAPH} SELECT count(*) AS nnz FROM m")
def sparse_nnz(spark, sf_dir):
    return _matrix(_vectors(spark, sf_dir)).agg(F.count(F.lit(1)).alias("nnz"))


@query("sparse_dense_matmul", f"{_GRAPH}, {_CELLS} SELECT m.i AS id, c.c, round(sum(m.v * c.v), 6) AS v FROM m JOIN c ON c.id = m.j GROUP BY m.i, c.c")
def sparse_dense_matmul(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return _wide(sparse.matmul_dense(_matrix(df), df.select("id", F.col("embedding").alias("pos"))).withColumnRenamed("i", "id"))


@query("sparse_to_dense", f"{_GRAPH}, q AS (SELECT i, j % 20 AS j, sum(v) AS v FROM m GROUP BY ALL), f AS (SELECT DISTINCT i, unnest(range(20)) AS c FROM m) SELECT f.i AS id, f.c, round(coalesce(q.v, 0), 6) AS v FROM f LEFT JOIN q ON q.i = f.i AND q.j = f.c")
def sparse_to_dense(spark, sf_dir):
    folded = sparse.from_coo(_matrix(_vectors(spark, sf_dir)).select("i", (F.col("j") % 20).alias("j"), "v"))
    return _wide(sparse.to_dense(folded, 20))


# --- label propagation ----------------------------------------------------------------------------

# weights are rounded, as sums that are 1 but for the last bit decide
_ROUND = """r AS (SELECT src, dst, CAST(round(w * 1e6) AS BIGINT) AS w FROM g),
votes AS (SELECT r.src, z.label AS vote, sum(r.w) AS w, min(r.dst) AS first FROM r JOIN z ON z.id = r.dst AND z.label >= 0 GROUP BY r.src, z.label HAVING sum(r.w) >= 1000000),
best AS (SELECT src, vote FROM votes QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, first DESC) = 1)"""


@query("label_prop_iteration", f"{_GRAPH}, {_SEEDS}, {_ROUND} SELECT z.id, CASE WHEN z.label >= 0 THEN z.label ELSE coalesce(best.vote, -1) END AS label FROM z LEFT JOIN best ON best.src = z.id")
def label_prop_iteration(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    rounded = _graph(df).select("src", "dst", (F.round(F.col("w") * 1e6).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(20,0)")).alias("w"))
    return labelprop.label_prop_iteration(rounded, _seeds(df))


def _hops(n: int) -> str:
    out = ["z0 AS (SELECT * FROM z)"]
    for k in range(n):
        out.append(f"z{k + 1} AS (SELECT z{k}.id, CASE WHEN any_value(z{k}.label) >= 0 THEN any_value(z{k}.label) ELSE coalesce(min(y.label), -1) END AS label FROM z{k} LEFT JOIN g ON g.src = z{k}.id LEFT JOIN z{k} y ON y.id = g.dst AND y.label >= 0 GROUP BY z{k}.id)")
    return ", ".join(out)


@query("label_outliers", f"{_GRAPH}, {_SEEDS}, {_hops(4)} SELECT id, label FROM z4")
def label_outliers(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return labelprop.label_outliers(cut(_graph(df)), _seeds(df))


@query("remap_labels", f"WITH {_V}, {_SEEDS}, u AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS r FROM (SELECT DISTINCT label FROM z WHERE label >= 0)) SELECT z.id, u.r AS label FROM z JOIN u ON u.label = z.label UNION ALL SELECT id, (SELECT count(*) FROM u) + row_number() OVER (ORDER BY id) - 1 FROM z WHERE label < 0")
def remap_labels(spark, sf_dir):
    return labelprop.remap_labels(_seeds(_vectors(spark, sf_dir)))


@query("label_prop_partition")
def label_prop_partition(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return labelprop.label_prop_partition(cut(_graph(df)), df.select("id"), 64)


@query("unit_range", f"WITH {_V}, {_CELLS} SELECT id, c, round((v - (min(v) OVER w + max(v) OVER w) / 2) / ((max(v) OVER w - min(v) OVER w) / 2), 6) AS v FROM c WINDOW w AS (PARTITION BY c)")
def unit_range(spark, sf_dir):
    return _wide(labelprop.unit_range(_vectors(spark, sf_dir).withColumnRenamed("embedding", "pos")))


@query("pca_init")
def pca_init(spark, sf_dir):
    return _wide(labelprop.pca_init(_vectors(spark, sf_dir).withColumnRenamed("embedding", "pos"), LOW))


@query("random_init")
def random_init(spark, sf_dir):
    return _wide(labelprop.random_init(_vectors(spark, sf_dir), LOW))


@query("coarsen_graph", f"{_GRAPH}, {_PARTS} SELECT a.label AS i, b.label AS j, round(least(greatest(sum(g.w) / sqrt(any_value(n.n)), 0), 1), 6) AS v FROM g JOIN z a ON a.id = g.src JOIN z b ON b.id = g.dst JOIN n ON n.label = a.label GROUP BY a.label, b.label")
def coarsen_graph(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return _ijv(labelprop.coarsen_graph(_graph(df), _parts(df)))


@query("coarsen_data", f"WITH {_V}, {_PARTS}, {_CELLS} SELECT z.label AS id, c.c, round(avg(c.v), 6) AS v FROM c JOIN z ON z.id = c.id GROUP BY z.label, c.c")
def coarsen_data(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return _wide(labelprop.coarsen_data(df.withColumnRenamed("embedding", "pos"), _parts(df)))


@query(
    "expand_layout",
    f"""{_GRAPH}, {_PARTS}, {_CELLS},
    o AS (SELECT z.label, c.c, avg(c.v) AS v FROM c JOIN z ON z.id = c.id WHERE c.c < {LOW} GROUP BY z.label, c.c),
    ea AS (SELECT a.src AS i, z.label, sum(a.w * b.w / sqrt(n.n)) AS v FROM g a JOIN g b ON a.src = b.dst AND a.dst = b.src JOIN z ON z.id = a.dst JOIN n ON n.label = z.label GROUP BY a.src, z.label),
    ew AS (SELECT i, label, v / sum(v) OVER (PARTITION BY i) AS v FROM ea),
    around AS (SELECT ew.i, o.c, sum(ew.v * o.v) AS v FROM ew JOIN o ON o.label = ew.label GROUP BY ew.i, o.c),
    mixed AS (SELECT z.id, o.c, (o.v + coalesce(around.v, 0)) / 2 AS v FROM z JOIN o ON o.label = z.label LEFT JOIN around ON around.i = z.id AND around.c = o.c)
    SELECT id, c, round((v - avg(v) OVER (PARTITION BY c)) * 0.1, 6) AS v FROM mixed""",
)
def expand_layout(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    means = labelprop.coarsen_data(_low(df).withColumnRenamed("embedding", "pos"), _parts(df))
    return _wide(labelprop.expand_layout(cut(_graph(df)), _parts(df), means))


@query("label_prop_init")
def label_prop_init(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return _wide(labelprop.label_prop_init(_graph(df), df.withColumnRenamed("embedding", "pos"), LOW))


# --- layout ---------------------------------------------------------------------------------------


@query("node_embedding")
def layout(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return _wide(node_embedding(cut(_graph(df)), labelprop.random_init(df, LOW), EmbeddingParams()))


@query(
    "embedding_attract_step",
    f"""{_GRAPH}, q AS (SELECT a.src, a.dst, x.x[1:{LOW}] AS x, y.x[1:{LOW}] AS y, list_distance(x.x[1:{LOW}], y.x[1:{LOW}]) AS d FROM g a JOIN v x ON x.id = a.src JOIN v y ON y.id = a.dst),
    f AS (SELECT src, CASE WHEN d * d < 1e-8 THEN 0 ELSE (-2 * 0.5 * d - 2) / (2 * d * d - 0.5 * d + 1) END AS f, unnest(range({LOW})) AS c, unnest(x) AS x, unnest(y) AS y FROM q)
    SELECT src AS id, c, round(sum(f * (x - y)), 6) AS v FROM f GROUP BY src, c""",
)
def embedding_attract_step(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return _wide(attract_step(_graph(df), _low(df).withColumnRenamed("embedding", "pos"), 0.5), "grad")


# --- spanning tree and dendrogram -----------------------------------------------------------------


@query("knn_lowdim", f"WITH w AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:{LOW}] AS x FROM embeddings), p AS (SELECT a.id AS src, b.id AS dst, list_distance(a.x, b.x) AS d FROM w a JOIN w b ON a.id <> b.id), {_nn(K)} SELECT src, rank, dst, round(d * d, 6) AS dist2 FROM k")
def lowdim(spark, sf_dir):
    return knn_lowdim(_low(_vectors(spark, sf_dir)), K).select("src", F.col("rank").cast("long").alias("rank"), "dst", r6("dist2"))


_CORE = f"{_nn(MIN_SAMPLES, 'k5')}, core AS (SELECT src AS id, max(d) AS core FROM k5 GROUP BY src)"


@query("core_distance", f"WITH {_V}, {_P}, {_CORE} SELECT id, round(core, 6) AS core FROM core")
def core(spark, sf_dir):
    return core_distance(_vectors(spark, sf_dir), MIN_SAMPLES).select("id", r6("core"))


@query("mutual_reachability", f"WITH {_V}, {_P}, {_nn(K)}, {_CORE} SELECT src, dst, round(greatest(d, a.core, b.core), 6) AS mr FROM k JOIN core a ON a.id = src JOIN core b ON b.id = dst")
def reachability(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return mutual_reachability(knn(df, K, "exhaustive"), core_distance(df, MIN_SAMPLES)).select("src", "dst", r6("mr"))


@query(
    "nearest_other_component",
    f"WITH {_V}, {_P}, {_CORE}, q AS (SELECT src AS id, dst AS other, greatest(d, a.core, b.core) AS w FROM p JOIN core a ON a.id = src JOIN core b ON b.id = dst WHERE src % 7 <> dst % 7 QUALIFY row_number() OVER (PARTITION BY src ORDER BY greatest(d, a.core, b.core), least(src, dst), greatest(src, dst)) = 1) SELECT id, other, round(w, 6) AS w FROM q",
)
def other_component(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    ready = df.join(core_distance(df, MIN_SAMPLES), "id").withColumn("comp", F.col("id") % 7)
    return nearest_other_component(ready).select("id", "other", r6("w"))


@query("mst", f"WITH RECURSIVE {_V}, {_MST} SELECT u, v, round(w, 6) AS w FROM mst")
def spanning_tree(spark, sf_dir):
    return mst(_vectors(spark, sf_dir), MIN_SAMPLES).select("u", "v", r6("w"))


@query("linkage", f"{_TREE} SELECT id AS merge_id, greatest(a, b) AS left, least(a, b) AS right, round(w, 6) AS distance, size FROM dn")
def linkage_rows(spark, sf_dir):
    return linkage(chain(_vectors(spark, sf_dir))).select("merge_id", "left", "right", r6("distance"), "size")


_LINKS = f"WITH RECURSIVE {_V}, {_P}, {_nn(1)}, o AS (SELECT src AS a, dst AS b FROM k UNION SELECT dst, src FROM k), reach AS (SELECT id, id AS r FROM v UNION SELECT reach.id, o.b FROM reach JOIN o ON o.a = reach.r), cc AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"


def _linked(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return connected_components(df, knn(df, 1, "exhaustive").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("connected_components", f"{_LINKS} SELECT id, component FROM cc")
def components_(spark, sf_dir):
    return _linked(spark, sf_dir)


@query("component_sizes", f"{_LINKS} SELECT component, count(*) AS size FROM cc GROUP BY component")
def sizes(spark, sf_dir):
    return component_sizes(_linked(spark, sf_dir))


@query("descendants", f"{_TREE} SELECT id AS node, unnest(range(lo, hi + 1)) AS leaf FROM dn")
def below(spark, sf_dir):
    return descendants(linkage(chain(_vectors(spark, sf_dir))))


@query("condense_tree", f"{_TREE} SELECT parent, child, round(\"lambda\", 6) AS \"lambda\", child_size FROM cond")
def condensed(spark, sf_dir):
    return _condensed(spark, sf_dir).select("parent", "child", r6("lambda"), "child_size")


@query("extract_leaves", f"{_TREE} SELECT cluster FROM leaf")
def leaves(spark, sf_dir):
    return tree.extract_leaves(_condensed(spark, sf_dir))


@query("cluster_labels", f"{_TREE} SELECT id, label FROM lab")
def labels(spark, sf_dir):
    c = _condensed(spark, sf_dir)
    return tree.cluster_labels(c, tree.extract_leaves(c))


@query("death_lambda", f"{_TREE} SELECT parent AS cluster, round(max(\"lambda\"), 6) AS max_lambda FROM cond WHERE child_size = 1 AND parent IN (SELECT cluster FROM leaf) GROUP BY parent")
def last_lambda(spark, sf_dir):
    c = _condensed(spark, sf_dir)
    return tree.death_lambda(c, tree.extract_leaves(c)).select("cluster", r6("max_lambda"))


@query("membership_strength", f"{_TREE} SELECT c.child AS id, round(CASE WHEN lab.label < 0 THEN 0 ELSE c.\"lambda\" / max(c.\"lambda\") OVER (PARTITION BY c.parent) END, 6) AS strength FROM (SELECT * FROM cond WHERE child_size = 1) c JOIN lab ON lab.id = c.child")
def strength(spark, sf_dir):
    c = _condensed(spark, sf_dir)
    chosen = cut(tree.extract_leaves(c))
    return tree.membership_strength(c, chosen, tree.cluster_labels(c, chosen)).select("id", r6("strength"))


@query("barcode", f"{_TREE} SELECT cluster_id, size_birth, size_death, parent, round(lambda_death, 6) AS lambda_death FROM bars")
def bars(spark, sf_dir):
    return _bars(spark, sf_dir).select("cluster_id", "size_birth", "size_death", "parent", r6("lambda_death"))


@query("total_persistence", f"{_TREE} SELECT size, round(persistence, 6) AS persistence FROM curve")
def persistence(spark, sf_dir):
    return tree.total_persistence(_bars(spark, sf_dir)).select("size", r6("persistence"))


@query("find_peaks", f"{_TREE} SELECT cv.position, cv.size, round(cv.persistence, 6) AS persistence FROM cv JOIN pk ON pk.position = cv.position")
def peaks(spark, sf_dir):
    return tree.find_peaks(tree.total_persistence(_bars(spark, sf_dir))).select("position", "size", r6("persistence"))


@query(
    "layer_jaccard",
    f"""{_TREE}, s AS (SELECT DISTINCT size_birth AS size FROM bars), live AS (SELECT s.size, b.cluster_id FROM s JOIN bars b ON b.size_birth <= s.size AND b.size_death > s.size)
    SELECT x.size AS a, y.size AS b, round(CASE WHEN u = 0 THEN 0 ELSE i / u END, 6) AS jaccard FROM (
      SELECT x.size AS xa, y.size AS ya, (SELECT count(*) FROM live p JOIN live q ON p.cluster_id = q.cluster_id WHERE p.size = x.size AND q.size = y.size) AS i,
        (SELECT count(DISTINCT cluster_id) FROM live WHERE size = x.size OR size = y.size) AS u FROM s x JOIN s y ON x.size < y.size) z JOIN s x ON x.size = z.xa JOIN s y ON y.size = z.ya""",
)
def likeness(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return tree.layer_jaccard(b, b.select(F.col("size_birth").alias("size")).distinct()).select("a", "b", r6("jaccard"))


@query("diverse_peaks", f"{_TREE}, {_diverse_sql(0.2, 9)} SELECT place, size, round(persistence, 6) AS persistence FROM picked")
def chosen_peaks(spark, sf_dir):
    return tree.diverse_peaks(_bars(spark, sf_dir), 0.2, 9).select("place", "size", r6("persistence"))


@query(
    "labels_at_size",
    f"""{_TREE}, act AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS label FROM bars, root WHERE size_birth <= {AT_SIZE} AND size_death > {AT_SIZE} AND cluster_id <> root)
    SELECT pts.p AS id, coalesce(max(act.label), -1) AS label FROM pts LEFT JOIN (SELECT act.label, dn.lo, dn.hi FROM act JOIN dn ON dn.id = act.cluster_id) act ON act.lo <= pts.place AND act.hi >= pts.place GROUP BY pts.p""",
)
def at_size(spark, sf_dir):
    c = _condensed(spark, sf_dir)
    return tree.cluster_labels(c, tree.active_clusters(tree.barcode(c, MIN_SIZE), AT_SIZE))


@query("cluster_layers", f"WITH RECURSIVE {_W}, {_REAL}, {_condensed_sql('5')}, {_diverse_sql(0.2, 9)}, {_LAYERS} SELECT ranked.number AS layer, pos.id, given.label, round(given.strength, 6) AS strength, round(given.persistence, 6) AS persistence FROM given JOIN ranked ON ranked.layer = given.layer JOIN pos ON pos.k = given.p + 1")
def layers(spark, sf_dir):
    found = layers_of(_low(_vectors(spark, sf_dir)), ClusterParams())
    return found.select(F.col("layer").cast("long").alias("layer"), "id", "label", r6("strength"), r6("persistence"))


@query(
    "search_n_clusters",
    f"""WITH RECURSIVE {_W}, {_REAL}, {_AT_TARGET.format(target=8)}, {_condensed_sql("(SELECT m FROM chosen)")},
    s AS (SELECT c.child AS p, lab.label, CASE WHEN lab.label < 0 THEN 0 ELSE c."lambda" / max(c."lambda") OVER (PARTITION BY c.parent) END AS strength FROM (SELECT * FROM cond WHERE child_size = 1) c JOIN lab ON lab.id = c.child)
    SELECT CAST(0 AS BIGINT) AS layer, pos.id, s.label, round(s.strength, 6) AS strength FROM s JOIN pos ON pos.k = s.p + 1""",
)
def fixed_number(spark, sf_dir):
    found = layers_of(_low(_vectors(spark, sf_dir)), ClusterParams(approx_n_clusters=8))
    return found.select(F.col("layer").cast("long").alias("layer"), "id", "label", r6("strength"))


# the dendrogram stages once more, on the spanning tree of the vectors or of the low-dimensional points


def _low_link(spark, sf_dir):
    return linkage(mst(_low(_vectors(spark, sf_dir)), MIN_SAMPLES))


def _whole_link(spark, sf_dir):
    return linkage(mst(_vectors(spark, sf_dir), MIN_SAMPLES))


@query("linkage_mst", f"{_WHOLE_TREE} SELECT id AS merge_id, greatest(a, b) AS left, least(a, b) AS right, round(w, 6) AS distance, size FROM nodes")
def linkage_mst(spark, sf_dir):
    return _whole_link(spark, sf_dir).select("merge_id", "left", "right", r6("distance"), "size")


@query("descendants_mst", f"{_WHOLE_TREE} SELECT nodes.id AS node, leaves.leaf FROM nodes JOIN leaves ON leaves.place BETWEEN nodes.lo AND nodes.hi")
def descendants_mst(spark, sf_dir):
    return descendants(_whole_link(spark, sf_dir))


@query("condense_tree_mst", f"{_LOW_TREE} SELECT parent, child, round(\"lambda\", 6) AS \"lambda\", child_size FROM cond")
def condense_tree_mst(spark, sf_dir):
    return tree.condense_tree(_low_link(spark, sf_dir), MIN_SIZE).select("parent", "child", r6("lambda"), "child_size")


@query("cluster_labels_mst", f"{_LOW_TREE} SELECT id, label FROM lab")
def cluster_labels_mst(spark, sf_dir):
    c = cut(tree.condense_tree(_low_link(spark, sf_dir), MIN_SIZE))
    return tree.cluster_labels(c, tree.extract_leaves(c))


@query("barcode_mst", f"{_WHOLE_TREE}, {_condensed_sql(str(MIN_SIZE))} SELECT cluster_id, size_birth, size_death, parent, round(lambda_death, 6) AS lambda_death FROM bars")
def barcode_mst(spark, sf_dir):
    bars = tree.barcode(tree.condense_tree(_whole_link(spark, sf_dir), MIN_SIZE), MIN_SIZE)
    return bars.select("cluster_id", "size_birth", "size_death", "parent", r6("lambda_death"))


# --- whole pipeline -------------------------------------------------------------------------------


@query("cluster_best")
def whole(spark, sf_dir):
    found = cluster(_vectors(spark, sf_dir))
    return found.best_labels().join(found.best_strengths(), "id").select("id", "label", r6("strength"))


@query("cluster_gpu")
def whole_gpu(spark, sf_dir):
    found = cluster_gpu(_vectors(spark, sf_dir), "exhaustive_gpu")
    return found.assignments.select("layer", "id", "label", r6("strength"))


@query("cluster_precomputed_knn")
def whole_precomputed(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    found = cluster(df, precomputed=knn(df, K, "exhaustive", "cosine"))
    return found.assignments.select("layer", "id", "label", r6("strength"))


@query("best_layer", f"{_TREE} SELECT row_number() OVER (ORDER BY size) - 1 AS layer FROM curve QUALIFY row_number() OVER (ORDER BY persistence DESC, size DESC) = 1")
def best(spark, sf_dir):
    from pyspark.sql.window import Window

    curve = tree.total_persistence(_bars(spark, sf_dir))
    return best_layer(curve.select((F.row_number().over(Window.orderBy("size")) - 1).cast("long").alias("layer"), "persistence"))


@query("n_clusters", f"{_TREE} SELECT greatest(max(label) + 1, 0) AS n_clusters FROM lab")
def number_of_clusters(spark, sf_dir):
    c = _condensed(spark, sf_dir)
    return n_clusters(tree.cluster_labels(c, tree.extract_leaves(c)))


@query("cluster_accuracy", "SELECT round(sum(h) / (SELECT count(*) FROM embeddings), 6) AS accuracy FROM (SELECT max(n) AS h FROM (SELECT vec_id % 12 AS l, label, count(*) AS n FROM embeddings GROUP BY ALL) WHERE l < 10 GROUP BY l)")
def accuracy(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    guess = raw.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 12 < 10, F.col("vec_id") % 12).otherwise(F.lit(-1)).alias("label"))
    return cluster_accuracy(guess, raw.select(F.col("vec_id").alias("id"), F.col("label").alias("gt"))).select(r6("accuracy"))
