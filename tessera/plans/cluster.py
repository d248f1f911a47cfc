"""The whole pipeline: neighbours, fuzzy graph, layout, dendrogram, layers."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import fuzzy, tree
from tessera.operators.embedding import node_embedding
from tessera.operators.knn import knn
from tessera.operators.labelprop import _numbered, label_prop_init
from tessera.operators.mst import linkage, mst
from tessera.params import ClusterParams, EmbeddingParams, NearestNeighbourParams, Verbosity, parse_verbosity, resolve_method
from tessera.runtime import cut
from tessera.sources.vectors import precomputed_knn

log = logging.getLogger("tessera")


@dataclass(frozen=True)
class ClusterResult:
    """assignments (layer, id, label, strength), layers (layer, n_clusters, persistence), knn."""

    assignments: DataFrame
    layers: DataFrame
    knn: DataFrame

    def best_layer(self) -> DataFrame:
        return best_layer(self.layers)

    def best_labels(self) -> DataFrame:
        """(id, label) of the layer with the largest persistence."""
        return self.assignments.join(F.broadcast(self.best_layer()), "layer", "left_semi").select("id", "label")

    def best_strengths(self) -> DataFrame:
        return self.assignments.join(F.broadcast(self.best_layer()), "layer", "left_semi").select("id", "strength")

    def n_clusters(self) -> DataFrame:
        return n_clusters(self.best_labels())


def best_layer(layers: DataFrame) -> DataFrame:
    """(layer): the most persistent, the last one on ties; no layers, no row."""
    return layers.agg(F.max_by("layer", F.struct("persistence", "layer")).alias("layer")).where("layer IS NOT NULL")


def n_clusters(labels: DataFrame) -> DataFrame:
    """(n_clusters): one more than the largest label, 0 if all is noise."""
    return labels.agg(F.coalesce(F.greatest(F.max("label") + 1, F.lit(0)), F.lit(0)).cast("long").alias("n_clusters"))


def cluster_accuracy(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(accuracy): share of all points that belong to their cluster's majority class; noise is wrong.

    ``labels`` is (id, label), ``truth`` (id, gt).
    """
    joined = labels.join(truth, "id")
    most = joined.where("label >= 0").groupBy("label", "gt").count().groupBy("label").agg(F.max("count").alias("hits"))
    total = joined.agg(F.count(F.lit(1)).alias("n"))
    return total.join(most.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))).select(F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0).alias("accuracy"))


@contextmanager
def _stage(df: DataFrame, name: str, verbosity: Verbosity):
    began = time.monotonic()
    df.sparkSession.sparkContext.setJobDescription(f"tessera: {name}")
    yield
    if verbosity.normal:
        log.info("%s: %.1f s", name, time.monotonic() - began)


def dendrogram(points: DataFrame, min_samples: int) -> DataFrame:
    """Linkage rows of (id, embedding); leaves are places of the ids in order."""
    return linkage(mst(points, min_samples))


def layers_of(points: DataFrame, params: ClusterParams) -> DataFrame:
    """(layer, id, label, strength, persistence) of low-dimensional (id, embedding)."""
    link = dendrogram(points, params.min_samples)
    if params.approx_n_clusters is not None:
        found = tree.search_n_clusters(link, params.approx_n_clusters)
    else:
        found = tree.cluster_layers(link, params.base_min_cluster_size, params.min_similarity_threshold, params.max_layers)
    found = cut(found)
    places = _numbered(points.select("id"), "id").select(F.col("id").alias("real"), F.col("number").alias("id"))
    if found.isEmpty():  # fewer than two points: all noise
        return places.select(F.lit(0).alias("layer"), F.col("real").alias("id"), F.lit(-1).cast("long").alias("label"), F.lit(0.0).alias("strength"), F.lit(0.0).alias("persistence"))
    return found.join(places, "id").select("layer", F.col("real").alias("id"), "label", "strength", "persistence")


def cluster(
    df: DataFrame,
    method: str = "kmknn",
    precomputed: DataFrame | None = None,
    params: ClusterParams | None = None,
    nn_params: NearestNeighbourParams | None = None,
    seed: int = 42,
    verbose: int = 0,
) -> ClusterResult:
    """Cluster the vectors (id, embedding) of a table.

    ``precomputed`` neighbours (src, dst, dist) replace the search. The result is the same
    whatever the partitions; an empty table gives empty frames, and points that no edge
    reaches are placed like any others.
    """
    params, verbosity = params or ClusterParams(), parse_verbosity(verbose)
    nn = (nn_params or NearestNeighbourParams()).filled(params.n_neighbours) if method.lower().endswith("_gpu") else nn_params or NearestNeighbourParams()
    points = cut(df.select("id", "embedding"))
    with _stage(points, "neighbours", verbosity):
        if precomputed is not None:
            near = cut(precomputed_knn(precomputed))
        else:
            near = cut(knn(points, params.n_neighbours, resolve_method(method), nn.metric, nn, seed))
    with _stage(points, "fuzzy graph", verbosity):
        graph = cut(fuzzy.fuzzy_simplicial_set(near, params.effective_k, params.symmetrise))
    settings = EmbeddingParams(n_epochs=params.n_epochs, noise_level=params.noise_level)
    rows = points.select("id", F.col("embedding").alias("pos"))
    with _stage(points, "start", verbosity):
        start = cut(label_prop_init(graph, rows, params.dim, replace(settings, n_epochs=50, noise_level=EmbeddingParams.noise_level), seed))
    with _stage(points, "layout", verbosity):
        layout = cut(node_embedding(graph, start, settings, seed))
    with _stage(points, "layers", verbosity):
        found = cut(layers_of(layout.select("id", F.col("pos").alias("embedding")), params))
    points.sparkSession.sparkContext.setJobDescription(None)
    layers = found.groupBy("layer").agg(F.greatest(F.max("label") + 1, F.lit(0)).cast("long").alias("n_clusters"), F.max("persistence").alias("persistence"))
    return ClusterResult(found.select("layer", "id", "label", "strength"), layers, near)


def cluster_gpu(df: DataFrame, method: str = "ivf_gpu", **options) -> ClusterResult:
    """``cluster`` under the accelerator methods' names; they run on the same operators."""
    return cluster(df, method if method.lower().endswith("_gpu") else f"{method}_gpu", **options)
