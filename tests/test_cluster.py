"""The whole pipeline on blobs, and its result accessors."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.knn import knn
from tessera.params import ClusterParams
from tessera.plans.cluster import best_layer, cluster, cluster_accuracy, cluster_gpu, layers_of, n_clusters
from tessera.sources.blobs import make_blobs


def score(result, blobs):
    return cluster_accuracy(result.best_labels(), blobs.select("id", "gt")).first()["accuracy"]


def test_two_blobs_end_to_end(spark):
    b = make_blobs(spark, 100, 2, 8, 50, 1.0)
    found = cluster(b.select("id", "embedding"))
    assert score(found, b) > 0.65
    assert found.n_clusters().first()["n_clusters"] >= 2
    again = cluster(b.select("id", "embedding").repartition(7))
    assert sorted(map(tuple, again.assignments.collect())) == sorted(map(tuple, found.assignments.collect()))
    s = [r.strength for r in found.best_strengths().collect()]
    assert len(s) == 200 and all(0 <= v <= 1 for v in s)


def test_precomputed_neighbours_and_accelerator_names_agree(spark):
    b = make_blobs(spark, 60, 3, 8, 30, 1.0)
    df = b.select("id", "embedding")
    one = cluster(df, "exhaustive")
    two = cluster(df, precomputed=knn(df, 15, "exhaustive"))
    three = cluster_gpu(df, "exhaustive_gpu")
    first = sorted(map(tuple, one.assignments.collect()))
    assert first == sorted(map(tuple, two.assignments.collect())) == sorted(map(tuple, three.assignments.collect()))
    assert score(one, b) > 0.6


def test_about_as_many_clusters_as_asked(spark):
    b = make_blobs(spark, 50, 4, 4, 20, 0.5)
    found = cluster(b.select("id", "embedding"), params=ClusterParams(approx_n_clusters=4))
    assert [r.layer for r in found.layers.collect()] == [0]
    assert 2 <= found.n_clusters().first()["n_clusters"] <= 6


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_tiny_tables_are_noise(spark, n):
    df = make_blobs(spark, 5, 1, 4, 0, 1.0).select("id", "embedding").where(F.col("id") < n)
    for params in (ClusterParams(), ClusterParams(approx_n_clusters=2)):
        found = cluster(df, params=params)
        assert [r.label for r in found.assignments.collect()] == [-1] * n
        assert found.n_clusters().first()["n_clusters"] == 0


def test_layers_of_low_dimensional_points_keep_ids(spark):
    b = make_blobs(spark, 30, 2, 3, 50, 0.5).withColumn("id", F.col("id") * 10 + 7)
    found = layers_of(b.select("id", "embedding"), ClusterParams(min_samples=5, base_min_cluster_size=15))
    assert {r.id for r in found.collect()} == set(range(7, 607, 10))


def test_accessors(spark):
    layers = spark.createDataFrame([(0, 0.0), (1, 5.0), (2, 5.0)], "layer int, persistence double")
    assert best_layer(layers).first()["layer"] == 2 and best_layer(layers.limit(0)).count() == 0
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, -1)], "id long, label long")
    truth = spark.createDataFrame([(0, 4), (1, 4), (2, 5), (3, 5)], "id long, gt int")
    assert n_clusters(labels).first()["n_clusters"] == 2 and n_clusters(labels.where("label < 0")).first()["n_clusters"] == 0
    assert cluster_accuracy(labels, truth).first()["accuracy"] == 0.75
