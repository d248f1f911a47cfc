"""Gaussian blobs with known classes, for tests and demonstrations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def blob_arrays(n_per_cluster: int, n_clusters: int, dim: int, separation: float, spread: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and classes; centres lie on the first axis, ``separation`` apart."""
    gt = np.repeat(np.arange(n_clusters), n_per_cluster)
    x = np.random.default_rng(seed).standard_normal((len(gt), dim)) * spread
    x[:, 0] += gt * separation
    return x, gt


def make_blobs(spark: SparkSession, n_per_cluster: int, n_clusters: int, dim: int, separation: float, spread: float, seed: int = 42) -> DataFrame:
    """(id, embedding, gt)."""
    x, gt = blob_arrays(n_per_cluster, n_clusters, dim, separation, spread, seed)
    return spark.createDataFrame(pa.table({"id": np.arange(len(gt)), "embedding": pa.array(list(x), pa.list_(pa.float64())), "gt": gt.astype(np.int32)}))
