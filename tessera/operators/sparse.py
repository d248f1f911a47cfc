"""Sparse matrices as tables (i, j, v): the algebra is joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_coo(entries: DataFrame) -> DataFrame:
    """Entries with one value for each cell: repeated cells are summed."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def partition_indicator(labels: DataFrame) -> DataFrame:
    """One-hot membership matrix of (id, label)."""
    return labels.select(F.col("id").alias("i"), F.col("label").alias("j"), F.lit(1.0).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product; cells that have summands are kept even where they add up to zero."""
    x, y = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell by cell product, for cells that both have."""
    return a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"]).select("i", "j", (F.col("x") * F.col("y")).alias("v"))


def _divided(a: DataFrame, key: str, total) -> DataFrame:
    """Values over a total of their row or column; a join, so that a long one is no single task's."""
    sums = a.groupBy(key).agg(total.alias("total"))
    return a.join(sums, key).select("i", "j", F.when(F.col("total") > 0, F.col("v") / F.col("total")).otherwise(F.col("v")).alias("v"))


def normalise_cols_l2(a: DataFrame) -> DataFrame:
    """Columns of length one; zero columns stay."""
    return _divided(a, "j", F.sqrt(F.sum(F.col("v") * F.col("v"))))


def normalise_rows_l1(a: DataFrame) -> DataFrame:
    """Rows whose absolute values add up to one; zero rows stay."""
    return _divided(a, "i", F.sum(F.abs("v")))


def clip(a: DataFrame, low: float, high: float) -> DataFrame:
    return a.select("i", "j", F.least(F.greatest("v", F.lit(float(low))), F.lit(float(high))).alias("v"))


def matmul_dense(a: DataFrame, rows: DataFrame) -> DataFrame:
    """Product with a dense matrix (id, pos): (i, pos) for rows of ``a`` that have entries."""
    wide = a.join(rows.select(F.col("id").alias("j"), "pos"), "j").select("i", "v", F.posexplode("pos").alias("c", "x"))
    sums = wide.groupBy("i", "c").agg(F.sum(F.col("v") * F.col("x")).alias("x"))
    return sums.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda e: e["x"]).alias("pos"))


def to_adjacency_list(a: DataFrame) -> DataFrame:
    return a.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("j").alias("dst"), F.col("v").alias("w")))).alias("adj"))


def to_dense(a: DataFrame, n_cols: int) -> DataFrame:
    """(id, pos) with ``n_cols`` values a row, for rows that have entries."""
    cells = F.map_from_entries(F.collect_list(F.struct("j", "v")))
    rows = a.groupBy(F.col("i").alias("id")).agg(cells.alias("m"))
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)), lambda c: F.coalesce(F.try_element_at("m", c.cast("bigint")), F.lit(0.0))).alias("pos"))


def from_dense(rows: DataFrame) -> DataFrame:
    """(i, j, v) of a dense matrix (id, pos)."""
    return rows.select(F.col("id").alias("i"), F.posexplode("pos").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")


def nnz(a: DataFrame) -> int:
    return a.count()

