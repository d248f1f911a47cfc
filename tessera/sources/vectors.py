"""Reading vectors and precomputed neighbour tables, writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id BIGINT, embedding ARRAY<DOUBLE>); rows without either are left out."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("id IS NOT NULL AND embedding IS NOT NULL")


def read_vectors(spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding", fmt: str = "parquet") -> DataFrame:
    """Vectors of a file or folder in any format Spark reads; only the two columns are scanned."""
    return vectors(spark.read.format(fmt).load(path), id_col, vector_col)


def precomputed_knn(df: DataFrame) -> DataFrame:
    """A neighbour table (src, rank, dst, dist) in its types, checked.

    Raises ValueError for missing columns, loops, negative or missing distances and repeated
    pairs. Ranks are made anew from the distances, so gaps in them do no harm.
    """
    if missing := {"src", "dst", "dist"} - set(df.columns):
        raise ValueError(f"neighbour table lacks {sorted(missing)}")
    rows = df.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("dist").cast("double").alias("dist"))
    bad = rows.agg(
        F.sum(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"),
        F.sum(F.when(F.col("dist").isNull() | F.isnan("dist") | (F.col("dist") < 0) | F.col("src").isNull() | F.col("dst").isNull(), 1)).alias("broken"),
    ).first()
    if bad["loops"] or bad["broken"]:
        raise ValueError(f"neighbour table has {bad['loops'] or 0} loops and {bad['broken'] or 0} broken rows")
    if not rows.groupBy("src", "dst").count().where("count > 1").isEmpty():
        raise ValueError("neighbour table repeats pairs")
    from tessera.operators.knn import ranked

    return ranked(rows)


def write_result(frames: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write each frame of a result to a folder of its own."""
    for name, df in frames.items():
        df.write.format(fmt).mode("errorifexists").save(f"{path}/{name}")
