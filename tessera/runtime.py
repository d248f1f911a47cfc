"""Session helpers shared by all operators: lineage cuts, size checks, text batches."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key beyond which it is kept out of a shuffle join.
HOT_ROWS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; set one only where none is set.

    A local folder is chosen only when the session has none at all and runs on ``local[n]``, where
    driver and executors are one process; on a cluster it is an error to have none.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "tessera-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_counted(rows: DataFrame, side: DataFrame, key: str, count: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``side``, which has each key once and in ``count`` how many rows carry it.

    A key of very many rows would make one task of a shuffle join, so the keys of more than
    ``hot_rows`` are broadcast: there are at most rows / hot_rows of them. Without such keys this is a plain join.
    """
    hot = side.where(F.col(count) > hot_rows)
    if hot.isEmpty():
        return rows.join(side, key)
    usual = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(side.where(F.col(count) <= hot_rows), key)
    return usual.unionByName(rows.join(F.broadcast(hot), key).select(usual.columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of ``frames`` has it (case ignored)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
