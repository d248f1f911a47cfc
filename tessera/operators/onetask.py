"""Running a NumPy kernel over a whole small table in one task.

Only for stages that are sequential by nature and whose rows are a few numbers per vector (trees and
layouts below a stated size). The task gets the rows sorted, so its result is the same wherever it
runs, and a lost executor only repeats it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def in_one_task(df: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: list[str]) -> DataFrame:
    columns = df.columns

    def run(batches):
        parts = list(batches)
        whole = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in columns})
        out = kernel(whole)
        if len(out):
            yield out

    return df.repartition(1).sortWithinPartitions(*order).mapInPandas(run, schema)
