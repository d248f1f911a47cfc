"""Arrow plumbing shared by the text operators.

A kernel sees the texts of a bounded slice of rows at a time and returns one Arrow array
for each new column; all other columns pass through untouched and are never copied to
pandas. Slices are bounded by bytes, not rows, so a few very long texts cannot exhaust a
worker's memory: a slice holds at most ``max_bytes`` of text, or a single row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import fresh

SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` into runs of rows whose ``column`` holds at most ``max_bytes``."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, base + max_bytes, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def cut_text(text: str, most: int) -> Iterator[str]:
    """Pieces of a text of at most ``most`` signs, which end before a blank where there is one in the later half."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(blank, at + most // 2, at + most) for blank in " \n\t")
        end = end if end > at else at + most
        yield text[at:end]
        at = end
    yield text[at:]


def append_columns(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    kernel_factory: Callable[[], Callable[[list[str]], list[pa.Array]]],
    max_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` with new columns computed from the whole text of each row (null: empty).

    ``kernel_factory`` runs once for each task, so it may build tables there; its kernel
    maps a list of texts to one array for each of ``fields``. A field whose name is taken (case
    ignored) is called the same with underscores at its end; the new columns are always the last ones.
    """
    fields = [T.StructField(fresh(f.name, df), f.dataType, f.nullable) for f in fields]
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = kernel_factory()
        for batch in batches:
            for part in slices(batch, text, max_bytes):
                texts = [t or "" for t in part.column(text).to_pylist()]
                new = kernel(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns of ``df`` under fixed names, so extra columns cannot clash."""
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in columns.items()))


def flat_codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the n + 1 bounds of the texts in it."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, dtype=np.uint32), bounds
