"""Exact deduplication by content sort.

Sampled splitters range-partition the rows by their normalised bytes, Spark's external
sort places equal texts next to each other, and a streaming kernel compares each text in
full with its neighbour.

The sort key is (first 32 bytes of the text, SHA-256 of the text, identifier, place of the row in the
input). The digest
stands for the remaining bytes, so a splitter has some 100 bytes and the sample that the
range partitioner sends to the driver stays small however long the texts are. With identifier
and place last in the key, splitters also fall *inside* a group of copies: a group that
holds a third of all rows spans as many partitions as its size asks for, and no task gets
more than its share. What is known at the end of a partition is only that its first and
last runs may go on next door; these two runs of each partition ("open") are summed in a
table of at most two rows a partition, which is small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import only
from tessera.runtime import cut, fresh

PREFIX_BYTES = 32


def _text_key(text: Column) -> tuple[Column, Column]:
    return F.substring(F.encode(text, "UTF-8"), 1, PREFIX_BYTES), F.sha2(text, 256)


def _run_starts(texts: pa.Array, shas: pa.Array, last: tuple[str, str] | None) -> np.ndarray:
    """Whether each row begins a run of equal texts; ``last`` is the row before the batch."""
    n = len(texts)
    starts = np.ones(n, dtype=bool)
    if n > 1:
        same = pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if np.any(~same & pc.equal(shas.slice(1), shas.slice(0, n - 1)).to_numpy(zero_copy_only=False)):
            raise RuntimeError("two different texts have the same SHA-256 digest")
        starts[1:] = ~same
    if last is not None:
        starts[0] = texts[0].as_py() != last[1]
    return starts


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, sha, first_id, last_id, n, open) of one sorted partition.

    A run that ends inside the partition is final. Its rows wait until it ends, as 8-byte
    identifiers only; the first and the last run are marked open with this partition's share.
    """
    ids: list[np.ndarray] = []
    valid: list[np.ndarray] = []
    sha, last, first_run = "", None, True

    def flush(is_last: bool) -> pa.RecordBatch:
        nonlocal first_run
        run = pa.array(np.concatenate(ids), type=pa.int64(), mask=~np.concatenate(valid))
        low, high = pc.min_max(run).values() if run.null_count < len(run) else (pa.scalar(None, pa.int64()),) * 2
        out = pa.RecordBatch.from_arrays(
            [run, pa.array([sha] * len(run)), *(pa.array([x.as_py()] * len(run), pa.int64()) for x in (low, high)), pa.array(np.full(len(run), len(run))), pa.array(np.full(len(run), first_run or is_last))],
            names=["doc_id", "sha", "first_id", "last_id", "n", "open"],
        )
        first_run = False
        ids.clear()
        valid.clear()
        return out

    def whole(b: int, e: int, batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        """The runs that lie wholly within rows b to e of a batch, all final."""
        at = np.flatnonzero(starts[b:e])
        sizes = np.diff(np.append(at, e - b))
        doc = batch.column("doc_id").slice(b, e - b)
        heads, tails = np.repeat(at, sizes), np.repeat(at + sizes - 1, sizes)
        # within a run identifiers ascend with nulls first, so the last one is the largest
        order = doc.is_valid().to_numpy(zero_copy_only=False)
        rank = np.where(order, np.arange(e - b), e - b)
        low = np.repeat(np.minimum.reduceat(rank, at), sizes)
        low = np.where(low >= e - b, heads, low)
        return pa.RecordBatch.from_arrays(
            [doc, batch.column("sha").slice(b, e - b), doc.take(pa.array(low)), doc.take(pa.array(tails)), pa.array(np.repeat(sizes, sizes)), pa.array(np.zeros(e - b, dtype=bool))],
            names=["doc_id", "sha", "first_id", "last_id", "n", "open"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, shas = batch.column("text"), batch.column("sha")
        starts = _run_starts(texts, shas, last)
        at = np.flatnonzero(starts)
        doc = batch.column("doc_id")
        values = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False)
        ok = doc.is_valid().to_numpy(zero_copy_only=False)
        head = at[0] if len(at) else batch.num_rows
        if head:  # rows that go on with the waiting run
            ids.append(values[:head])
            valid.append(ok[:head])
        if len(at):
            if ids:
                yield flush(False)
            begin = at[0]
            if first_run and len(at) > 1:  # the very first run of the partition is open
                ids.append(values[at[0] : at[1]])
                valid.append(ok[at[0] : at[1]])
                sha = shas[int(at[0])].as_py()
                yield flush(False)
                begin = at[1]
            if begin < at[-1]:
                yield whole(int(begin), int(at[-1]), batch, starts)
            ids.append(values[at[-1] :])
            valid.append(ok[at[-1] :])
            sha = shas[int(at[-1])].as_py()
        last = (sha, texts[batch.num_rows - 1].as_py())
    if ids:
        yield flush(True)


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, text_sha256, keep_id, group_size, kept.

    ``keep`` is "smallest" or "largest": the identifier that stays in each group of rows
    whose normalised texts are equal (``normalise``: none by default; a null text is an
    empty one). Null identifiers never win against others. Where a kept identifier is
    repeated within its group, every row that carries it is ``kept``; in a group without any
    identifier keep_id is null and no row is kept by identifier (``drop_exact`` decides by
    row). An empty table gives an empty result, and other columns are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = only(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), (normalise(text) if normalise else text).alias("text"))
    prefix, sha = _text_key(F.col("text"))
    rows, keys = rows.withColumns({"prefix": prefix, "sha": sha, "place": F.monotonically_increasing_id()}), ["prefix", "sha", "doc_id", "place"]
    runs = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "sha", "text").mapInArrow(_groups, "doc_id long, sha string, first_id long, last_id long, n long, open boolean"))
    # at most two open runs a partition; their shares are pre-aggregated by the kernel
    opened = runs.where("open").groupBy("sha").agg(F.min("first_id").alias("first_all"), F.max("last_id").alias("last_all"), F.count(F.lit(1)).alias("n_all"))
    joined = runs.where("open").join(F.broadcast(opened), "sha").select("doc_id", "sha", F.col("first_all").alias("first_id"), F.col("last_all").alias("last_id"), F.col("n_all").alias("n"))
    both = runs.where("not open").select("doc_id", "sha", "first_id", "last_id", "n").unionByName(joined)
    stays = F.col("first_id" if keep == "smallest" else "last_id")
    return both.select("doc_id", stays.alias("keep_id"), F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == stays, F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``df`` with one row for each distinct text (null: empty), all columns unchanged.

    The row with the smallest or largest identifier stays; of rows that repeat that
    identifier one stays, and a group without identifiers keeps one row as well.
    """
    prefix_c, sha_c, place_c, part_c, mark_c = (fresh(f"__{x}", df) for x in ("prefix", "sha", "place", "part", "mark"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    prefix, sha = _text_key(text)
    id_ = F.col(f"`{id_col}`")
    order = [F.col(prefix_c), F.col(sha_c), id_.asc_nulls_last() if keep == "smallest" else id_.desc_nulls_last(), F.col(place_c)]
    rows = df.withColumns({prefix_c: prefix, sha_c: sha, place_c: F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField(sha_c, T.StringType()), T.StructField(part_c, T.LongType()), T.StructField(mark_c, T.IntegerType())])
    names = [f.name for f in schema.fields]
    n_cols = len(df.columns)
    text_at = df.columns.index(text_col)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each run; mark 1 on the partition's first run, which may have begun before."""
        part, last, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, shas = pc.fill_null(batch.column(text_at), ""), batch.column(n_cols + 1)
            starts = _run_starts(texts, shas, last)
            last = (shas[batch.num_rows - 1].as_py(), texts[batch.num_rows - 1].as_py())
            some = batch.filter(pa.array(starts))
            marks = np.zeros(some.num_rows, dtype=np.int32)
            if first and some.num_rows:
                marks[0], first = 1, False
            yield pa.RecordBatch.from_arrays([*some.columns[:n_cols], some.column(n_cols + 1), pa.array(np.full(some.num_rows, part)), pa.array(marks)], names=names)

    # The range bounds are sampled anew whenever the exchange is planned, so the rows that stay are
    # written once and read twice.
    heads = cut(rows.mapInArrow(firsts, schema))
    # A partition's first run may have begun in an earlier partition. At most one digest a partition
    # is in doubt; the earliest partition that has it owns the row.
    doubtful = heads.where(F.col(mark_c) == 1).select(F.col(sha_c)).distinct()
    owner_c = fresh("__owner", df)
    owner = heads.select(sha_c, part_c).join(F.broadcast(doubtful), sha_c, "left_semi").groupBy(sha_c).agg(F.min(part_c).alias(owner_c))
    out = heads.join(F.broadcast(owner), sha_c, "left").where(F.col(owner_c).isNull() | (F.col(owner_c) == F.col(part_c)))
    return out.select(*(F.col(f"`{c}`") for c in df.columns))
