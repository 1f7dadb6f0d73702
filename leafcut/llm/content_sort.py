"""Exact deduplication by sorting content.

Sampled splitters range-partition the normalised texts, Spark's external sort
places equal texts next to each other, and neighbours are compared in full.
The splitters are cut from a short lead of the text, its SHA-256 and the
identifier, so the driver samples narrow keys only, and a text that a third of
all rows carry is spread over many partitions; the runs at the seams of
neighbouring partitions are then compared by their SHA-256 (two for each
partition meet in one task) and joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafcut.llm.shared import Scratch, text_bytes, tidy

LEAD_CHARS = 32
RUNS = "id long, keep_local long, size_local long, first_local boolean, sha binary, pid int, slot int, edge binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one sorted partition. slot: 0 inside, 1 first run, 2 last run, 3 both."""
    pid = TaskContext.get().partitionId()
    schema = pa.schema([("id", pa.int64()), ("keep_local", pa.int64()), ("size_local", pa.int64()), ("first_local", pa.bool_()), ("sha", pa.binary()), ("pid", pa.int32()), ("slot", pa.int32()), ("edge", pa.binary())])
    held: list[tuple] = []
    rows = 0
    text, ids, n_runs = None, [], 0

    def close(last: bool) -> None:
        nonlocal rows
        slot = (1 if n_runs == 1 else 0) + (2 if last else 0)
        held.append((ids, text, slot))
        rows += len(ids)

    def out() -> pa.RecordBatch:
        nonlocal held, rows
        cols: list[list] = [[] for _ in schema]
        for own, t, slot in held:
            n = len(own)
            sha = hashlib.sha256(t).digest()
            for c, v in zip(cols, (own, [own[0]] * n, [n] * n, [True] + [False] * (n - 1), [sha] * n, [pid] * n, [slot] * n, [sha if slot else None] + [None] * (n - 1)), strict=True):
                c.extend(v)
        held, rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t == text:
                ids.append(i)
                continue
            if text is not None:
                close(False)
                if rows >= 4096:
                    yield out()
            text, ids = t, [i]
            n_runs += 1
    if text is not None:
        close(True)
        yield out()


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised UTF-8 bytes are. Of equal texts the row with the smallest (or
    ``keep="largest"``) identifier stays. Null text counts as empty; a null identifier comes last, so it stays
    only if all of its group are null. Of rows that repeat both identifier and text, one is kept. Other columns
    are ignored; an empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    scratch = Scratch(docs.sparkSession, "content-sort")
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text).alias("body"))
    rows = rows.select("id", "body", F.substring("body", 1, LEAD_CHARS).alias("lead"), F.unhex(F.sha2("body", 256)).alias("hash"))
    by_id = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    dealt = rows.repartitionByRange("lead", "hash", by_id).sortWithinPartitions("lead", "hash", by_id)
    runs = scratch.keep(dealt.select("id", "body").mapInArrow(tidy(_runs), RUNS))

    # Two rows at most for each partition: the runs at its ends.
    w = Window.orderBy("pid", "slot")
    ends = runs.where(F.col("edge").isNotNull()).select("pid", "slot", "keep_local", "size_local", (~F.col("edge").eqNullSafe(F.lag("edge").over(w))).alias("starts"))
    ends = ends.withColumn("seam", F.sum(F.col("starts").cast("int")).over(w))
    own = Window.partitionBy("seam")
    ends = ends.select("pid", "slot", "starts", F.first("keep_local").over(own.orderBy("pid", "slot")).alias("keep_all"), F.sum("size_local").over(own).alias("size_all"))
    return runs.join(F.broadcast(ends), ["pid", "slot"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("starts").isNull(), F.col("keep_local")).otherwise(F.col("keep_all")).alias("keep_id"),
        F.coalesce("size_all", "size_local").alias("group_size"),
        (F.col("first_local") & F.coalesce("starts", F.lit(True))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _first_rows(columns: int):
    """First row of each run of a sorted partition; after ``columns`` columns comes the normalised body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        text, n_runs, held = None, 0, None  # held: the last run's first row

        def out(rows: pa.RecordBatch, first: bool, last: bool) -> pa.RecordBatch:
            """first, last: whether the first and last of these rows are the partition's first and last run."""
            n = rows.num_rows
            slot = [0] * n
            if first:
                slot[0] += 1
            if last:
                slot[-1] += 2
            edge = [hashlib.sha256(b).digest() if s else None for b, s in zip(rows.column(columns).to_pylist(), slot, strict=True)] if first or last else [None] * n
            return pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(columns)), pa.array([pid] * n, pa.int32()), pa.array(slot, pa.int32()), pa.array(edge, pa.binary())], [*rows.schema.names[:columns], "pid", "slot", "edge"])

        for b in batches:
            firsts = []
            for k, t in enumerate(b.column(columns).to_pylist()):
                if t != text:
                    firsts.append(k)
                    text = t
            if firsts:
                if held is not None:
                    yield out(held, n_runs == 1, False)
                if len(firsts) > 1:
                    yield out(b.take(pa.array(firsts[:-1])), n_runs == 0, False)
                n_runs += len(firsts)
                held = b.take(pa.array(firsts[-1:]))
        if held is not None:
            yield out(held, n_runs == 1, True)

    return run


def content_sort_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows that stay, with all columns of ``docs``; what stays is as in ``content_sort_dedup``. Texts are shuffled once."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    scratch = Scratch(docs.sparkSession, "content-sort")
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = text_bytes(normalise(text) if normalise else text)
    # Columns travel under numbers, so that none clashes with the sort's own.
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)), body.alias("body"))
    by_id = F.col(f"c{docs.columns.index(id_col)}").cast("long")
    by_id = by_id.asc_nulls_last() if keep == "smallest" else by_id.desc_nulls_last()
    rows = rows.select("*", F.substring("body", 1, LEAD_CHARS).alias("lead"), F.unhex(F.sha2("body", 256)).alias("hash"))
    dealt = rows.repartitionByRange("lead", "hash", by_id).sortWithinPartitions("lead", "hash", by_id)
    plain = dealt.drop("lead", "hash")
    schema = plain.drop("body").schema.add("pid", "integer").add("slot", "integer").add("edge", "binary")
    runs = scratch.keep(plain.mapInArrow(tidy(_first_rows(len(docs.columns))), schema))
    w = Window.orderBy("pid", "slot")
    ends = runs.where(F.col("edge").isNotNull()).select("pid", "slot", (~F.col("edge").eqNullSafe(F.lag("edge").over(w))).alias("starts"))
    kept = runs.join(F.broadcast(ends), ["pid", "slot"], "left").where(F.coalesce("starts", F.lit(True)))
    return kept.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
