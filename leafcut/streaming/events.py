"""The worker's event stream: JSON lines of ``type`` and ``data``."""

from __future__ import annotations

import time
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState

ROUTED = ["progress", "result", "error"]
EVENT = "type string, data string, ts timestamp, key string"
CELL = 1 << 20  # milliseconds; so many different times at most are held at once


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON lines in a folder; blank lines are skipped, lines that are no JSON become error events."""
    lines = spark.readStream.text(folder).where(F.length(F.trim("value")) > 0)
    return parse_events(lines)


def parse_events(lines: DataFrame) -> DataFrame:
    e = F.from_json("value", EVENT)
    bad = e.isNull() | e["type"].isNull()
    return lines.select(F.when(bad, "error").otherwise(e["type"]).alias("type"), F.when(bad, F.concat(F.lit("Invalid JSON: "), "value")).otherwise(e["data"]).alias("data"), e["ts"].alias("ts"), e["key"].alias("key"))


def route(events: DataFrame) -> DataFrame:
    """Progress, results and errors; other types go nowhere."""
    return events.where(F.col("type").isin(ROUTED)).withColumn("channel", F.concat(F.lit("python_"), "type"))


def _spaced(ms: np.ndarray, step: int, last: int | None) -> tuple[np.ndarray, int | None]:
    """Which of some sorted times go on: those at least ``step`` after the one that went on before."""
    out = np.zeros(len(ms), bool)
    k = 0 if last is None else int(np.searchsorted(ms, last + step))
    while k < len(ms):
        out[k], last = True, int(ms[k])
        k = int(np.searchsorted(ms, last + step))
    return out, last


def _starts(rows: pa.Table | pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Where rows sorted by key and cell begin a cell, and numbers that tell the keys of these rows apart."""
    column = rows.column(key)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    k, cell = column.dictionary_encode(null_encoding="encode").indices.to_numpy(), rows.column("_cell").to_numpy()
    return np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (cell[1:] != cell[:-1])]), k


def _of(rows: pa.Table | pa.RecordBatch, key: str, at: int) -> tuple:
    return rows.column(key)[at].as_py(), rows.column("_cell")[at].as_py()


def _whole_cells(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            last = int(_starts(rows, key)[0][-1])
            if held and (last or _of(held[-1], key, -1) != _of(rows, key, 0)):
                yield pa.concat_tables([*held, rows.slice(0, last)])
                held = []
            elif last:
                yield rows.slice(0, last)
            held.append(rows.slice(last))
    if held:
        yield pa.concat_tables(held)


def _following(ms: np.ndarray, cell: np.ndarray, starts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the first one ``step`` or more later, or the end of its cell; and the ends of the cells."""
    ends = np.r_[starts[1:], len(ms)]
    at = ms - cell * CELL + np.repeat(np.arange(len(starts)), ends - starts) * (CELL + step)
    return np.searchsorted(at, at + step), ends


def _crossings(key: str, step: int):
    """Of each cell: which of its times goes on last (``leave``) if ``enter`` is the first to go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches, key):
            ms, cell, (starts, _) = rows.column("_ms").to_numpy(), rows.column("_cell").to_numpy(), _starts(rows, key)
            following, ends = _following(ms, cell, starts, step)
            leave, to, end = [0] * len(ms), following.tolist(), np.repeat(ends, ends - starts).tolist()
            for k in range(len(ms) - 1, -1, -1):
                leave[k] = leave[to[k]] if to[k] < end[k] else k
            out = np.array(leave)
            first = np.zeros(len(ms), bool)  # what can go on first: times up to the first that is ``step`` after the cell's start
            first[starts] = True
            first[1:] |= (ms - cell * CELL)[:-1] < step
            at = np.flatnonzero(first)
            number = np.repeat(np.arange(len(starts)), ends - starts)[at]
            at = at[np.r_[(out[at][1:] != out[at][:-1]) | (number[1:] != number[:-1]), True]]
            got = rows.select([key, "_cell"]).take(pa.array(at)).append_column("enter", pa.array(ms[at])).append_column("leave", pa.array(ms[out[at]]))
            yield from got.combine_chunks().to_batches()

    return run


def _entries(key: str, step: int):
    """Of each cell, what went on last before it; cells are walked in order, key by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, None
        for rows in _whole_cells(batches, key):
            (starts, k), enter, leave = _starts(rows, key), rows.column("enter").to_pylist(), rows.column("leave").to_pylist()
            lasts: list[int | None] = []
            for n, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(enter)])):
                if (k[a] != k[a - 1]) if n else before != (rows.column(key)[0].as_py(),):
                    last = None
                lasts.append(last)
                at = a if last is None else bisect_left(enter, last + step, a, b)
                last = leave[at] if at < b else last
            before = (rows.column(key)[-1].as_py(),)
            got = rows.select([key, "_cell"]).take(pa.array(starts)).append_column("_last", pa.array(lasts, pa.int64()))
            yield from got.combine_chunks().to_batches()

    return run


def _going(key: str, step: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, None
        for rows in batches:
            if not rows.num_rows:
                continue
            ms, cell, (starts, _) = rows.column("_ms").to_numpy(), rows.column("_cell").to_numpy(), _starts(rows, key)
            following, ends = _following(ms, cell, starts, step)
            to, given, out = following.tolist(), rows.column("_last").take(pa.array(starts)).to_pylist(), np.zeros(len(ms), bool)
            for n, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                last = last if not n and before == _of(rows, key, 0) else given[n]
                k = a if last is None else a + int(np.searchsorted(ms[a:b], last + step))
                while k < b:
                    out[k], last = True, int(ms[k])
                    k = to[k]
            before = _of(rows, key, -1)
            yield rows.filter(pa.array(out)).select(columns)

    return run


def throttle(events: DataFrame, seconds: float = 2.0, ts: str = "ts", key: str = "key", order: str | None = None, force: str | None = None) -> DataFrame:
    """Of each key the first event, then each that comes ``seconds`` or more after the last one that went on. Rows whose
    column ``force`` is true go on in any case and do not count as the last. For batches and streams.

    A batch is cut into cells of ``CELL`` milliseconds, so that no key's events have to be in one task: first each cell is
    run through from every time at which it can be entered, then the cells of a key are walked by a row for each of these,
    then each cell is run through from where it was entered. ``order`` tells apart events of one time. In a stream, the last
    time is kept per key; events that arrive behind it do not go on. Null times do not go on.
    """
    step, columns = int(seconds * 1000), events.columns
    free = F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False)
    bound = events.where(~free & F.col(ts).isNotNull()).withColumn("_ms", F.unix_millis(ts))
    if step <= 0 and not events.isStreaming:
        through = bound.select(columns)
    elif events.isStreaming:

        def keep(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(parts).sort_values(["_ms", *([order] if order else [])], kind="stable")
            went, last = _spaced(pdf["_ms"].to_numpy(), step, state.get[0] if state.exists else None)
            if last is not None:
                state.update((last,))
            yield pdf.loc[went, columns]

        through = bound.groupBy(key).applyInPandasWithState(keep, events.schema, "last long", "append", "NoTimeout")
    else:
        cells = bound.withColumn("_cell", F.floor(F.col("_ms") / CELL))
        kind = events.schema[key].dataType.simpleString()
        times = cells.select(key, "_cell", "_ms").repartition(key, "_cell").dropDuplicates().sortWithinPartitions(key, "_cell", "_ms")
        crossings = times.mapInArrow(_crossings(key, step), f"`{key}` {kind}, _cell long, enter long, leave long")
        entries = crossings.repartition(key).sortWithinPartitions(key, "_cell", "enter").mapInArrow(_entries(key, step), f"`{key}` {kind}, _cell long, _last long")
        entries = entries.select(F.col(key).alias("_k"), F.col("_cell").alias("_c"), "_last")
        known = cells.join(entries, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_cell") == F.col("_c")), "left").drop("_k", "_c")
        known = known.repartition(key, "_cell").sortWithinPartitions(key, "_cell", "_ms", *([order] if order else []))
        through = known.mapInArrow(_going(key, step, columns), events.schema)
    return through.unionByName(events.where(free)) if force else through


def latest_status(events: DataFrame, key: str, order: Column, status: str = "status") -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, order).alias(status))


def to_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines for a text sink."""
    return events.select(F.to_json(F.struct("type", "data")).alias("value"))


def stop_after(query: StreamingQuery, seconds: float, cancelled: Callable[[], bool] = lambda: False, step: float = 0.1) -> str:
    """Wait for a stream: ``ended`` if it ended by itself, else stopped by ``cancelled`` or ``timeout``. Its errors are raised."""
    until = time.monotonic() + seconds
    while True:
        if query.awaitTermination(step):
            return "ended"
        if cancelled() or time.monotonic() > until:
            query.stop()
            return "cancelled" if cancelled() else "timeout"


class Progress(StreamingQueryListener):
    """Calls ``report(rows so far, rows of this batch, query's name)`` after each batch of a stream."""

    def __init__(self, report: Callable[[int, int, str | None], None]):
        self.report, self.rows = report, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        own = event.progress.numInputRows
        self.rows += own
        self.report(self.rows, own, event.progress.name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
