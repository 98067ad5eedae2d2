"""Structured Streaming: sessions, hopping windows, running counts, and merged notes with state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import shared_path

WATERMARK = "10 minutes"


def sessions(events: DataFrame, gap: str, late: str = WATERMARK) -> DataFrame:
    """Events of a user no further apart than ``gap`` (at just the gap still together): start, end and count."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def hops(events: DataFrame, size: str, slide: str, late: str = WATERMARK) -> DataFrame:
    h = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return h.select("event_type", F.col("w.start").alias("start"), "n")


def bigram_counts(pairs: DataFrame) -> DataFrame:
    """Running counts of (before, token): weights are computed from them when asked for."""
    return pairs.groupBy("before", "token").agg(F.count("*").alias("n"))


LATE_MS = 600_000  # after the last event of a group what is still open is given out
Fold = Callable[[list | None, tuple], tuple[list | None, tuple | None]]


def folded(events: DataFrame, key: str, order: list[str], columns: list[str], step: Fold, close: Callable[[list], tuple | None], out: str, state: str, late: str = WATERMARK) -> DataFrame:
    """A fold over each key's events in order: ``step`` takes the state and a row of ``columns`` to the next state and perhaps a
    row to give out; ``close`` makes of an open state its last row, when nothing came for some time. out: schema, the key first."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = list(held.get)[:-1] if held.exists else None
        if held.hasTimedOut:
            last = close(now)
            held.remove()
            yield pd.DataFrame([(k[0], *last)] if last else [], columns=names)
            return
        done, rows = [], pd.concat(list(batches)).sort_values(order)
        for row in zip(*(rows[c] for c in columns), strict=True):
            now, given = step(now, row)
            if given:
                done.append((k[0], *given))
        seen = int(rows["ts"].max().timestamp() * 1000)
        if now is None:
            if held.exists:
                held.remove()
        else:
            held.update((*now, seen))
            held.setTimeoutTimestamp(max(seen, held.getCurrentWatermarkMs()) + LATE_MS)
        yield pd.DataFrame(done, columns=names)

    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(run, out, state + ", seen long", "append", GroupStateTimeout.EventTimeTimeout)


def _same(now: list | None, row: tuple) -> tuple[list, tuple | None]:
    ts, kind = row
    if now is not None and now[0] == kind:
        return [kind, now[1], max(now[2], ts), now[3] + 1], None
    return [kind, ts, ts, 1], tuple(now) if now else None


def merged_runs(events: DataFrame, late: str = WATERMARK) -> DataFrame:
    """Runs of equal events of a user, given out when they break or time out."""
    out, state = "user_id long, event_type string, start timestamp, end timestamp, n long", "event_type string, start timestamp, end timestamp, n long"
    return folded(events, "user_id", ["ts", "event_id"], ["ts", "event_type"], _same, tuple, out, state, late)


def silences(frames: DataFrame, threshold: float, least: float, late: str = WATERMARK) -> DataFrame:
    """(recording_id, start, end) of the runs of quiet frames (ts, recording_id, frame_id, t, energy) that last."""
    lasting = lambda now: tuple(now) if now[1] - now[0] >= least else None

    def step(now: list | None, row: tuple) -> tuple[list | None, tuple | None]:
        t, energy = row
        if energy < threshold:
            return [now[0] if now else t, t], None
        return None, lasting(now) if now else None

    return folded(frames, "recording_id", ["ts", "frame_id"], ["t", "energy"], step, lasting, "recording_id long, start double, end double", "start double, end double", late)


def merged_notes(notes: DataFrame, tolerance: float, most_gap: float, dropout: float, short: float, late: str = WATERMARK) -> DataFrame:
    """Notes (ts, recording_id, note_id, start, end, midi, energy) joined as ``phrases.merge_notes`` does: the state is the note that
    is still open."""

    def step(now: list | None, row: tuple) -> tuple[list, tuple | None]:
        id_, start, end, midi, energy = row
        if now is None:
            return list(row), None
        gap, length, own = start - now[2], now[2] - now[1], end - start
        heals = gap <= dropout + 1e-9 and min(length, own) <= short + 1e-9
        if abs(midi - now[3]) < tolerance and (gap <= most_gap + 1e-9 or heals):
            whole = length + own
            mixed = (now[4] * length + energy * own) / whole if whole > 0 else max(now[4], energy)
            return [now[0], now[1], max(now[2], end), now[3], mixed], None
        return list(row), tuple(now)

    columns = "note_id long, start double, end double, midi double, energy double"
    return folded(notes, "recording_id", ["ts", "note_id"], ["note_id", "start", "end", "midi", "energy"], step, tuple, "recording_id long, " + columns, columns, late)


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote: in complete mode the last result."""
    path = shared_path(spark, f"stream-{uuid.uuid4().hex}")
    write = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        q = write.format("parquet").option("path", f"{path}/out").outputMode("append").start()
    else:
        q = write.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def source(spark: SparkSession, sf_dir: str, name: str = "events", prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """A table's Parquet file or folder as a stream, with timestamps of the session's time zone."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")
    return prepare(stream)
