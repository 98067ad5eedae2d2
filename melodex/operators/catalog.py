"""Library rows, freshness, versions, edits and resumable results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT_EDIT = 1e-3


def freshness(path: Column, recorded: Column, current: Column) -> Column:
    """missing without a report, unknown without a recorded fingerprint, else current or stale."""
    return F.when(path.isNull(), "missing").when(recorded.isNull(), "unknown").when(recorded == current, "current").otherwise("stale")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: of an append-only log, the one that counts."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order)))).where("_r = 1").drop("_r")


def counts_of(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with a count for each of fixed values, zero if absent."""
    return rows.agg(*(F.coalesce(F.sum((F.col(column) == v).cast("long")), F.lit(0)).alias(v) for v in values))


def next_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    number = F.regexp_extract(version, r"(\d+)$", 1).try_cast("long")
    return rows.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def resolve(candidates: DataFrame, key: list[str], priority: str) -> DataFrame:
    """Of several sources for a key, that of the least priority number."""
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(priority))).where("_r = 1").drop("_r")


def normal_notes(notes: DataFrame) -> DataFrame:
    """Edited notes (song, note_id, pos, start, end): the first of an id counts (of one
    pos by its times); ends before starts are swapped; a note lasts
    at least a millisecond."""
    rows = notes.withColumn("_r", F.row_number().over(Window.partitionBy("song", "note_id").orderBy("pos", "start", "end"))).where("_r = 1").drop("_r")
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    return rows.withColumn("_lo", lo).withColumn("_hi", F.greatest(hi, lo + UNIT_EDIT)).withColumn("start", F.col("_lo")).withColumn("end", F.col("_hi")).drop("_lo", "_hi")


def owned(notes: DataFrame, phrases: DataFrame) -> DataFrame:
    """(song, note_id, phrase): a note belongs to the first phrase that names it; one that none names is a phrase of its own."""
    named = phrases.select("song", "phrase", F.explode("note_ids").alias("note_id"))
    named = named.withColumn("_r", F.row_number().over(Window.partitionBy("song", "note_id").orderBy("phrase"))).where("_r = 1").drop("_r")
    return notes.join(named, ["song", "note_id"], "left").withColumn("phrase", F.coalesce("phrase", F.concat(F.lit("auto-"), F.col("note_id").cast("string"))))


def replay(notes: DataFrame, log: DataFrame) -> DataFrame:
    """Notes (recording_id, note_id, start, end, midi) after a log of edits (recording_id, note_id, op, seq, start, end, midi), of which
    the last of a note counts: ``delete`` takes it away, ``move`` gives an existing one new bounds, ``add`` makes or remakes it."""
    keys = ["recording_id", "note_id"]
    last = latest(log, keys, ["seq"]).select(*keys, "op", *[F.col(c).alias(f"_{c}") for c in ("start", "end", "midi")])
    met = notes.withColumn("_there", F.lit(True)).join(last, keys, "full")
    op = F.col("op")
    kept = op.isNull() | ((op == "move") & F.col("_there")) | (op == "add")
    pick = lambda c: F.when(op.isNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return met.where(kept).select(*keys, pick("start"), pick("end"), F.coalesce("midi", "_midi").alias("midi"))
