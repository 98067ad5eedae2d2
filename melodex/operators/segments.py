"""Segments: overlapping windows over phrases, each as long as its tokens ask for, chained by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import settled

#: Phrases of a recording that one task sums up in order.
BLOCK = 4096


def running_tokens(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds before: the tokens of all earlier phrases of the recording. Phrases are numbered from 0 without gaps. Sums run within
    blocks of phrases and over the blocks' totals, so no task holds a whole recording."""
    rows = sizes.withColumn("_block", F.floor(F.col("phrase") / block))
    w = Window.partitionBy("recording_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("recording_id", "_block").agg(F.sum("tokens").alias("_sum"))
    whole = whole.select("recording_id", "_block", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    within = Window.partitionBy("recording_id", "_block").orderBy("phrase").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_part", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return rows.join(whole, ["recording_id", "_block"]).withColumn("before", F.col("_base") + F.col("_part")).drop("_block", "_base", "_part")


def reaches(sizes: DataFrame, least: int) -> DataFrame:
    """(recording_id, phrase, stop, total): from each phrase the first phrase after the window that begins there: it goes on
    until it has ``least`` tokens, or to the recording's end. total: the tokens from the phrase to that end.

    The phrase in which the wanted sum is reached is the one whose tokens cover it: an equi-join on buckets of sums.
    """
    rows = running_tokens(sizes)
    width = 8 * least
    last = rows.groupBy("recording_id").agg(F.max("phrase").alias("_last"), F.sum("tokens").alias("_all"))
    after = F.col("before") + F.col("tokens")
    cover = rows.select("recording_id", F.col("phrase").alias("_at"), F.col("before").alias("_from"), after.alias("_to"), F.explode(F.sequence(F.floor(F.col("before") / width), F.floor(after / width))).alias("_b"))
    want = rows.select("recording_id", "phrase", "before", (F.col("before") + least).alias("_want")).withColumn("_b", F.floor(F.col("_want") / width))
    met = want.alias("w").join(cover.alias("c"), F.expr("w.recording_id = c.recording_id and w._b = c._b and c._from < w._want and w._want <= c._to"), "left")
    met = met.select("w.recording_id", "w.phrase", "w.before", F.col("c._at").alias("_at"))
    return met.join(last, "recording_id").select("recording_id", "phrase", (F.coalesce("_at", "_last") + 1).alias("stop"), "before", (F.col("_all") - F.col("before")).alias("total"))


def segments(sizes: DataFrame, least: int) -> DataFrame:
    """(recording_id, segment, first, stop, tokens): windows over the phrases (recording_id, phrase, tokens), numbered from 0
    without gaps and with a token each at least. A window goes on until it has ``least`` tokens, or to the end; the next
    begins half its phrases later, one at least, as long as there is one; ``stop`` is the phrase after its last.

    Where a window begins depends on the one before. All possible beginnings know their next one; in each round, those that are
    known to be reached hand on to the place that lies as many windows further as rounds have doubled, and every place learns
    the one twice as far. So a recording of n windows takes log n rounds of joins, and no task walks it.
    """
    ends = settled(reaches(sizes, least), "reaches")
    size = F.col("stop") - F.col("phrase")
    ahead = ends.select("recording_id", "phrase", (F.col("phrase") + F.greatest(F.lit(1), F.floor(size / 2))).alias("next"))
    real = ahead.select("recording_id", F.col("phrase").alias("next"))
    jump = settled(ahead.join(real, ["recording_id", "next"], "left_semi").select("recording_id", "phrase", "next"), "jumps")
    found = settled(ends.where("phrase = 0").select("recording_id", "phrase", F.lit(0).cast("long").alias("segment")), "reached")
    step = 1
    while True:
        more = found.join(jump, ["recording_id", "phrase"]).select("recording_id", F.col("next").alias("phrase"), (F.col("segment") + step).alias("segment"))
        more = settled(more, "reached")
        if more.isEmpty():
            break
        found = found.unionByName(more)
        further = jump.select("recording_id", F.col("phrase").alias("next"), F.col("next").alias("_then"))
        jump = settled(jump.join(further, ["recording_id", "next"]).select("recording_id", "phrase", F.col("_then").alias("next")), "jumps")
        step *= 2
    there = ends.select("recording_id", F.col("phrase").alias("stop"), F.col("total").alias("_left"))
    out = found.join(ends, ["recording_id", "phrase"]).join(there, ["recording_id", "stop"], "left")
    return out.select("recording_id", "segment", F.col("phrase").alias("first"), "stop", (F.col("total") - F.coalesce("_left", F.lit(0))).alias("tokens"))


def over_segments(found: DataFrame, per_phrase: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """(recording_id, segment, by..., sums...): per-phrase sums added up over the phrases of each segment."""
    each = found.select("recording_id", "segment", F.explode(F.sequence("first", F.col("stop") - 1)).alias("phrase"))
    return each.join(per_phrase, ["recording_id", "phrase"]).groupBy("recording_id", "segment", *by).agg(*[F.sum(c).alias(c) for c in sums])
