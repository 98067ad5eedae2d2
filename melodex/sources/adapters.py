"""The test tables seen as frames, notes, scales and token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as E

#: Microseconds of the events' clock that count as one second of a recording.
UNIT = 50_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, frame_id, t_us, t, track, pitch_hz, confidence, voicing, energy."""
    return as_frames(table(spark, sf_dir, "events"))


def as_frames(events: DataFrame, *more: str) -> DataFrame:
    """Events as frames; a stream's too."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        *more, F.col("user_id").alias("recording_id"), F.col("event_id").alias("frame_id"), us.alias("t_us"), (us / F.lit(float(UNIT))).alias("t"), F.col("event_type").alias("track"),
        F.col("value").alias("pitch_hz"), (k / F.lit(100.0)).alias("confidence"), ((F.col("value") > 0) & (k % 10 != 0)).alias("voicing"), ((F.col("event_id") * 37 % 100) / F.lit(100.0)).alias("energy"),
    )


def by_time(*more: str) -> Window:
    return Window.partitionBy("recording_id", *more).orderBy("t_us", "frame_id")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as notes: recording_id, note_id, start_us, end_us, start, end, midi, pc, energy. A note lasts three fifths of the
    time to the next, at most 0.3 s."""
    f = frames(spark, sf_dir).withColumn("next", F.lead("t_us").over(by_time()))
    last = F.col("t_us") + F.floor(F.least(F.coalesce(F.col("next") - F.col("t_us"), F.lit(UNIT // 2)), F.lit(UNIT // 2)) * 3 / 5)
    midi = E.hz_to_midi("pitch_hz")
    return f.select("recording_id", F.col("frame_id").alias("note_id"), F.col("t_us").alias("start_us"), last.alias("end_us"), F.col("t").alias("start"), (last / F.lit(float(UNIT))).alias("end"), midi.alias("midi"), E.pitch_class(midi).alias("pc"), "energy", "track")


def note_order(*more: str) -> Window:
    return Window.partitionBy("recording_id", *more).orderBy("start_us", "note_id")


def scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scale_id, name, code, mask: at most three scales for each brand; the tonic always belongs to a scale."""
    groups = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 3).alias("g")).agg(F.min("p_partkey").alias("k"))
    code = (F.col("k") * 7919 + F.col("g") * 131) % 2048
    mask = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when((i == 0) | (F.floor(F.col("code") / F.pow(F.lit(2), i - 1)) % 2 == 1), 1).otherwise(0))
    named = groups.select(F.concat_ws("-", "p_brand", "g").alias("name"), code.alias("code"))
    return named.select(F.row_number().over(Window.orderBy("name")).alias("scale_id"), "name", "code", mask.alias("mask"))


def scale_steps(scales: DataFrame) -> DataFrame:
    """(scale_id, step) of the notes of each scale."""
    return scales.select("scale_id", F.posexplode("mask").alias("step", "on")).where("on = 1").select("scale_id", "step")


#: The same in SQL.
SQL = {
    "frames": f"""frames AS (SELECT user_id AS recording_id, event_id AS frame_id, epoch_us(ts) AS t_us, epoch_us(ts) / {float(UNIT)!r}::DOUBLE AS t, event_type AS track,
        value AS pitch_hz, k / 100.0::DOUBLE AS confidence, value > 0 AND k % 10 <> 0 AS voicing, (event_id * 37 % 100) / 100.0::DOUBLE AS energy
        FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events))""",
    "notes": f"""notes AS (SELECT recording_id, frame_id AS note_id, t_us AS start_us, last AS end_us, t AS start, last / {float(UNIT)!r}::DOUBLE AS "end", midi,
        CAST((round_even(midi, 0) % 12 + 12) % 12 AS INT) AS pc, energy, track FROM (
        SELECT *, t_us + CAST(floor(least(coalesce(lead(t_us) OVER (PARTITION BY recording_id ORDER BY t_us, frame_id) - t_us, {UNIT // 2}), {UNIT // 2}) * 3 / 5.0::DOUBLE) AS BIGINT) AS last,
        CASE WHEN pitch_hz > 0 THEN 69 + 12 * log2(pitch_hz / 440) END AS midi FROM frames))""",
    "scales": """scales AS (SELECT row_number() OVER (ORDER BY name) AS scale_id, name, code, [CASE WHEN i = 0 OR (code >> (i - 1)) & 1 = 1 THEN 1 ELSE 0 END FOR i IN range(12)] AS mask FROM (
        SELECT p_brand || '-' || (p_size % 3) AS name, (min(p_partkey) * 7919 + (p_size % 3) * 131) % 2048 AS code FROM part GROUP BY p_brand, p_size % 3)),
        scale_steps AS (SELECT scale_id, CAST(u.i AS INT) AS step FROM scales, (SELECT unnest(range(12)) AS i) u WHERE mask[u.i + 1] = 1)""",
}


def with_(*names: str) -> str:
    """WITH clauses of the adapters; notes need frames."""
    names = tuple(dict.fromkeys(("frames", *names) if "notes" in names else names))
    return "WITH " + ", ".join(SQL[n] for n in names)
