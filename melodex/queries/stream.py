"""Streaming operators run to the end over a table, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources import adapters as S
from ..streaming import sessions as T
from .registry import Registry

R = Registry()


def with_time(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


SESSIONS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= GAP THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
    w AS (SELECT user_id, k, min(ts) AS start, max(ts) + INTERVAL (GAP) MICROSECOND AS "end", count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY 1, 2)"""
HOUR6 = str(6 * 3600 * 1_000_000)


#: What a stream over the whole table has given out at its end: windows up to the watermark, and state that timed out before it.
MARK = "mark AS (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM events)"
OVER = "epoch_ms({0}) + 600000 < (SELECT mark FROM mark)"


@R("session_windows", SESSIONS.replace("GAP", HOUR6) + ' SELECT user_id, epoch_us(start) AS start, epoch_us("end") AS "end", n, value FROM w')
def session_windows(spark, d):
    s = T.sessions(with_time(S.table(spark, d, "events")), "6 hours")
    return s.withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


@R("stream_sessions", SESSIONS.replace("GAP", HOUR6) + f', {MARK} SELECT user_id, epoch_us(start) AS start, epoch_us("end") AS "end", n, value FROM w, mark WHERE epoch_us("end") <= mark * 1000')
def stream_sessions(spark, d):
    """As ``session_windows``, from a stream: sessions still open at its end are not given out yet."""
    s = T.drained(spark, T.sessions(T.source(spark, d, prepare=with_time), "6 hours"))
    return s.withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


HOPS = """h AS (
    SELECT event_type, s AS start, count(*) AS n FROM (
        SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1, 2)"""


@R("hopping_windows", f"WITH {HOPS} SELECT event_type, epoch_us(start) AS start, n FROM h")
def hopping_windows(spark, d):
    return T.hops(with_time(S.table(spark, d, "events")), "24 hours", "12 hours").withColumn("start", F.unix_micros("start"))


@R("stream_hops", f"WITH {HOPS}, {MARK} SELECT event_type, epoch_us(start) AS start, n FROM h, mark WHERE epoch_ms(start) + 24 * 3600000 <= mark")
def stream_hops(spark, d):
    return T.drained(spark, T.hops(T.source(spark, d, prepare=with_time), "24 hours", "12 hours")).withColumn("start", F.unix_micros("start"))


@R("stream_counts", "SELECT event_type AS before, user_id % 4 AS token, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, d):
    pairs = T.source(spark, d).select(F.col("event_type").alias("before"), (F.col("user_id") % 4).alias("token"))
    return T.drained(spark, T.bigram_counts(pairs), "complete")


@R("stream_runs", f"""WITH {MARK},
    o AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o),
    r AS (SELECT user_id, run, any_value(event_type) AS event_type, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM k GROUP BY 1, 2)
    SELECT user_id, event_type, epoch_us(start) AS start, epoch_us("end") AS "end", n FROM (SELECT *, max(run) OVER (PARTITION BY user_id) AS last FROM r)
    WHERE run < last OR {OVER.format('"end"')}""")
def stream_runs(spark, d):
    r = T.drained(spark, T.merged_runs(T.source(spark, d, prepare=with_time)))
    return r.withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


def framed(events):
    return S.as_frames(with_time(events), "ts")


@R("stream_silences", f"""{S.with_('frames')}, {MARK},
    o AS (SELECT *, energy < 0.5 AS quiet, coalesce(lag(energy < 0.5) OVER w, FALSE) AS before FROM frames WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, frame_id)),
    k AS (SELECT *, sum(CASE WHEN quiet AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY t_us, frame_id) AS run FROM o),
    l AS (SELECT recording_id, max(t_us) AS last_us, arg_max(quiet, (t_us, frame_id)) AS open, max(run) AS last_run FROM k GROUP BY 1),
    r AS (SELECT recording_id, run, min(t) AS start, max(t) AS "end" FROM k WHERE quiet GROUP BY 1, 2 HAVING max(t) - min(t) >= 0.2)
    SELECT recording_id, round(start, 6) AS start, round("end", 6) AS "end" FROM r JOIN l USING (recording_id) WHERE NOT open OR run < last_run OR last_us // 1000 + 600000 < (SELECT mark FROM mark)""")
def stream_silences(spark, d):
    s = T.drained(spark, T.silences(T.source(spark, d, prepare=framed), 0.5, 0.2))
    return s.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


def noted(events):
    f = framed(events).where("voicing and pitch_hz > 0")
    return f.select("ts", "recording_id", F.col("frame_id").alias("note_id"), F.col("t").alias("start"), (F.col("t") + 0.3 * F.col("energy")).alias("end"), E.hz_to_midi("pitch_hz").alias("midi"), "energy")


@R("stream_notes", f"""{S.with_('frames').replace("WITH ", "WITH RECURSIVE ", 1)}, {MARK},
    notes AS (SELECT recording_id, t_us, frame_id AS note_id, t AS start, t + 0.3 * energy AS "end", 69 + 12 * log2(pitch_hz / 440) AS midi, energy FROM frames WHERE voicing AND pitch_hz > 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, note_id) AS i FROM notes),
    f AS (
        SELECT recording_id, i, note_id AS head, start AS s, "end" AS e, midi AS m, energy AS v FROM o WHERE i = 1
        UNION ALL
        SELECT recording_id, i, CASE WHEN joins THEN head ELSE note_id END, CASE WHEN joins THEN s ELSE start END, CASE WHEN joins THEN greatest(e, "end") ELSE "end" END,
            CASE WHEN joins THEN m ELSE midi END, CASE WHEN NOT joins THEN energy WHEN a + b > 0 THEN (v * a + energy * b) / (a + b) ELSE greatest(v, energy) END
        FROM (
            SELECT o.recording_id, o.i, head, s, e, m, v, note_id, start, "end", midi, energy, e - s AS a, "end" - start AS b,
                abs(midi - m) < 3 AND (start - e <= 0.3 + 1e-9 OR start - e <= 0.5 + 1e-9 AND least(e - s, "end" - start) <= 0.2 + 1e-9) AS joins
            FROM f JOIN o ON o.recording_id = f.recording_id AND o.i = f.i + 1)),
    last AS (SELECT recording_id, max(t_us) AS last_us, arg_max(head, i) AS open FROM f JOIN o USING (recording_id, i) GROUP BY 1)
    SELECT recording_id, head AS note_id, round(s, 6) AS start, round(max(e), 6) AS "end", round(m, 6) AS midi, round(arg_max(v, i), 6) AS energy
    FROM f JOIN last USING (recording_id) WHERE head <> open OR last_us // 1000 + 600000 < (SELECT mark FROM mark) GROUP BY 1, 2, 3, 5""")
def stream_notes(spark, d):
    """Notes joined from a stream; the one still open at its end is not given out yet."""
    n = T.drained(spark, T.merged_notes(T.source(spark, d, prepare=noted), 3.0, 0.3, 0.5, 0.2))
    return n.select("recording_id", "note_id", *[F.round(c, 6).alias(c) for c in ("start", "end", "midi", "energy")])


QUERIES, ORACLE = R.queries, R.oracle
