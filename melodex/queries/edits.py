"""Edit logs with undo and redo, replayed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import edits as X
from .registry import Registry
from .sequences import NO, PH, phrases

R = Registry()
OPS = ("delete", "delete_range", "bounds", "add", "merge", "split", "undo", "redo", "undo", "phrase_bounds")
CASES = " ".join(f"WHEN {i} THEN '{op}'" for i, op in enumerate(OPS))
#: A log from every third note of a recording: what is done follows from the note's id; a session ends every 25 edits.
LOG = f"""{NO.replace("WITH", "WITH RECURSIVE", 1)}, {PH},
    own AS (SELECT recording_id, note_id, start, "end", midi, 'p' || phrase AS phrase, phrase AS k FROM ph),
    picked AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start, note_id) AS seq FROM own WHERE note_id % 3 = 0),
    lg AS (
        SELECT recording_id, seq, CASE WHEN seq % 25 = 0 THEN 'open' ELSE CASE note_id // 3 % 10 {CASES} END END AS op,
            CASE WHEN note_id // 3 % 10 = 3 THEN -1 - note_id ELSE note_id END AS note_id, phrase,
            CASE note_id // 3 % 10 WHEN 4 THEN 'p' || (k + 1) WHEN 5 THEN 's' || note_id END AS other,
            CASE note_id // 3 % 10 WHEN 5 THEN start WHEN 2 THEN "end" + 0.02 ELSE start - 0.01 END AS lo,
            CASE note_id // 3 % 10 WHEN 5 THEN "end" WHEN 2 THEN start - 0.02 ELSE "end" + 0.5 END AS hi, midi + 1 AS midi
        FROM picked),
    steps AS (
        SELECT *, row_number() OVER (PARTITION BY recording_id, session ORDER BY seq) AS i
        FROM (SELECT recording_id, seq, op, sum((op = 'open')::INT) OVER (PARTITION BY recording_id ORDER BY seq) AS session FROM lg)),
    stack AS (
        SELECT DISTINCT recording_id, session, 0::BIGINT AS i, []::BIGINT[] AS done, []::BIGINT[] AS undone FROM steps
        UNION ALL
        SELECT s.recording_id, s.session, o.i,
            CASE WHEN op = 'undo' THEN done[1:len(done) - 1] WHEN op = 'redo' AND len(undone) > 0 THEN list_append(done, undone[len(undone)])
                WHEN op IN ('redo', 'open') THEN done ELSE list_append(done, seq) END,
            CASE WHEN op = 'undo' AND len(done) > 0 THEN list_append(undone, done[len(done)]) WHEN op = 'redo' THEN undone[1:len(undone) - 1]
                WHEN op IN ('undo', 'open') THEN undone ELSE []::BIGINT[] END
        FROM stack s JOIN steps o ON o.recording_id = s.recording_id AND o.session = s.session AND o.i = s.i + 1),
    forced AS (SELECT recording_id, unnest(done) AS seq FROM (SELECT recording_id, session, arg_max(done, i) AS done FROM stack GROUP BY 1, 2))"""
REPLAY = f"""{LOG},
    e AS (
        SELECT *, least(lo, hi) AS a, greatest(lo, hi) AS b, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS i
        FROM lg SEMI JOIN forced USING (recording_id, seq)),
    every_ AS (
        SELECT recording_id, note_id, start, "end" AS stop, midi, phrase, NULL::BIGINT AS born FROM own
        UNION ALL SELECT recording_id, note_id, a, b, midi, phrase, seq FROM e WHERE op = 'add'),
    fold AS (
        SELECT recording_id, note_id, midi, born, 0::BIGINT AS i, born IS NULL AS alive, start, stop, phrase FROM every_
        UNION ALL
        SELECT f.recording_id, f.note_id, f.midi, born, e.i,
            CASE WHEN alive THEN NOT (op = 'delete' AND e.note_id = f.note_id OR op = 'delete_range' AND stop >= a AND start <= b)
                ELSE coalesce(op = 'add' AND seq = born, false) END,
            CASE WHEN alive AND op = 'bounds' AND e.note_id = f.note_id THEN a ELSE start END,
            CASE WHEN alive AND op = 'bounds' AND e.note_id = f.note_id THEN CASE WHEN b > a THEN b ELSE a + 0.001 END ELSE stop END,
            CASE WHEN NOT alive THEN f.phrase WHEN op = 'merge' AND f.phrase = e.other THEN e.phrase
                WHEN op = 'split' AND f.phrase = e.phrase AND (start, stop, f.note_id) > (e.lo, e.hi, e.note_id) THEN e.other
                WHEN op = 'phrase_bounds' AND stop >= a AND start <= b THEN e.phrase
                WHEN op = 'phrase_bounds' AND f.phrase = e.phrase THEN 'auto-' || f.note_id ELSE f.phrase END
        FROM fold f JOIN e ON e.recording_id = f.recording_id AND e.i = f.i + 1),
    final AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY recording_id, note_id ORDER BY i DESC) = 1)"""


def note_log(spark, d):
    """Notes with their phrases, and the log."""
    own = phrases(spark, d).select("recording_id", "note_id", "start", "end", "midi", F.concat(F.lit("p"), F.col("phrase").cast("string")).alias("phrase"), F.col("phrase").alias("k"))
    way = F.floor(F.col("note_id") / 3) % 10
    rows = own.where("note_id % 3 = 0").withColumn("seq", F.row_number().over(Window.partitionBy("recording_id").orderBy("start", "note_id")).cast("long"))
    op = F.when(F.col("seq") % 25 == 0, "open").otherwise(F.element_at(F.array(*map(F.lit, OPS)), way.cast("int") + 1))
    other = F.when(way == 4, F.concat(F.lit("p"), (F.col("k") + 1).cast("string"))).when(way == 5, F.concat(F.lit("s"), F.col("note_id").cast("string")))
    lo = F.when(way == 5, F.col("start")).when(way == 2, F.col("end") + 0.02).otherwise(F.col("start") - 0.01)
    hi = F.when(way == 5, F.col("end")).when(way == 2, F.col("start") - 0.02).otherwise(F.col("end") + 0.5)
    note = F.when(way == 3, -1 - F.col("note_id")).otherwise(F.col("note_id"))
    log = rows.select("recording_id", "seq", op.alias("op"), note.alias("note_id"), "phrase", other.alias("other"), lo.alias("lo"), hi.alias("hi"), (F.col("midi") + 1).alias("midi"))
    return own.drop("k"), log


@R("edits_in_force", f"{LOG} SELECT recording_id, seq, op, note_id FROM lg SEMI JOIN forced USING (recording_id, seq)")
def edits_in_force(spark, d):
    """The edits that are left when all that was undone and redone is done."""
    return X.effective(note_log(spark, d)[1]).select("recording_id", "seq", "op", "note_id")


@R(
    "edit_session_notes",
    f"""{REPLAY} SELECT recording_id, note_id, phrase, round(start, 6) AS start, round(stop, 6) AS "end", round(midi, 6) AS midi FROM final WHERE alive""",
)
def edit_session_notes(spark, d):
    """Notes after a log of deletions, ranges, new bounds, additions, merged and split phrases, with undo and redo."""
    out = X.replay_session(*note_log(spark, d))
    return out.select("recording_id", "note_id", "phrase", *[F.round(c, 6).alias(c) for c in ("start", "end", "midi")])


@R(
    "edit_session_phrases",
    f"""{REPLAY} SELECT recording_id, phrase, round(min(start), 6) AS start, round(max(stop), 6) AS "end", count(*) AS notes FROM final WHERE alive GROUP BY 1, 2""",
)
def edit_session_phrases(spark, d):
    out = X.phrase_table(X.replay_session(*note_log(spark, d)))
    return out.select("recording_id", "phrase", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "notes")


QUERIES, ORACLE = R.queries, R.oracle
