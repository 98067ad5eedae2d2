"""Events, phrases, windows over notes, joins in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import frames as O
from ..operators import joins as J
from ..operators import phrases as P
from ..sources import adapters as S
from .registry import Registry

R = Registry()
FR, NO = S.with_("frames"), S.with_("notes")
T = "PARTITION BY recording_id ORDER BY t_us, frame_id"
N = "PARTITION BY recording_id ORDER BY start_us, note_id"
GRAD = f"""mz AS (SELECT *, CASE WHEN voicing THEN 69 + 12 * log2(pitch_hz / 440) ELSE 0 END AS midi FROM frames),
    d AS (SELECT *, lag(midi) OVER w AS fm, lead(midi) OVER w AS fp, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd, coalesce(lead(t) OVER w, t) AS nt FROM mz WINDOW w AS ({T})),
    g AS (SELECT *, CASE WHEN fm IS NULL THEN (fp - midi) / hd WHEN fp IS NULL THEN (midi - fm) / hs ELSE (hs * hs * fp + (hd * hd - hs * hs) * midi - hd * hd * fm) / (hs * hd * (hd + hs)) END AS gradient FROM d)"""
PH = f"""ph AS (SELECT *, sum(CASE WHEN start_us - le > {S.UNIT // 2} THEN 1 ELSE 0 END) OVER ({N})::BIGINT AS phrase FROM (SELECT *, lag(end_us) OVER ({N}) AS le FROM notes))"""
RUN = "rn AS (SELECT *, CASE WHEN f THEN sum(CASE WHEN f AND NOT coalesce(lf, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY t_us, frame_id)::BIGINT END AS run FROM (SELECT *, lag(f) OVER (PARTITION BY recording_id ORDER BY t_us, frame_id) AS lf FROM (SELECT *, {0} AS f FROM {1})))"
EV = GRAD + ", " + RUN.format("voicing AND abs(gradient) < 60", "g") + ", ev AS (SELECT recording_id, run, min(t) AS start, max(nt) AS \"end\", median(midi) AS midi, avg(energy) AS energy, count(*) AS frames FROM rn WHERE run IS NOT NULL GROUP BY 1, 2)"


def phrases(spark, d, gap=0.5):
    return P.gap_phrases(S.notes(spark, d), gap)


@R("gap_phrases", f"{NO}, {PH} SELECT recording_id, phrase, count(*) AS notes, round(min(start), 6) AS start, round(max(\"end\"), 6) AS \"end\" FROM ph GROUP BY 1, 2")
def gap_phrases(spark, d):
    b = P.phrase_bounds(phrases(spark, d))
    return b.select("recording_id", "phrase", "notes", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@R("merge_adjacent", f"""{NO}, {PH}, b AS (SELECT recording_id, phrase, count(*) AS notes, min(start) AS start, max("end") AS "end", min(start_us) AS s, max(end_us) AS e FROM ph GROUP BY 1, 2),
    g AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY recording_id ORDER BY s, phrase) > {round(0.8 * S.UNIT)} THEN 1 ELSE 0 END AS new FROM b),
    m AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY s, phrase ROWS UNBOUNDED PRECEDING)::BIGINT AS merged FROM g)
    SELECT recording_id, merged, count(*) AS phrases, sum(notes)::BIGINT AS notes, round(min(start), 6) AS start, round(max("end"), 6) AS "end" FROM m GROUP BY 1, 2""")
def merge_adjacent(spark, d):
    m = P.merge_adjacent(P.phrase_bounds(phrases(spark, d)), 0.8)
    return m.select("recording_id", "merged", "phrases", "notes", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@R("phrase_filter", f"{NO}, {PH} SELECT recording_id, count(*) AS phrases FROM (SELECT recording_id, phrase FROM ph GROUP BY 1, 2 HAVING count(*) >= 3 AND max(\"end\") - min(start) >= 0.8) GROUP BY 1")
def phrase_filter(spark, d):
    return P.phrase_bounds(phrases(spark, d)).where("notes >= 3 and end - start >= 0.8").groupBy("recording_id").agg(F.count("*").alias("phrases"))


@R("gradient", f"{FR}, {GRAD} SELECT frame_id, round(gradient, 4) AS gradient FROM g")
def gradient(spark, d):
    return O.gradient(O.midi_or_zero(S.frames(spark, d)), "midi").select("frame_id", F.round("gradient", 4).alias("gradient"))


@R("derivative", f"{FR} SELECT frame_id, round(coalesce(abs((pitch_hz - lag(pitch_hz) OVER w) / (t - lag(t) OVER w)), 0), 3) AS derivative FROM frames WHERE voicing WINDOW w AS ({T})")
def derivative(spark, d):
    return O.derivative(O.voiced(S.frames(spark, d)), "pitch_hz").select("frame_id", F.round("derivative", 3).alias("derivative"))


@R("islands_stationary", f"{FR}, {EV} SELECT recording_id, run, frames, round(start, 6) AS start, round(\"end\", 6) AS \"end\", round(midi, 6) AS midi, round(energy, 6) AS energy FROM ev WHERE \"end\" - start >= 0.1")
def islands_stationary(spark, d):
    e = O.stationary_events(S.frames(spark, d), 60, 0.1)
    return e.select("recording_id", "run", "frames", *(F.round(c, 6).alias(c) for c in ("start", "end", "midi", "energy")))


@R("inflection_points", f"{FR}, {GRAD}, s AS (SELECT *, CASE WHEN voicing THEN CAST(sign(gradient) AS INT) END AS s FROM g) SELECT frame_id, round(midi, 6) AS midi FROM (SELECT *, lead(s) OVER ({T}) AS ns FROM s) WHERE s <> ns")
def inflection_points(spark, d):
    return O.inflections(S.frames(spark, d)).select("frame_id", F.round("midi", 6).alias("midi"))


@R("inflection_anti_event", f"""{FR}, {EV}, s AS (SELECT *, CASE WHEN voicing THEN CAST(sign(gradient) AS INT) END AS s FROM g), i AS (SELECT * FROM (SELECT *, lead(s) OVER ({T}) AS ns FROM s) WHERE s <> ns)
    SELECT frame_id FROM i WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.recording_id = i.recording_id AND i.t BETWEEN ev.start AND ev."end")""")
def inflection_anti_event(spark, d):
    f = S.frames(spark, d)
    return J.contained_anti(O.inflections(f), O.stationary_events(f, 60, 0.0), 5.0).select("frame_id")


@R("union_notes", f"""{FR}, {EV}, s AS (SELECT *, CASE WHEN voicing THEN CAST(sign(gradient) AS INT) END AS s FROM g), i AS (SELECT * FROM (SELECT *, lead(s) OVER ({T}) AS ns FROM s) WHERE s <> ns),
    u AS (SELECT recording_id, 'event' AS kind, start, midi FROM ev UNION ALL SELECT recording_id, 'inflection', t, midi FROM i)
    SELECT recording_id, kind, round(start, 6) AS start, round(midi, 6) AS midi, row_number() OVER (PARTITION BY recording_id ORDER BY start, kind) AS place FROM u""")
def union_notes(spark, d):
    f = S.frames(spark, d)
    u = O.stationary_events(f, 60, 0.0).select("recording_id", F.lit("event").alias("kind"), "start", "midi").unionByName(O.inflections(f).select("recording_id", F.lit("inflection").alias("kind"), F.col("t").alias("start"), "midi"))
    u = u.withColumn("place", F.row_number().over(Window.partitionBy("recording_id").orderBy("start", "kind")))
    return u.select("recording_id", "kind", F.round("start", 6).alias("start"), F.round("midi", 6).alias("midi"), "place")


@R("interp_gaps", f"""{FR}, m AS (SELECT *, CASE WHEN voicing THEN 69 + 12 * log2(pitch_hz / 440) END AS midi, row_number() OVER ({T}) AS i FROM frames),
    p AS (SELECT *, last_value(CASE WHEN midi IS NOT NULL THEN i END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS pi, last_value(midi IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS pv,
        first_value(CASE WHEN midi IS NOT NULL THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni, first_value(midi IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM m WINDOW w AS ({T}))
    SELECT frame_id, round(coalesce(midi, pv + (nv - pv) * (i - pi) / (ni - pi), pv, nv), 6) AS filled FROM p""")
def interp_gaps(spark, d):
    f = S.frames(spark, d).withColumn("midi", F.when(F.col("voicing"), E.hz_to_midi("pitch_hz")))
    return O.interpolate(f, "midi").select("frame_id", F.round("filled", 6).alias("filled"))


@R("asof_energy", f"""{FR}, pts AS (SELECT recording_id, frame_id AS point_id, t_us + 7000000000 AS t_us FROM frames WHERE track = 'click'), f AS (SELECT recording_id, t_us, energy FROM frames WHERE track <> 'click')
    SELECT point_id, energy FROM (
        SELECT p.point_id, f.energy, row_number() OVER (PARTITION BY p.point_id ORDER BY abs(f.t_us - p.t_us), f.t_us) AS r
        FROM pts p LEFT JOIN f USING (recording_id)) WHERE r = 1""")
def asof_energy(spark, d):
    f = S.frames(spark, d)
    points = f.where("track = 'click'").select("recording_id", F.col("frame_id").alias("point_id"), (F.col("t_us") + 7_000_000_000).alias("t_us"))
    return O.asof_nearest(points, f.where("track != 'click'"), "energy").select("point_id", "energy")


SIL = RUN.format("energy < 0.5", "frames") + ", sil AS (SELECT recording_id, run, min(t) AS s, max(t) AS e FROM rn WHERE run IS NOT NULL GROUP BY 1, 2 HAVING max(t) - min(t) >= 0.2)"


@R("silence_in_phrase", f"""{NO}, {PH}, {SIL}, b AS (SELECT recording_id, phrase, min(start) AS ps, max("end") AS pe, count(*) AS n FROM ph GROUP BY 1, 2)
    SELECT note_id, phrase, (SELECT count(*) FROM sil, b WHERE sil.recording_id = ph.recording_id AND b.recording_id = ph.recording_id AND b.phrase = ph.phrase AND b.n >= 2 AND s >= ps AND e <= pe AND (s + e) / 2 <= (ph.start + ph."end") / 2)::INT AS part FROM ph""")
def silence_in_phrase(spark, d):
    quiet = P.silences(S.frames(spark, d), 0.5, 0.2)
    return P.split_by_silence(phrases(spark, d), quiet).select("note_id", "phrase", "part")


@R("transition_prob", f"{NO}, x AS (SELECT recording_id, pc AS from_pc, lead(pc) OVER ({N}) AS to_pc FROM notes) SELECT recording_id, from_pc, to_pc, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY recording_id, from_pc), 6) AS p FROM x WHERE to_pc IS NOT NULL GROUP BY 1, 2, 3")
def transition_prob(spark, d):
    t = P.transition_probabilities(P.transitions(S.notes(spark, d), []))
    return t.select("recording_id", "from_pc", "to_pc", "n", F.round("p", 6).alias("p"))


@R("transition_direction", f"""{NO}, {PH}, x AS (SELECT recording_id, pc AS from_pc, midi, lead(pc) OVER w AS to_pc, lead(midi) OVER w AS tm, lead(start_us) OVER w - end_us AS gap FROM ph WINDOW w AS (PARTITION BY recording_id, phrase ORDER BY start_us, note_id))
    SELECT recording_id, from_pc, to_pc, count(*) AS n, sum((tm > midi)::INT)::BIGINT AS up, sum((tm < midi)::INT)::BIGINT AS down FROM x WHERE to_pc IS NOT NULL AND gap <= {S.UNIT // 2} GROUP BY 1, 2, 3""")
def transition_direction(spark, d):
    return P.transitions(phrases(spark, d), ["phrase"], 0.5)


@R("monotone_runs", f"""{NO}, a AS (SELECT *, round_even(midi, 0) AS p FROM notes), b AS (SELECT *, lag(p) OVER ({N}) AS before FROM a), c AS (SELECT *, CAST(sign(p - before) AS INT) AS direction FROM b WHERE before IS NULL OR before <> p),
    e AS (SELECT *, sum(CASE WHEN direction <> ld THEN 1 ELSE 0 END) OVER ({N})::BIGINT AS run FROM (SELECT *, lag(direction) OVER ({N}) AS ld FROM c))
    SELECT recording_id, run, any_value(direction) AS direction, count(*) + 1 AS notes, CAST(arg_min(before, (start_us, note_id)) AS BIGINT) || ',' || string_agg(CAST(p AS BIGINT)::VARCHAR, ',' ORDER BY start_us, note_id) AS pitches FROM e WHERE direction IS NOT NULL GROUP BY 1, 2""")
def monotone_runs(spark, d):
    r = P.monotone_runs(S.notes(spark, d), E.half_even("midi"))
    text = F.concat_ws(",", F.col("first").cast("long").cast("string"), F.array_join(F.transform("rest", lambda x: x.cast("long").cast("string")), ","))
    return r.select("recording_id", "run", "direction", "notes", text.alias("pitches"))


@R("run_frequency", f"""{NO}, a AS (SELECT *, round_even(midi, 0) AS p FROM notes), b AS (SELECT *, lag(p) OVER ({N}) AS before FROM a), c AS (SELECT *, CAST(sign(p - before) AS INT) AS direction FROM b WHERE before IS NULL OR before <> p),
    e AS (SELECT *, sum(CASE WHEN direction <> ld THEN 1 ELSE 0 END) OVER ({N}) AS run FROM (SELECT *, lag(direction) OVER ({N}) AS ld FROM c)),
    r AS (SELECT recording_id, run, any_value(direction) AS direction, count(*) + 1 AS notes FROM e WHERE direction IS NOT NULL GROUP BY 1, 2), k AS (SELECT direction, notes, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT direction, notes, n, row_number() OVER (PARTITION BY direction ORDER BY n DESC, notes) AS place FROM k QUALIFY place <= 5""")
def run_frequency(spark, d):
    k = P.monotone_runs(S.notes(spark, d), E.half_even("midi")).groupBy("direction", "notes").agg(F.count("*").alias("n"))
    w = Window.partitionBy("direction").orderBy(F.col("n").desc(), "notes")
    return k.withColumn("place", F.row_number().over(w)).where("place <= 5")


@R("cluster_phrases", f"""{NO}, {PH}, m AS (SELECT recording_id, phrase, list(CAST(round_even(midi, 0) AS INT) ORDER BY start_us, note_id) AS m FROM ph GROUP BY 1, 2),
    i AS (SELECT recording_id, phrase, coalesce(array_to_string([coalesce((m[k + 1] - m[k])::VARCHAR, '?') FOR k IN range(1, len(m))], ','), '') AS steps FROM m)
    SELECT recording_id, phrase, steps, count(*) OVER w AS phrases, min(recording_id) OVER w AS first_recording, arg_min(phrase, (recording_id, phrase)) FILTER (recording_id IS NOT NULL) OVER w AS first_phrase
    FROM i WINDOW w AS (PARTITION BY steps)""")
def cluster_phrases(spark, d):
    """Every phrase with its cluster: those of the same steps, known by the first of them. An unknown step is a question mark."""
    text = F.array_join(F.transform("steps", lambda x: x.cast("string")), ",", "?")
    return P.clusters(P.intervals(phrases(spark, d)).withColumn("steps", text))


@R("lm_direction", f"""{NO}, {PH} SELECT note_id, CASE WHEN b IS NULL THEN '' WHEN m > b THEN '/U' WHEN m < b THEN '/D' ELSE '/=' END AS suffix FROM (SELECT note_id, round_even(midi, 0) AS m, lag(round_even(midi, 0)) OVER (PARTITION BY recording_id, phrase ORDER BY start_us, note_id) AS b FROM ph)""")
def lm_direction(spark, d):
    m = E.half_even("midi")
    b = F.lag(m).over(S.note_order("phrase"))
    return phrases(spark, d).select("note_id", F.when(b.isNull(), "").when(m > b, "/U").when(m < b, "/D").otherwise("/=").alias("suffix"))


@R("note_histogram", f"{NO} SELECT recording_id, pc, round(sum(\"end\" - start), 6) AS seconds FROM notes GROUP BY 1, 2")
def note_histogram(spark, d):
    return S.notes(spark, d).groupBy("recording_id", "pc").agg(F.round(F.sum(F.col("end") - F.col("start")), 6).alias("seconds"))


@R("note_histogram_pivot", f"{NO} SELECT recording_id, " + ", ".join(f"round(sum(\"end\" - start) FILTER (pc = {i}), 6) AS pc_{i}" for i in range(12)) + " FROM notes GROUP BY 1")
def note_histogram_pivot(spark, d):
    p = S.notes(spark, d).groupBy("recording_id").pivot("pc", list(range(12))).agg(F.round(F.sum(F.col("end") - F.col("start")), 6))
    return p.withColumnsRenamed({str(i): f"pc_{i}" for i in range(12)})


@R("mode_snap", f"""{FR}, v AS (SELECT *, CAST(round_even(69 + 12 * log2(pitch_hz / 440), 0) AS INT) AS pitch, row_number() OVER ({T}) AS i FROM frames WHERE pitch_hz > 0 AND voicing)
    SELECT frame_id, arg_min(p, (-n, p)) AS snapped FROM (SELECT a.frame_id, b.pitch AS p, count(*) AS n FROM v a JOIN v b ON a.recording_id = b.recording_id AND b.i BETWEEN a.i - 3 AND a.i + 3 GROUP BY 1, 2) GROUP BY 1""")
def mode_snap(spark, d):
    return O.mode_in_rows(S.frames(spark, d), 3).select("frame_id", "snapped")


@R("octave_reference", f"{NO} SELECT recording_id, CAST(floor(coalesce(median(midi) FILTER (pc = 2), median(midi), 60) / 12) AS BIGINT) AS octave FROM notes GROUP BY 1")
def octave_reference(spark, d):
    m = F.coalesce(F.median(F.when(F.col("pc") == 2, F.col("midi"))), F.median("midi"), F.lit(60.0))
    return S.notes(spark, d).groupBy("recording_id").agg(F.floor(m / 12).alias("octave"))


@R("percentile_normalise", f"""{FR}, q AS (SELECT recording_id, quantile_cont(pitch_hz, 0.05) AS lo, quantile_cont(pitch_hz, 0.95) AS hi FROM frames GROUP BY 1)
    SELECT frame_id, round(CASE WHEN hi > lo THEN greatest(0, least(1, (pitch_hz - lo) / (hi - lo))) ELSE 0.5 END, 6) AS level FROM frames JOIN q USING (recording_id)""")
def percentile_normalise(spark, d):
    f = S.frames(spark, d)
    q = f.groupBy("recording_id").agg(F.percentile("pitch_hz", [0.05, 0.95]).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    level = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("pitch_hz") - lo, hi - lo)))).otherwise(0.5)
    return f.join(q, "recording_id").select("frame_id", F.round(level, 6).alias("level"))


@R("merge_notes", f"""{NO.replace("WITH ", "WITH RECURSIVE ", 1)},
    o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start, note_id) AS i FROM notes),
    f AS (
        SELECT recording_id, i, note_id AS head, start AS head_start, "end" AS head_end, midi AS head_midi, energy AS head_energy FROM o WHERE i = 1
        UNION ALL
        SELECT recording_id, i, CASE WHEN joins THEN head ELSE note_id END, CASE WHEN joins THEN head_start ELSE start END,
            CASE WHEN joins THEN greatest(head_end, "end") ELSE "end" END, CASE WHEN joins THEN head_midi ELSE midi END,
            CASE WHEN NOT joins THEN energy WHEN whole > 0 THEN (head_energy * length + energy * own) / whole ELSE greatest(head_energy, energy) END
        FROM (
            SELECT f.recording_id, o.i, head, head_start, head_end, head_midi, head_energy, note_id, start, "end", midi, energy,
                head_end - head_start AS length, "end" - start AS own, head_end - head_start + "end" - start AS whole,
                coalesce(abs(midi - head_midi) < 3 AND (start - head_end <= 0.3 + 1e-9
                    OR start - head_end <= 0.5 + 1e-9 AND least(head_end - head_start, "end" - start) <= 0.2 + 1e-9), FALSE) AS joins
            FROM f JOIN o ON o.recording_id = f.recording_id AND o.i = f.i + 1))
    SELECT recording_id, head AS note_id, head_start AS start, round(max(head_end), 6) AS "end", head_midi AS midi, round(arg_max(head_energy, i), 6) AS energy
    FROM f GROUP BY 1, 2, 3, 5""")
def merge_notes(spark, d):
    m = P.merge_notes(S.notes(spark, d), 3.0, 0.3, 0.5, 0.2)
    return m.withColumns({"end": F.round("end", 6), "energy": F.round("energy", 6)})


@R("merge_small_phrases", f"""{NO.replace("WITH ", "WITH RECURSIVE ", 1)}, {PH},
    b AS (SELECT recording_id, phrase, row_number() OVER (PARTITION BY recording_id ORDER BY phrase) AS i, count(*) AS n FROM ph GROUP BY 1, 2),
    f AS (
        SELECT recording_id, i, phrase, 0 AS made, CASE WHEN n < 3 THEN n ELSE 0 END AS waiting, CASE WHEN n < 3 THEN 0 ELSE 1 END AS done FROM b WHERE i = 1
        UNION ALL
        SELECT f.recording_id, b.i, b.phrase, f.done, CASE WHEN f.waiting + b.n < 3 THEN f.waiting + b.n ELSE 0 END, f.done + CASE WHEN f.waiting + b.n < 3 THEN 0 ELSE 1 END
        FROM f JOIN b ON b.recording_id = f.recording_id AND b.i = f.i + 1),
    t AS (SELECT *, max(done) OVER (PARTITION BY recording_id) AS whole FROM f)
    SELECT ph.recording_id, note_id, start, "end", least(made, whole - 1)::BIGINT AS phrase FROM ph JOIN t USING (recording_id, phrase) WHERE whole > 0""")
def merge_small_phrases(spark, d):
    return P.merge_small_phrases(phrases(spark, d), 3)


def snap_sql(keep_far: bool) -> str:
    """Notes snapped to a major scale on 60, walked in order."""
    steps = "unnest([0, 2, 4, 5, 7, 9, 11]) AS pc), (SELECT unnest([-1, 0, 1]) AS o)"
    return f"""{NO.replace("WITH ", "WITH RECURSIVE ", 1)},
    o AS (SELECT recording_id, note_id, start, midi, row_number() OVER (PARTITION BY recording_id ORDER BY start, note_id) AS i FROM notes),
    c AS (
        SELECT recording_id, i, midi, list((floor(round_even(midi, 0) / 12) + o) * 12 + pc)::DOUBLE[] AS c FROM o, (SELECT {steps}
        WHERE midi IS NOT NULL GROUP BY 1, 2, 3),
    d AS (SELECT *, list_min([abs(x - midi) FOR x IN c]) AS best FROM c),
    n AS (
        SELECT o.*, best, CASE WHEN best <= 1 THEN [x FOR x IN c IF abs(x - d.midi) - best <= 1e-9] END AS near
        FROM o LEFT JOIN d ON d.recording_id = o.recording_id AND d.i = o.i),
    f AS (
        SELECT recording_id, 0::BIGINT AS i, NULL::DOUBLE AS own, NULL::DOUBLE AS before FROM n WHERE i = 1
        UNION ALL
        SELECT recording_id, i, own, coalesce(own, before) FROM (
            SELECT n.recording_id, n.i, f.before, CASE WHEN near IS NOT NULL
                THEN -list_sort([{{'a': CASE WHEN f.before IS NULL THEN 0 ELSE round(abs(x - f.before), 9) END, 'b': -x}} FOR x IN near])[1].b
                {"WHEN midi IS NOT NULL THEN midi" if keep_far else ""} END AS own
            FROM f JOIN n ON n.recording_id = f.recording_id AND n.i = f.i + 1)),
    s AS (
        SELECT n.recording_id, note_id, own AS snapped, CASE WHEN own IS NULL THEN 'discarded' WHEN best > 1 THEN 'unchanged_far'
            WHEN best > 1e-9 THEN 'corrected' ELSE 'unchanged' END AS action FROM n JOIN f USING (recording_id, i))"""


@R("snap_continuity", snap_sql(False) + " SELECT * FROM s")
def snap_continuity(spark, d):
    return P.snap_to_scale(S.notes(spark, d), [0, 2, 4, 5, 7, 9, 11], 60).select("recording_id", "note_id", "snapped", "action")


@R("snap_keeping_far", snap_sql(True).replace("[0, 2, 4, 5, 7, 9, 11]", "[0, 6]") + " SELECT * FROM s")
def snap_keeping_far(spark, d):
    """A scale of two notes: those too far from both stay as they are and count as accepted."""
    return P.snap_to_scale(S.notes(spark, d), [0, 6], 60, keep_far=True).select("recording_id", "note_id", "snapped", "action")


@R("correction_stats", snap_sql(False) + """
    SELECT recording_id, count(*) AS total, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'corrected') AS corrected,
        count(*) FILTER (action = 'discarded') AS discarded, count(*) FILTER (action <> 'discarded') AS remaining FROM s GROUP BY 1""")
def correction_stats(spark, d):
    return P.correction_stats(P.snap_to_scale(S.notes(spark, d), [0, 2, 4, 5, 7, 9, 11], 60))


@R("two_means_threshold", f"""{NO}, g AS (SELECT recording_id, start - lag("end") OVER ({N}) AS gap FROM notes),
    k AS (SELECT recording_id, gap, count(*) AS c FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT *, sum(c) OVER w AS k, sum(gap * c) OVER w AS s FROM k WINDOW w AS (PARTITION BY recording_id ORDER BY gap)),
    a AS (SELECT *, max(k) OVER w AS n, arg_max(s, k) OVER w AS whole, min(gap) OVER w AS low FROM t WINDOW w AS (PARTITION BY recording_id)),
    e AS (
        SELECT *, (s / k + (whole - s) / (n - k)) / 2 AS mid, round(s * s / k + (whole - s) * (whole - s) / (n - k), 9) AS gain FROM a WHERE k < n),
    b AS (SELECT recording_id, arg_max(mid, (gain, -k)) AS mid FROM e GROUP BY 1)
    SELECT recording_id, round(greatest(0.3, coalesce(mid, low + 1.5e-9)), 6) AS threshold FROM (SELECT recording_id, min(low) AS low FROM a GROUP BY 1) LEFT JOIN b USING (recording_id)""")
def two_means_threshold(spark, d):
    return P.gap_thresholds(S.notes(spark, d)).withColumn("threshold", F.round("threshold", 6))


@R("scale_label_lookup", f"""{S.with_("scales")},
    w AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT upper(name) FROM scales),
    f AS (
        SELECT w.name, (SELECT min(scale_id) FROM scales s WHERE lower(s.name) = lower(w.name)) AS exact,
            (SELECT min(scale_id) FROM scales s WHERE contains(lower(w.name), lower(s.name)) OR contains(lower(s.name), lower(w.name))) AS loose FROM w),
    n AS (SELECT scale_id, array_to_string(list(step ORDER BY step), ',') AS notes FROM scale_steps GROUP BY 1)
    SELECT name, coalesce(exact, loose) AS scale_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN loose IS NOT NULL THEN 'contains' ELSE 'none' END AS how,
        coalesce(n.notes, '0,1,2,3,4,5,6,7,8,9,10,11') AS notes FROM f LEFT JOIN n ON n.scale_id = coalesce(exact, loose)""")
def scale_label_lookup(spark, d):
    """Names with the scale of that name and its notes; all twelve where there is none."""
    p, s = S.table(spark, d, "part"), S.scales(spark, d)
    wanted = p.select(F.col("p_brand").alias("name")).union(p.select("p_type")).union(s.select(F.upper("name"))).distinct()
    steps = F.filter(F.transform("mask", lambda on, i: F.when(on == 1, i)), lambda i: i.isNotNull())
    notes = s.select("scale_id", F.array_join(F.transform(steps, lambda x: x.cast("string")), ",").alias("notes"))
    every = ",".join(map(str, range(12)))
    return J.fuzzy_lookup(wanted, s).join(notes, "scale_id", "left").withColumn("notes", F.coalesce("notes", F.lit(every)))


@R("label_match_unique", """WITH f AS (SELECT page_id, lower(regexp_extract(url, '([^/]*)$', 1)) AS base, split_part(lower(regexp_extract(url, '([^/]*)$', 1)), '?', 1) AS stem FROM pages),
    l AS (SELECT page_id AS label_id, CASE WHEN page_id % 3 = 0 THEN 'x' ELSE stem END AS stem, base FROM f), s AS (SELECT stem, count(*) AS n, min(page_id) AS id FROM f GROUP BY 1), b AS (SELECT base, count(*) AS n, min(page_id) AS id FROM f GROUP BY 1)
    SELECT label_id, CASE WHEN s.n = 1 THEN s.id WHEN s.n IS NULL AND b.n = 1 THEN b.id END AS page_id, CASE WHEN s.n = 1 THEN 'stem' WHEN s.n > 1 THEN 'ambiguous' WHEN b.n = 1 THEN 'base' WHEN b.n > 1 THEN 'ambiguous' ELSE 'missing' END AS match
    FROM l LEFT JOIN s USING (stem) LEFT JOIN b USING (base)""")
def label_match_unique(spark, d):
    base = F.lower(F.regexp_extract("url", "([^/]*)$", 1))
    f = S.table(spark, d, "pages").select("page_id", base.alias("base"), F.substring_index(base, "?", 1).alias("stem"))
    labels = f.select(F.col("page_id").alias("label_id"), F.when(F.col("page_id") % 3 == 0, "x").otherwise(F.col("stem")).alias("stem"), "base")
    return J.unique_match(labels, f, ["stem", "base"], "page_id").select("label_id", "page_id", "match")


@R("pareto_skyline", """SELECT l_orderkey, l_partkey, l_quantity, l_discount FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_quantity >= a.l_quantity AND b.l_discount >= a.l_discount AND (b.l_quantity > a.l_quantity OR b.l_discount > a.l_discount))""")
def pareto_skyline(spark, d):
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    return J.skyline(li, ["l_orderkey"], "l_quantity", "l_discount")


@R("correct_incorrect_pairs", """WITH r AS (SELECT *, l_returnflag = 'R' AS ok FROM lineitem), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM r WHERE ok) WHERE n = 1)
    SELECT b.l_orderkey, b.l_linenumber, b.l_partkey, g.l_quantity - b.l_quantity AS d_l_quantity, round(g.l_discount - b.l_discount, 6) AS d_l_discount FROM r b JOIN g ON g.l_orderkey = b.l_orderkey WHERE NOT b.ok""")
def correct_incorrect_pairs(spark, d):
    li = S.table(spark, d, "lineitem").withColumn("ok", F.col("l_returnflag") == "R")
    return J.pairs(li, "l_orderkey", "ok", ["l_quantity", "l_discount"], ["l_linenumber", "l_partkey"]).withColumn("d_l_discount", F.round("d_l_discount", 6))


QUERIES, ORACLE = R.queries, R.oracle
