"""Distributions and hypothesis scoring."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import frames as O
from ..operators import histogram as H
from ..operators import reports as T
from ..operators import scoring as C
from ..sources import adapters as S
from .registry import Registry

R = Registry()
FR, SC = S.with_("frames"), S.with_("frames", "scales")
V = """v AS (
    SELECT *, 69 + 12 * log2(pitch_hz / 440) AS midi, (((69 + 12 * log2(pitch_hz / 440)) % 12) + 12) % 12 * 100 AS cent
    FROM frames WHERE pitch_hz > 0 AND voicing)"""
RECS = "recs AS (SELECT DISTINCT recording_id FROM v)"
PC = "CAST((round_even(midi, 0) % 12 + 12) % 12 AS INT)"
TWELVE = "recs CROSS JOIN (SELECT CAST(unnest(range(12)) AS INT) AS pc)"
MASS = f"""{V}, {RECS},
mass AS (
    SELECT recording_id, pc, coalesce(m, 0) AS mass FROM {TWELVE} LEFT JOIN (
        SELECT recording_id, CAST(floor(((floor(cent) + 35) % 1200) / 100) AS INT) AS pc, count(*) AS m
        FROM v WHERE ((floor(cent) + 35) % 1200) % 100 < 70 GROUP BY 1, 2) USING (recording_id, pc))"""
DIST = f"{MASS}, dist AS (SELECT *, (mass + 1e-12) / (sum(mass) OVER (PARTITION BY recording_id) + 12e-12) AS p FROM mass)"
COUNTS = f"""counts AS (
    SELECT recording_id, pc, coalesce(n, 0) AS n FROM {TWELVE} LEFT JOIN (
        SELECT recording_id, {PC} AS pc, count(*) AS n FROM v GROUP BY 1, 2) USING (recording_id, pc))"""
FLAGS = """flags AS (
    SELECT recording_id, bool_and(pitch_hz > 0 AND voicing) AS all_on, coalesce(median(dt), 1) AS step FROM (
        SELECT *, CASE WHEN row_number() OVER w <= 50 THEN t - lag(t) OVER w END AS dt
        FROM frames WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, frame_id)) GROUP BY 1)"""


def histogram_sql(name: str, bins: int, weight: str = "1") -> str:
    """Every recording with every bin: (recording_id, bin, x). Needs v, recs and, for weights, flags."""
    return f"""{name} AS (
    SELECT recording_id, CAST(bin AS INT) AS bin, coalesce(x, 0)::DOUBLE AS x
    FROM recs CROSS JOIN (SELECT unnest(range({bins})) AS bin) LEFT JOIN (
        SELECT recording_id, least(floor(cent * {bins} / 1200), {bins - 1}) AS bin, sum({weight}) AS x
        FROM v LEFT JOIN flags USING (recording_id) GROUP BY 1, 2) USING (recording_id, bin))"""


WEIGHT = "CASE WHEN all_on THEN confidence * step ELSE 1 END"


def smooth_sql(name: str, source: str, bins: int, sigma: float) -> str:
    """(recording_id, bin, x): smoothed around the circle."""
    r = int(4 * sigma + 0.5)
    kernel = f"exp(-0.5 * (o / {sigma}) ** 2) / (SELECT sum(exp(-0.5 * (unnest / {sigma}) ** 2)) FROM unnest(range({-r}, {r + 1})))"
    return f"""{name} AS (
    SELECT recording_id, CAST((bin + o + {bins}) % {bins} AS INT) AS bin, round(sum(x * w), 9) AS x
    FROM {source}, (SELECT o, {kernel} AS w FROM (SELECT unnest(range({-r}, {r + 1})) AS o)) GROUP BY 1, 2)"""


def peaks_sql(name: str, source: str, bins: int, share: float, least: float, high_ends: bool = True) -> str:
    """(recording_id, bin): local maxima, the middle of a plateau, of at least a prominence, and either end that tops both of
    its neighbours around the circle."""
    n = name
    return f"""{n}_need AS (SELECT recording_id, greatest({least}, {share} * max(x)) AS need FROM {source} GROUP BY 1),
{n}_step AS (SELECT *, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS new FROM {source} WINDOW w AS (PARTITION BY recording_id ORDER BY bin)),
{n}_run AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY bin) AS run FROM {n}_step),
{n}_level AS (SELECT recording_id, run, (min(bin) + max(bin)) // 2 AS bin, max(x) AS x FROM {n}_run GROUP BY 1, 2),
{n}_top AS (
    SELECT * FROM (SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after FROM {n}_level WINDOW w AS (PARTITION BY recording_id ORDER BY run))
    WHERE x > before AND x > after),
{n}_wall AS (
    SELECT t.recording_id, t.bin, t.x, max(s.bin) FILTER (s.bin < t.bin AND s.x > t.x) AS l, min(s.bin) FILTER (s.bin > t.bin AND s.x > t.x) AS r
    FROM {n}_top t JOIN {source} s USING (recording_id) GROUP BY 1, 2, 3),
{n}_low AS (
    SELECT t.recording_id, t.bin, t.x, min(s.x) FILTER (s.bin <= t.bin AND s.bin > coalesce(l, -1)) AS low_l,
        min(s.x) FILTER (s.bin >= t.bin AND s.bin < coalesce(r, {bins})) AS low_r
    FROM {n}_wall t JOIN {source} s USING (recording_id) GROUP BY 1, 2, 3),
{n}_end AS (
    SELECT a.recording_id, a.bin, a.x FROM {source} a JOIN {source} b ON b.recording_id = a.recording_id AND b.bin = (a.bin + {bins - 1}) % {bins}
    JOIN {source} c ON c.recording_id = a.recording_id AND c.bin = (a.bin + 1) % {bins}
    WHERE a.bin IN (0, {bins - 1}) AND a.x > b.x AND a.x > c.x),
{n} AS (
    SELECT recording_id, bin FROM {n}_low JOIN {n}_need USING (recording_id) WHERE x - greatest(low_l, low_r) >= need
    UNION SELECT recording_id, bin FROM {n}_end JOIN {n}_need USING (recording_id){" WHERE x >= need" if high_ends else ""})"""


PEAKS = ",\n".join([
    FLAGS, histogram_sql("h100", 100, WEIGHT), smooth_sql("s100", "h100", 100, 0.8), peaks_sql("high", "s100", 100, 0.01, 1.0),
    histogram_sql("h33w", 33, WEIGHT), "h33 AS (SELECT recording_id, bin, round(x, 9) AS x FROM h33w)", peaks_sql("low", "h33", 33, 0.03, 0.0),
    """few AS (SELECT recording_id, count(low.bin) AS lows FROM recs LEFT JOIN low USING (recording_id) GROUP BY 1),
near AS (
    SELECT *, (bin + 0.5) * 12 AS cent FROM high JOIN few USING (recording_id)
    WHERE lows = 0 OR EXISTS (
        SELECT 1 FROM low WHERE low.recording_id = high.recording_id
        AND abs((((high.bin + 0.5) * 12 - (low.bin + 0.5) * 1200 / 33 + 600) % 1200 + 1200) % 1200 - 600) <= 45)),
noted AS (SELECT *, CAST(round_even(cent / 100, 0) % 12 AS INT) AS pc FROM near),
far AS (SELECT *, abs(((cent - pc * 100 + 600) % 1200 + 1200) % 1200 - 600)::DOUBLE AS distance FROM noted),
validated AS (
    SELECT recording_id, pc, cent::DOUBLE AS cent, distance FROM far
    QUALIFY row_number() OVER (PARTITION BY recording_id, pc ORDER BY distance, bin) = 1)""",
])


@R("histogram_hi_lo", f"""{FR}, {V}, {RECS}, {FLAGS}, {histogram_sql("a", 100, WEIGHT)}, {histogram_sql("b", 33, WEIGHT)}
    SELECT 100 AS bins, recording_id, bin, round(x, 6) AS count FROM a UNION ALL SELECT 33, recording_id, bin, round(x, 6) FROM b""")
def histogram_hi_lo(spark, d):
    f = S.frames(spark, d)
    both = H.folded(f, 100).withColumn("bins", F.lit(100)).unionByName(H.folded(f, 33).withColumn("bins", F.lit(33)))
    return both.withColumn("count", F.round("count", 6))


@R("window_mass", f"{FR}, {DIST} SELECT recording_id, pc, mass, round(p, 9) AS p FROM dist")
def window_mass(spark, d):
    return H.distribution(H.window_mass(S.frames(spark, d))).withColumn("p", F.round("p", 9))


@R("pc_distribution", f"{FR}, {V}, {RECS}, {COUNTS} SELECT recording_id, pc, n, round(n / sum(n) OVER (PARTITION BY recording_id), 9) AS share FROM counts")
def pc_distribution(spark, d):
    c = H.pitch_class_counts(S.frames(spark, d))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("recording_id")), 9))


@R("salience_survivors", f"{FR}, {V}, {RECS}, {COUNTS} SELECT recording_id, pc, n FROM (SELECT *, avg(n) OVER (PARTITION BY recording_id) AS m FROM counts) WHERE n > m")
def salience_survivors(spark, d):
    return H.salience_survivors(H.pitch_class_counts(S.frames(spark, d))).drop("mean")


@R("smoothed_histogram", f"""{FR}, {V}, {RECS}, {FLAGS}, {histogram_sql("h", 33)}, {smooth_sql("s", "h", 33, 0.8)}
    SELECT recording_id, bin, round(x, 6) AS smooth FROM s""")
def smoothed_histogram(spark, d):
    s = H.smoothed(H.folded(S.frames(spark, d), 33, weighted=False), 33, 0.8)
    return s.select("recording_id", F.posexplode("smooth").alias("bin", "smooth")).withColumn("smooth", F.round("smooth", 6))


HYP = f"""{DIST},
hyp AS (
    SELECT recording_id, scale_id, (pc - step + 12) % 12 AS tonic, count(*) AS size, sum(p) AS match_mass, sum(ln(p + 1e-12)) AS loglike,
        max(most) AS most, coalesce(max(p) FILTER (step = 0), 0) AS p0, coalesce(max(p) FILTER (step IN (5, 6, 7)), 0) AS pd
    FROM (SELECT *, max(p) OVER (PARTITION BY recording_id) AS most FROM dist) CROSS JOIN scale_steps GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
SCORED = f"""{HYP}, {COUNTS}, {PEAKS},
np AS (SELECT recording_id, count(pc) AS n_peaks FROM recs LEFT JOIN validated USING (recording_id) GROUP BY 1),
bandc AS (SELECT recording_id, {PC} AS tonic, count(*) AS n FROM v WHERE pitch_hz >= 20 AND pitch_hz < 80 GROUP BY 1, 2),
band AS (SELECT *, n / (max(n) OVER (PARTITION BY recording_id) + 1e-12) AS share FROM bandc),
scored AS (
    SELECT h.*, n_peaks, coalesce(n, 0) AS salience, coalesce(share, 0) AS share, p0 + pd AS prim,
        0.4 * match_mass + 0.25 * match_mass / size / (most + 1e-12)
        + greatest(0, least(1, 1 + loglike / (size + 1e-12) / ({math.log(12)!r} + 1e-12)))
        - (1.1 * (1 - match_mass) + 0.1 * greatest(0, (size - 5) / 12) + 0.25 * abs(size - n_peaks) / 4) AS fit_raw
    FROM hyp h JOIN np USING (recording_id) LEFT JOIN band USING (recording_id, tonic)),
fitted AS (SELECT *, 1000 * greatest(-1, least(1, fit_raw + 0.8 * share)) AS fit FROM scored)"""


def scored(spark, d):
    """Hypotheses with their scores; the peaks that a scale's size is held against are those detected in the histograms."""
    found = C.shares(H.profile(S.frames(spark, d), (20, 80)))
    return C.boost(C.score(C.hypotheses(found, S.scales(spark, d))))


@R("scale_cross_tonic", f"""{SC}, {HYP}
    SELECT recording_id, scale_id, tonic, size, round(match_mass, 6) AS match_mass, round(loglike / size, 6) AS mean_loglike FROM hyp""")
def scale_cross_tonic(spark, d):
    h = C.hypotheses(C.shares(H.profile(S.frames(spark, d))), S.scales(spark, d))
    return h.select("recording_id", "scale_id", "tonic", "size", F.round("match_mass", 6).alias("match_mass"), F.round(F.col("loglike") / F.col("size"), 6).alias("mean_loglike"))


@R("score_candidates", f"""{SC}, {SCORED}
    SELECT recording_id, scale_id, tonic, round(fit, 6) AS fit, round(prim, 6) AS primary_score, salience, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round(fit, 6) DESC, round(prim, 9) DESC, salience DESC, scale_id, tonic) AS rank
        FROM fitted) WHERE rank <= 20""")
def score_candidates(spark, d):
    r = C.ranked(scored(spark, d), 20)
    return r.select("recording_id", "scale_id", "tonic", F.round("fit", 6).alias("fit"), F.round("primary", 6).alias("primary_score"), "salience", "rank")


@R("score_variants", f"""{SC}, {SCORED},
    var AS (SELECT * FROM (SELECT unnest(['additive', 'multiplicative']) AS boost), (SELECT unnest([1, 2, 'infinity'::DOUBLE]) AS clip)),
    each AS (
        SELECT recording_id, boost, clip, CASE boost WHEN 'additive' THEN fit_raw + 0.8 * share ELSE fit_raw * (1 + 0.8 * share) END AS raw
        FROM scored CROSS JOIN var)
    SELECT recording_id, boost, clip, sum(abs(raw) > clip)::BIGINT AS saturated, round(max(greatest(-clip, least(clip, raw))), 6) AS top
    FROM each GROUP BY 1, 2, 3""")
def score_variants(spark, d):
    """How many scores each way to boost and clip them saturates, clipping at nothing included, and the highest."""
    s = scored(spark, d).withColumn("share", F.col("up") / 0.8)
    kinds = F.array(*[F.struct(F.lit(b).alias("boost"), F.lit(c).alias("clip")) for b in ("additive", "multiplicative") for c in (1.0, 2.0, float("inf"))])
    rows = s.select("recording_id", "fit_raw", "share", F.inline(kinds))
    raw = F.when(F.col("boost") == "additive", F.col("fit_raw") + 0.8 * F.col("share")).otherwise(F.col("fit_raw") * (1 + 0.8 * F.col("share")))
    clipped = F.greatest(-F.col("clip"), F.least("clip", "raw"))
    return rows.withColumn("raw", raw).groupBy("recording_id", "boost", "clip").agg(F.count_if(F.abs("raw") > F.col("clip")).alias("saturated"), F.round(F.max(clipped), 6).alias("top"))


@R("saturated_candidates", f"""{SC}, {SCORED}
    SELECT recording_id, scale_id, tonic, round(fit_raw + 0.8 * share, 6) AS raw FROM scored WHERE abs(round(fit_raw + 0.8 * share, 9)) > 1""")
def saturated_candidates(spark, d):
    """The hypotheses whose score is clipped, with what it would be."""
    return C.saturated(scored(spark, d)).withColumn("raw", F.round("raw", 6))


@R("top_score_ties", f"""{SC}, {SCORED}
    SELECT recording_id, count(*) AS tied FROM (
        SELECT recording_id, round(fit, 6) AS f, max(round(fit, 6)) OVER (PARTITION BY recording_id) AS m FROM fitted)
    WHERE abs(f - m) <= 1e-9 + 1e-5 * abs(m) GROUP BY 1""")
def top_score_ties(spark, d):
    s = scored(spark, d).select("recording_id", F.round("fit", 6).alias("f")).withColumn("m", F.max("f").over(Window.partitionBy("recording_id")))
    return s.where(F.abs(F.col("f") - F.col("m")) <= 1e-9 + 1e-5 * F.abs("m")).groupBy("recording_id").agg(F.count("*").alias("tied"))


@R("best_fit_per_tonic", f"""{SC}, {SCORED}
    SELECT recording_id, tonic, round(max(fit), 6) AS best, arg_max(scale_id, (round(fit, 6), -scale_id)) AS scale_id FROM fitted GROUP BY 1, 2""")
def best_fit_per_tonic(spark, d):
    s = scored(spark, d).withColumn("f", F.round("fit", 6))
    return s.groupBy("recording_id", "tonic").agg(F.round(F.max("fit"), 6).alias("best"), F.max_by("scale_id", F.struct("f", -F.col("scale_id"))).alias("scale_id"))


@R("tonic_features", f"""{SC}, {SCORED}, best AS (
        SELECT *, row_number() OVER (PARTITION BY recording_id, tonic ORDER BY round(match_mass, 9) DESC, scale_id) AS r FROM scored)
    SELECT recording_id, tonic, scale_id, round(match_mass, 6) AS match_mass, round(1 - match_mass, 6) AS extra_mass, size, salience,
        round(greatest(0, least(1, 1 + loglike / (size + 1e-12) / ({math.log(12)!r} + 1e-12))), 6) AS loglike_norm FROM best WHERE r = 1""")
def tonic_features(spark, d):
    """For each tonic the features of the scale of the largest mass: what a learner of tonics is given."""
    order = [F.round("match_mass", 9).desc(), F.col("scale_id")]
    best = C.best_per_recording(scored(spark, d), order, 1, "r", ("recording_id", "tonic"))
    return best.select("recording_id", "tonic", "scale_id", F.round("match_mass", 6).alias("match_mass"), F.round("extra_mass", 6).alias("extra_mass"), "size", "salience", F.round("loglike_norm", 6).alias("loglike_norm"))


@R("candidate_vectors", f"""{FR}, {DIST}, c AS (SELECT recording_id, {PC} AS pc, count(*) AS n FROM v WHERE track = 'view' GROUP BY 1, 2),
    m AS (
        SELECT d.recording_id, d.pc, p, n / sum(n) OVER (PARTITION BY d.recording_id) AS a
        FROM dist d LEFT JOIN c ON c.recording_id = d.recording_id AND c.pc = d.pc),
    t AS (SELECT m.*, tonic, (pc - tonic + 12) % 12 AS place FROM m, (SELECT unnest(range(12)) AS tonic))
    SELECT recording_id, tonic, array_to_string(list(round(p, 6)::DECIMAL(9, 6) ORDER BY place), ',') AS melody,
        array_to_string(list(round(coalesce(a, 0), 6)::DECIMAL(9, 6) ORDER BY place), ',') AS accompaniment FROM t GROUP BY 1, 2""")
def candidate_vectors(spark, d):
    """The shares of the twelve notes of melody and accompaniment from each tonic on; without an accompaniment all zero."""
    f = S.frames(spark, d)
    both = C.shares(H.profile(f)).join(H.profile(f.where("track = 'view'")).select("recording_id", F.col("counts").alias("a")), "recording_id", "left")
    return C.turned_vectors(both, "p", "a").select("recording_id", "tonic", "melody", "accompaniment")


@R("candidate_valleys", f"""{SC}, {SCORED}, {histogram_sql("h1", 1200)}, {smooth_sql("s1", "h1", 1200, 5.0)},
    dip AS (
        SELECT a.recording_id, a.bin // 100 AS pc FROM s1 a JOIN s1 b ON b.recording_id = a.recording_id AND b.bin = (a.bin + 1185) % 1200
        JOIN s1 c ON c.recording_id = a.recording_id AND c.bin = a.bin + 15 WHERE a.bin % 100 = 0 AND a.x < b.x AND a.x < c.x),
    tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, pc DESC) AS r FROM counts) JOIN np USING (recording_id) WHERE r <= n_peaks),
    bad AS (SELECT recording_id, pc FROM dip ANTI JOIN tops USING (recording_id, pc)),
    hit AS (SELECT recording_id, scale_id, (pc - step + 12) % 12 AS tonic, count(*) AS n FROM bad CROSS JOIN scale_steps GROUP BY 1, 2, 3)
    SELECT s.recording_id, s.scale_id, s.tonic, coalesce(hit.n, 0)::INT AS valley_penalty FROM scored s
    LEFT JOIN hit ON hit.recording_id = s.recording_id AND hit.scale_id = s.scale_id AND hit.tonic = s.tonic""")
def candidate_valleys(spark, d):
    """Of each hypothesis the notes that lie in a valley of the melody, but for the recording's most frequent ones."""
    f = S.frames(spark, d)
    found = C.shares(H.profile(f)).join(T.dips(O.voiced(f)), "recording_id")
    scales = S.scales(spark, d)
    on = scales.select("scale_id", C.bits(lambda i: F.get("mask", F.lit(i)) == 1).alias("on"))
    h = C.hypotheses(C.low_notes(found), scales).join(F.broadcast(on), "scale_id")
    return C.valleys(h).select("recording_id", "scale_id", "tonic", "valley_penalty")


@R("interval_candidates", f"""{SC}, {V}, {RECS}, {PEAKS},
    sets AS (SELECT recording_id, list(pc ORDER BY pc) AS pcs FROM validated GROUP BY 1),
    rot AS (SELECT recording_id, pcs[k] AS tonic, [(pcs[(k + i - 2) % len(pcs) + 1] - pcs[k] + 12) % 12 FOR i IN range(1, len(pcs) + 1)] AS notes FROM sets, unnest(range(1, len(pcs) + 1)) AS u(k)),
    sc AS (SELECT scale_id, list(step ORDER BY step) AS notes FROM scale_steps GROUP BY 1 HAVING count(*) >= 2)
    SELECT recording_id, tonic, scale_id, array_to_string(sc.notes, ',') AS steps FROM rot JOIN sc ON sc.notes = rot.notes""".replace("[(k + i - 2)", "[(k + i - 2)"))
def interval_candidates(spark, d):
    """The scales whose intervals are exactly those between a recording's detected notes, from each of them as the tonic."""
    notes = H.detected_peaks(S.frames(spark, d)).groupBy("recording_id").agg(F.sort_array(F.collect_list("pc")).alias("pcs"))
    return C.by_intervals(notes, S.scales(spark, d))


@R("band_sweep_rollup", f"""{FR}, {V}, g AS (SELECT lo, hi FROM (SELECT unnest([10, 20, 40]) AS lo), (SELECT unnest([60, 80, 160]) AS hi)),
    c AS (SELECT lo, hi, track, recording_id, {PC} AS pc, count(*) AS n FROM v, g WHERE pitch_hz >= lo AND pitch_hz < hi GROUP BY ALL)
    SELECT lo, hi, track, sum(n)::BIGINT AS frames, sum(n) FILTER (pc = recording_id % 12)::BIGINT AS on_tonic FROM c GROUP BY ROLLUP (lo, hi, track)""")
def band_sweep_rollup(spark, d):
    grid = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo in (10, 20, 40) for hi in (60, 80, 160)])
    v = O.voiced(S.frames(spark, d)).select("recording_id", "track", "pitch_hz", F.inline(grid)).where("pitch_hz >= lo and pitch_hz < hi")
    hit = E.pitch_class(E.hz_to_midi("pitch_hz")) == F.col("recording_id") % 12
    return v.rollup("lo", "hi", "track").agg(F.count("*").alias("frames"), F.sum(F.when(hit, 1)).alias("on_tonic"))


@R("minmax_gate", f"""{SC}, {SCORED}, top AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round(fit, 6) DESC, scale_id, tonic) AS r, count(*) FILTER (round(fit, 6) > 0) OVER (PARTITION BY recording_id) AS pos FROM fitted),
    kept AS (SELECT * FROM top WHERE CASE WHEN pos > 0 THEN round(fit, 6) > 0 ELSE r <= 20 END)
    SELECT recording_id, scale_id, tonic, round(CASE WHEN max(fit) OVER w > min(fit) OVER w THEN (fit - min(fit) OVER w) / (max(fit) OVER w - min(fit) OVER w) ELSE 0 END, 6) AS norm FROM kept WINDOW w AS (PARTITION BY recording_id)""")
def minmax_gate(spark, d):
    """Keeps hypotheses of a positive score, or the best 20 of a recording that has none, and spreads their scores over 0 to 1."""
    w, f = Window.partitionBy("recording_id"), F.round("fit", 6)
    s = scored(spark, d).withColumn("pos", F.sum((f > 0).cast("int")).over(w)).withColumn("r", F.row_number().over(w.orderBy(f.desc(), "scale_id", "tonic")))
    k = s.where(F.when(F.col("pos") > 0, f > 0).otherwise(F.col("r") <= 20))
    lo, hi = F.min("fit").over(w), F.max("fit").over(w)
    return k.select("recording_id", "scale_id", "tonic", F.round(F.when(hi > lo, (F.col("fit") - lo) / (hi - lo)).otherwise(0.0), 6).alias("norm"))


@R("interval_lookup", f"""{S.with_("scales")}, iv AS (SELECT scale_id, [(coalesce(st[i + 1], st[1]) - st[i] + 11) % 12 + 1 FOR i IN range(1, len(st) + 1)] AS iv FROM (SELECT scale_id, list(step ORDER BY step) AS st FROM scale_steps GROUP BY 1)),
    c AS (SELECT *, list_min([list_concat(iv[k + 1:len(iv)], iv[1:k]) FOR k IN range(len(iv))]) AS canon FROM iv)
    SELECT a.scale_id AS scale_id, b.scale_id AS like_id, a.iv = b.iv AS same FROM c a JOIN c b ON a.canon = b.canon AND a.scale_id <> b.scale_id""")
def interval_lookup(spark, d):
    """Scales that are rotations of one another: an equi-join on the least rotation."""
    from ..functions import arrays as A

    s = S.scales(spark, d).select("scale_id", A.intervals("mask").alias("iv")).withColumn("canon", A.canonical(F.col("iv")))
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.canon") == F.col("b.canon")) & (F.col("a.scale_id") != F.col("b.scale_id"))).select(F.col("a.scale_id").alias("scale_id"), F.col("b.scale_id").alias("like_id"), (F.col("a.iv") == F.col("b.iv")).alias("same"))


@R("peaks", f"{FR}, {V}, {RECS}, {PEAKS} SELECT recording_id, pc, cent, round(distance, 6) AS distance FROM validated")
def peaks(spark, d):
    return H.detected_peaks(S.frames(spark, d)).withColumn("distance", F.round("distance", 6))


@R("peak_counts", ",\n".join([
    FR, V, RECS, FLAGS, histogram_sql("h100", 100), smooth_sql("s100", "h100", 100, 0.8), peaks_sql("high", "s100", 100, 0.03, 1.0, False),
    histogram_sql("h33", 33), peaks_sql("low", "h33", 33, 0.01, 0.0, False),
    """near AS (
        SELECT recording_id, (high.bin + 0.5) * 12 AS cent FROM high WHERE EXISTS (
            SELECT 1 FROM low WHERE low.recording_id = high.recording_id AND abs((high.bin + 0.5) * 12 - (low.bin + 0.5) * 1200 / 33) <= 45)),
    notes AS (SELECT recording_id, floor(cent / 100 + 0.5) AS note, cent FROM near),
    counted AS (SELECT recording_id, count(DISTINCT note % 12) FILTER (abs(cent - note * 100) <= 35) AS n FROM recs LEFT JOIN notes USING (recording_id) GROUP BY 1)
    SELECT recording_id, coalesce(n, 7)::INT AS peaks FROM (SELECT DISTINCT recording_id FROM frames) LEFT JOIN counted USING (recording_id)""",
]))
def peak_counts(spark, d):
    f = S.frames(spark, d)
    hi = H.peaks(H.smoothed(H.folded(f, 100, weighted=False), 100, 0.8), "smooth", 0.03, 2, 1.0, False)
    lo = H.peaks(H.vectors(H.folded(f, 33, weighted=False)), "h", 0.01, 1, 0.0, False)
    return H.peak_counts(f.select("recording_id").distinct(), hi, lo, 100, 33)


@R("primary_ranking", f"""{FR}, {V}, {RECS}, {COUNTS},
    t AS (SELECT a.recording_id, a.pc AS tonic, a.n + coalesce(max(b.n), 0) AS score FROM counts a LEFT JOIN counts b ON b.recording_id = a.recording_id AND (b.pc - a.pc + 12) % 12 IN (5, 6, 7) GROUP BY 1, 2, a.n)
    SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, tonic) AS place FROM t""")
def primary_ranking(spark, d):
    """Tonics by how often they and the strongest of their fourths and fifth are heard."""
    c = C.shares(H.profile(S.frames(spark, d))).select("recording_id", "counts", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("tonic"))
    at = lambda i: F.get("counts", (F.col("tonic") + i) % 12)
    return C.best_per_recording(c.select("recording_id", "tonic", (at(0) + F.greatest(at(5), at(6), at(7))).alias("score")), [F.col("score").desc(), F.col("tonic")], None, "place")


@R("circular_minima", ",\n".join([
    FR, V, RECS, FLAGS, histogram_sql("h33", 33),
    "three AS (SELECT recording_id, bin + 33 * k AS bin, -x AS x FROM h33, (SELECT unnest([0, 1, 2]) AS k))", peaks_sql("low", "three", 99, 0.0, 1.0, False),
    "SELECT recording_id, bin % 33 AS bin FROM low WHERE bin >= 33 AND bin < 66",
]).replace(",\nSELECT", "\nSELECT"))
def circular_minima(spark, d):
    """The places around the octave that lie lower than both their sides."""
    h = H.vectors(H.folded(S.frames(spark, d), 33, weighted=False)).withColumn("h", F.transform(F.concat("h", "h", "h"), lambda x: -x))
    found = H.peaks(h, "h", 0.0, 1, 1.0, False).select("recording_id", F.explode("peaks").alias("b"))
    return found.where("b >= 33 and b < 66").select("recording_id", (F.col("b") % 33).alias("bin"))


@R("gaussian_vector", f"""{FR}, {V}, {RECS}, {PEAKS},
    t AS (SELECT recording_id, bin, x / sum(x) OVER (PARTITION BY recording_id) AS v FROM s100),
    w AS (
        SELECT p.recording_id, p.bin AS peak, a.v AS height, (b.bin + 0.5) * 12 AS cent, b.v AS v FROM high p JOIN t a ON a.recording_id = p.recording_id AND a.bin = p.bin
        JOIN t b ON b.recording_id = p.recording_id AND least(abs(b.bin - p.bin), 100 - abs(b.bin - p.bin)) * 12 <= 75),
    k AS (SELECT *, greatest(1, floor(round(v * greatest(1, floor(round(1000 / greatest(sum(v) OVER (PARTITION BY recording_id, peak), 1e-6), 3))), 3))) AS n FROM w),
    g AS (SELECT recording_id, peak, height, sum(n * cent) / sum(n) AS mu, sum(n * cent * cent) / sum(n) AS m2, sum(n) AS n FROM k GROUP BY 1, 2, 3),
    o AS (SELECT *, CAST(round_even((peak + 0.5) * 12 / 100, 0) % 12 AS INT) AS pc, (peak + 0.5) * 12 AS middle FROM g WHERE n >= 5)
    SELECT recording_id, pc, round(height, 6) AS height, round(((mu - middle + 600) % 1200 + 1200) % 1200 - 600, 4) AS deviation, round(sqrt(greatest(m2 - mu * mu, 0) + 1e-6), 4) AS sigma
    FROM o QUALIFY row_number() OVER (PARTITION BY recording_id, pc ORDER BY round(height, 9) DESC, peak) = 1""")
def gaussian_vector(spark, d):
    """For each note its highest peak: height, and deviation and spread of a Gaussian around it."""
    smooth = H.smoothed(H.folded(S.frames(spark, d), 100), 100, 0.8)
    v = H.gaussian_vector(H.peaks(smooth, "smooth", 0.01, 2, 1.0))
    return v.select("recording_id", "pc", F.round("height", 6).alias("height"), F.round("deviation", 4).alias("deviation"), F.round("sigma", 4).alias("sigma"))


@R("gmm_closed_form", f"""{FR}, {V}, h AS (SELECT recording_id, CAST(least(floor(cent * 100 / 1200), 99) AS INT) AS bin, count(*) AS c FROM v GROUP BY 1, 2),
    p AS (SELECT DISTINCT recording_id, k * 100.0::DOUBLE AS cent FROM v CROSS JOIN (SELECT unnest(range(12)) AS k)),
    o AS (SELECT p.recording_id, p.cent, c, (((bin + 0.5) * 12 - p.cent + 600) % 1200 + 1200) % 1200 - 600 AS off FROM p JOIN h USING (recording_id)),
    g AS (SELECT recording_id, cent, sum(c)::BIGINT AS n, sum(c * off) / sum(c) AS m, sum(c * off * off) / sum(c) AS m2 FROM o WHERE abs(off) <= 75 GROUP BY 1, 2)
    SELECT recording_id, cent, n, round(cent + m, 5) AS mean, round(sqrt(greatest(m2 - m * m, 0) + 1e-6), 4) AS sigma FROM g""")
def gmm_closed_form(spark, d):
    f = S.frames(spark, d)
    p = O.voiced(f).select("recording_id").distinct().select("recording_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: i * 100.0)).alias("cent"))
    g = H.gaussian_at(H.folded(f, 100, weighted=False, zeros=False), p, 100)
    return g.select("recording_id", "cent", "n", F.round("mean", 5).alias("mean"), F.round("sigma", 4).alias("sigma"))


QUERIES, ORACLE = R.queries, R.oracle
