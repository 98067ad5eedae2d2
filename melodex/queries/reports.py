"""Reports, sweeps, name matching, further scoring parts and parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import exprs as E
from ..operators import frames as O
from ..operators import histogram as H
from ..operators import joins as J
from ..operators import phrases as P
from ..operators import ranking as K
from ..operators import reports as T
from ..operators import scoring as C
from ..sources import adapters as S
from .registry import Registry
from .scoring import DIST, FR, HYP, PC, RECS, SC, SCORED, COUNTS, V, scored
from .sequences import GRAD, N, NO, PH, phrases

R = Registry()


@R("drone_boost", f"{FR}, {V}, {RECS}, a AS (SELECT recording_id, {PC} AS pc, count(*) AS n FROM v WHERE track = 'view' GROUP BY 1, 2), s AS (SELECT recording_id, pc, n / (max(n) OVER (PARTITION BY recording_id) + 1e-12) AS s FROM a), b AS (SELECT recording_id, pc AS tonic, s FROM s UNION ALL SELECT recording_id, (pc + 5) % 12, s FROM s) SELECT recording_id, tonic, round(0.2 * sum(s), 6) AS boost FROM b GROUP BY 1, 2")
def drone_boost(spark, d):
    c = O.voiced(S.frames(spark, d)).where("track = 'view'").groupBy("recording_id", E.pitch_class(E.hz_to_midi("pitch_hz")).alias("pc")).agg(F.count("*").alias("n"))
    return T.drone_boost(c).withColumn("boost", F.round("boost", 6))


@R("valley_penalty", f"""{FR}, {V}, h AS (SELECT recording_id, CAST(floor(cent) AS INT) AS b, count(*) AS c FROM v GROUP BY 1, 2), k AS (SELECT o, exp(-0.5 * (o / 5.0) ** 2) / (SELECT sum(exp(-0.5 * (unnest / 5.0) ** 2)) FROM unnest(range(-20, 21))) AS w FROM (SELECT unnest(range(-20, 21)) AS o)),
    sm AS (SELECT recording_id, CAST((b - o + 1200) % 1200 AS INT) AS b, sum(c * w) AS s FROM h, k GROUP BY 1, 2), pts AS (SELECT r.recording_id, pc, round(coalesce(m.s, 0), 9) AS mid, round(coalesce(lo.s, 0), 9) AS lo, round(coalesce(hi.s, 0), 9) AS hi FROM (SELECT DISTINCT recording_id, pc FROM v, (SELECT CAST(unnest(range(12)) AS INT) AS pc)) r
        LEFT JOIN sm m ON m.recording_id = r.recording_id AND m.b = pc * 100 LEFT JOIN sm lo ON lo.recording_id = r.recording_id AND lo.b = (pc * 100 + 1185) % 1200 LEFT JOIN sm hi ON hi.recording_id = r.recording_id AND hi.b = pc * 100 + 15)
    SELECT recording_id, count(*) FILTER (mid < lo AND mid < hi) AS valleys, count(*) FILTER (mid < lo OR mid < hi) AS slopes FROM pts GROUP BY 1""")
def valley_penalty(spark, d):
    return T.valleys(O.voiced(S.frames(spark, d)))


@R("bias_median_deviation", f"{FR}, {V}, dv AS (SELECT recording_id, cent - 100 * round_even(cent / 100, 0) AS dev FROM v WHERE confidence > 0.5) SELECT recording_id, CASE WHEN count(*) >= 3 THEN round(median(dev), 5) END AS bias FROM dv GROUP BY 1")
def bias_median_deviation(spark, d):
    f = O.voiced(S.frames(spark, d)).where("confidence > 0.5").withColumn("cent", E.cents(E.hz_to_midi("pitch_hz")))
    dev = F.col("cent") - 100 * E.half_even(F.col("cent") / 100)
    return f.groupBy("recording_id").agg(F.when(F.count("*") >= 3, F.round(F.median(dev), 5)).alias("bias"))


@R("derivative_percentiles", f"{FR}, x AS (SELECT track, recording_id, abs((pitch_hz - lag(pitch_hz) OVER w) / (t - lag(t) OVER w)) AS dv FROM frames WHERE voicing WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, frame_id)) SELECT recording_id, round(quantile_cont(dv, 0.75), 4) AS p75, round(quantile_cont(dv, 0.85), 4) AS p85, round(quantile_cont(dv, 0.95), 4) AS p95, round(quantile_cont(dv, 0.99), 3) AS p99 FROM x WHERE dv IS NOT NULL GROUP BY 1")
def derivative_percentiles(spark, d):
    x = O.derivative(O.voiced(S.frames(spark, d)), "pitch_hz").withColumn("r", F.row_number().over(S.by_time())).where("r > 1")
    p = x.groupBy("recording_id").agg(F.percentile("derivative", [0.75, 0.85, 0.95, 0.99]).alias("p"))
    return p.select("recording_id", *(F.round(F.col("p")[i], 3 if n == 99 else 4).alias(f"p{n}") for i, n in enumerate((75, 85, 95, 99))))


@R("transition_activity", f"{NO}, x AS (SELECT recording_id, pc AS a, lead(pc) OVER ({N}) AS b FROM notes) SELECT recording_id, pc, count(*) AS activity FROM (SELECT recording_id, a AS pc FROM x WHERE b IS NOT NULL UNION ALL SELECT recording_id, b FROM x WHERE b IS NOT NULL) GROUP BY 1, 2")
def transition_activity(spark, d):
    return T.transition_activity(P.transitions(S.notes(spark, d), []))


@R("deletion_rate", f"{NO} SELECT recording_id, round(CAST(avg(CASE WHEN pc IN (1, 3, 6, 8, 10) THEN 1.0::DOUBLE ELSE 0 END) AS DECIMAL(18, 9)), 6)::DOUBLE AS rate, round(CAST(avg(CASE WHEN pc IN (1, 3, 6, 8, 10) THEN 1.0::DOUBLE ELSE 0 END) - (-0.06 * 7 + 0.7) AS DECIMAL(18, 9)), 6)::DOUBLE AS residual FROM notes GROUP BY 1")
def deletion_rate(spark, d):
    return T.deletion_rates(S.notes(spark, d), [0, 2, 4, 5, 7, 9, 11], -0.06, 0.7)


@R("window_sweep_summary", f"""{FR}, b AS (SELECT *, min(t) OVER (PARTITION BY recording_id) AS t0, max(t) OVER (PARTITION BY recording_id) AS t1 FROM frames), w AS (SELECT 'full' AS label, * FROM b UNION ALL SELECT 'first_20', * FROM b WHERE t < t0 + 20 UNION ALL SELECT 'last_20', * FROM b WHERE t >= greatest(t0, t1 - 20))
    SELECT label, count(DISTINCT recording_id) AS recordings, count(*) AS frames, round(avg(confidence), 6) AS confidence, round(avg(voicing::INT), 6) AS voiced FROM w GROUP BY 1""")
def window_sweep_summary(spark, d):
    f = S.frames(spark, d)
    rows = f.withColumn("label", F.lit("full"))
    for label, part in (("first_20", O.time_window(f, first=20)), ("last_20", O.time_window(f, last=20))):
        rows = rows.unionByName(part.withColumn("label", F.lit(label)))
    return rows.groupBy("label").agg(F.count_distinct("recording_id").alias("recordings"), F.count("*").alias("frames"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.col("voicing").cast("int")), 6).alias("voiced"))


@R("band_grid_best", f"""{FR}, {V}, g AS (SELECT lo, lo + w AS hi, gate FROM (SELECT unnest(range(10, 60, 10)) AS lo), (SELECT unnest([20, 40, 80]) AS w), (SELECT unnest([0, 50]) AS gate)),
    c AS (SELECT lo, hi, gate, recording_id, {PC} AS pc, count(*) AS n FROM v, g WHERE pitch_hz >= lo AND pitch_hz < hi AND confidence * 100 >= gate GROUP BY ALL), p AS (SELECT lo, hi, gate, recording_id, arg_max(pc, (n, -pc)) AS pick FROM c GROUP BY 1, 2, 3, 4),
    a AS (SELECT lo, hi, gate, count(*) AS covered, sum((pick = recording_id % 12)::INT)::BIGINT AS right_ FROM p GROUP BY 1, 2, 3)
    SELECT lo, hi, gate, covered, right_ AS correct, place FROM (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY right_ DESC, hi - lo, lo) AS place FROM a) WHERE place <= 5""")
def band_grid_best(spark, d):
    """A grid of bands and confidence gates: the strongest note of each as a guess at the tonic; the best five bands of a gate."""
    return T.band_grid(O.voiced(S.frames(spark, d)), range(10, 60, 10), (20, 40, 80), (0, 50))


@R("penalised_rank", "WITH b AS (SELECT l_orderkey, max(l_extendedprice) FILTER (l_returnflag = 'R' AND l_discount < 0.08) AS best FROM lineitem GROUP BY 1) SELECT b.l_orderkey, CASE WHEN best IS NULL THEN 1000 ELSE 1 + count(*) FILTER (l.l_extendedprice > best) END AS rank FROM b JOIN lineitem l USING (l_orderkey) GROUP BY b.l_orderkey, best")
def penalised_rank(spark, d):
    li = S.table(spark, d, "lineitem").withColumn("ok", (F.col("l_returnflag") == "R") & (F.col("l_discount") < 0.08))
    best = F.max(F.when(F.col("ok"), F.col("l_extendedprice"))).over(Window.partitionBy("l_orderkey"))
    g = li.withColumn("best", best).groupBy("l_orderkey").agg(F.max("best").alias("b"), F.sum((F.col("l_extendedprice") > F.col("best")).cast("long")).alias("over"))
    return g.select("l_orderkey", F.when(F.col("b").isNull(), F.lit(1000)).otherwise(1 + F.col("over")).alias("rank"))


@R("fifth_errors", f"{FR}, {V}, {RECS}, {COUNTS}, p AS (SELECT recording_id, arg_max(pc, (n, -pc)) AS pick FROM counts GROUP BY 1), e AS (SELECT ((pick - recording_id % 12) % 12 + 12) % 12 AS off FROM p) SELECT count(*) AS recordings, count(*) FILTER (off <> 0) AS errors, round(avg((off IN (5, 7))::INT) FILTER (off <> 0), 6) AS fifths FROM e")
def fifth_errors(spark, d):
    best = H.pitch_class_counts(S.frames(spark, d)).groupBy("recording_id").agg(F.max_by("pc", F.struct("n", -F.col("pc"))).alias("pick"))
    off = best.select(F.pmod(F.col("pick") - F.col("recording_id") % 12, F.lit(12)).alias("off"))
    return off.agg(F.count("*").alias("recordings"), F.count(F.when(F.col("off") != 0, 1)).alias("errors"), F.round(F.avg(F.when(F.col("off") != 0, F.col("off").isin(5, 7).cast("int"))), 6).alias("fifths"))


@R("tonic_rotation_check", f"{SC}, {HYP}, o AS (SELECT recording_id, tonic, match_mass FROM hyp WHERE scale_id = recording_id % (SELECT max(scale_id) FROM scales) + 1), b AS (SELECT recording_id, arg_max(tonic, (round(match_mass, 9), -tonic)) AS best, max(match_mass) AS top, max(match_mass) FILTER (tonic = recording_id % 12) AS own FROM o GROUP BY 1) SELECT recording_id, best, ((best - recording_id % 12) % 12 + 12) % 12 AS shift, round(top - own, 6) AS gain FROM b WHERE top - own > 0.01")
def tonic_rotation_check(spark, d):
    """Whether another tonic fits a recording's own scale clearly better than its own tonic."""
    found = C.shares(H.profile(S.frames(spark, d)))
    scales = S.scales(spark, d)
    h = C.hypotheses(found, scales).where(F.col("scale_id") == F.col("recording_id") % scales.count() + 1)
    own = F.max(F.when(F.col("tonic") == F.col("recording_id") % 12, F.col("match_mass")))
    b = h.groupBy("recording_id").agg(F.max_by("tonic", F.struct(F.round("match_mass", 9), -F.col("tonic"))).alias("best"), F.max("match_mass").alias("top"), own.alias("own"))
    return b.where("top - own > 0.01").select("recording_id", "best", F.pmod(F.col("best") - F.col("recording_id") % 12, F.lit(12)).alias("shift"), F.round(F.col("top") - F.col("own"), 6).alias("gain"))


@R("note_stats", f"{NO}, k AS (SELECT recording_id, pc, count(*) AS n, sum(count(*)) OVER (PARTITION BY recording_id) AS whole FROM notes GROUP BY 1, 2) SELECT recording_id, pc, n, round(100.0::DOUBLE * n / whole, 4) AS percent, place FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, pc) AS place FROM k) WHERE place <= 7")
def note_stats(spark, d):
    k = S.notes(spark, d).groupBy("recording_id", "pc").agg(F.count("*").alias("n"))
    w = Window.partitionBy("recording_id")
    k = k.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(w), 4)).withColumn("place", F.row_number().over(w.orderBy(F.col("n").desc(), "pc")))
    return k.where("place <= 7")


@R("distinct_trigrams", f"{NO}, x AS (SELECT recording_id, pc AS a, lead(pc) OVER ({N}) AS b, lead(pc, 2) OVER ({N}) AS c FROM notes) SELECT recording_id, count(*) AS trigrams, count(DISTINCT a * 144 + b * 12 + c) AS types FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1")
def distinct_trigrams(spark, d):
    """Neighbouring notes by threes, all three of known pitch, and how many kinds there are."""
    w = S.note_order()
    x = S.notes(spark, d).select("recording_id", (F.col("pc") * 144 + F.lead("pc").over(w) * 12 + F.lead("pc", 2).over(w)).alias("g")).where("g is not null")
    return x.groupBy("recording_id").agg(F.count("*").alias("trigrams"), F.count_distinct("g").alias("types"))


@R("fixed_gap_phrases_dropped", f"{NO}, {PH.replace(str(S.UNIT // 2), str(S.UNIT))}, p AS (SELECT recording_id, phrase, count(*) AS n FROM ph GROUP BY 1, 2) SELECT recording_id, count(*) AS phrases, sum(n)::BIGINT AS notes FROM p WHERE n >= 4 GROUP BY 1")
def fixed_gap_phrases_dropped(spark, d):
    return P.phrase_bounds(phrases(spark, d, 1.0)).where("notes >= 4").groupBy("recording_id").agg(F.count("*").alias("phrases"), F.sum("notes").alias("notes"))


@R("scale_name_filter", f"""{S.with_('scales')} SELECT scale_id, name FROM scales WHERE list_has_any([trim(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'))], ['brand 1 0', 'brand 7 2', 'brand 12 1'])""")
def scale_name_filter(spark, d):
    wanted = F.transform(F.split(F.lit(" Brand#1-0, BRAND#7-2,,Brand 12 1"), ","), lambda x: E.normal_name(F.trim(x)))
    s = S.scales(spark, d)
    return s.where(F.arrays_overlap(F.array(E.normal_name("name")), F.filter(F.array_distinct(wanted), lambda x: x != ""))).select("scale_id", "name")


@R("tonic_allow_list", f"""{FR}, {V}, {RECS}, {COUNTS}, sv AS (SELECT recording_id, list_sort(list(pc)) AS l FROM (SELECT *, avg(n) OVER (PARTITION BY recording_id) AS m FROM counts) WHERE n > m GROUP BY 1),
    a AS (SELECT recording_id, CASE recording_id % 3 WHEN 0 THEN [0, 2, 4] WHEN 1 THEN NULL ELSE [7, 9] END AS given FROM recs) SELECT recording_id, array_to_string(coalesce(given, l, range(12)), ',') AS tonics, array_to_string(CASE WHEN len([x FOR x IN l IF list_contains(given, x)]) > 0 THEN [x FOR x IN l IF list_contains(given, x)] ELSE given END, ',') AS both FROM a LEFT JOIN sv USING (recording_id)""")
def tonic_allow_list(spark, d):
    """Tonics to try: those given, else the notes heard more than the mean, else all; and the given ones that are also heard."""
    c = H.salience_survivors(H.pitch_class_counts(S.frames(spark, d))).groupBy("recording_id").agg(F.sort_array(F.collect_list("pc")).alias("l"))
    given = F.when(F.col("recording_id") % 3 == 0, F.array(F.lit(0), F.lit(2), F.lit(4))).when(F.col("recording_id") % 3 == 2, F.array(F.lit(7), F.lit(9)))
    rows = O.voiced(S.frames(spark, d)).select("recording_id").distinct().join(c, "recording_id", "left").withColumn("given", given)
    both = F.filter("l", lambda x: F.array_contains(F.col("given"), x))
    text = lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), ",")
    return rows.select("recording_id", text(F.coalesce("given", "l", F.sequence(F.lit(0), F.lit(11)))).alias("tonics"), text(F.when(F.size(both) > 0, both).otherwise(F.col("given"))).alias("both"))


@R("names_ignoring_case", "SELECT lower(w) AS low, min(w) AS first FROM (SELECT trim(unnest(string_split(p_name || ',' || upper(p_type) || ', ' || p_type, ','))) AS w FROM part) WHERE w <> '' GROUP BY 1")
def names_ignoring_case(spark, d):
    raw = F.concat_ws(",", "p_name", F.upper("p_type"), F.concat(F.lit(" "), F.col("p_type")))
    names = S.table(spark, d, "part").select(F.explode(E.name_list(raw)).alias("w"))
    return names.groupBy(F.lower("w").alias("low")).agg(F.min("w").alias("first"))


SPELLED = """WITH k AS (SELECT DISTINCT p_name AS name FROM part),
    w AS (
        SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'i', 'ee') WHEN 2 THEN 'no ' || p_name ELSE p_name END AS name
        FROM part),
    c AS (SELECT w.name, k.name AS found, CASE WHEN k.name = w.name THEN 1 WHEN lower(k.name) = lower(w.name) THEN 2 WHEN replace(lower(k.name), 'ee', 'i') = replace(lower(w.name), 'ee', 'i') THEN 3 END AS stage FROM w JOIN k ON replace(lower(k.name), 'ee', 'i') = replace(lower(w.name), 'ee', 'i'))"""


@R("spelling_variants", f"""{SPELLED}
    SELECT w.name, r.found, coalesce(r.stage, 9) AS stage FROM w LEFT JOIN (SELECT name, arg_min(found, (stage, found)) AS found, min(stage) AS stage FROM c GROUP BY 1) r ON r.name = w.name""")
def spelling_variants(spark, d):
    p = S.table(spark, d, "part")
    k = p.select(F.col("p_name").alias("found")).distinct()
    way, name = F.col("p_partkey") % 5, F.col("p_name")
    form = F.when(way == 0, F.upper(name)).when(way == 1, F.replace(name, F.lit("i"), F.lit("ee"))).when(way == 2, F.concat(F.lit("no "), name)).otherwise(name)
    return J.spelled_alike(p.select(form.alias("name")).distinct(), k)


@R("name_match_report", f"""{SPELLED} SELECT coalesce(stage, 9) AS stage, count(*) AS names FROM w LEFT JOIN (SELECT name, min(stage) AS stage FROM c GROUP BY 1) USING (name) GROUP BY 1""")
def name_match_report(spark, d):
    """How many names are found at each stage of spelling."""
    return spelling_variants(spark, d).groupBy("stage").agg(F.count("*").alias("names"))


@R("name_likeness", "SELECT p_partkey, lower(p_name) = lower(p_type) OR contains(lower(p_name), lower(p_type)) OR contains(lower(p_type), lower(p_name)) AS near, contains(lower(p_name), lower(split_part(p_name, ' ', 1))) AS part FROM part")
def name_likeness(spark, d):
    return S.table(spark, d, "part").select("p_partkey", E.near("p_name", "p_type").alias("near"), E.near("p_name", F.substring_index("p_name", " ", 1)).alias("part"))


@R("distinct_masks_last_wins", f"{S.with_('scales')} SELECT code % 64 AS mask, arg_max(name, scale_id) AS name, count(*) AS names FROM scales GROUP BY 1")
def distinct_masks_last_wins(spark, d):
    return S.scales(spark, d).groupBy((F.col("code") % 64).alias("mask")).agg(F.max_by("name", "scale_id").alias("name"), F.count("*").alias("names"))


@R("smooth_reflect", f"""{FR}, m AS (SELECT recording_id, frame_id, pitch_hz AS x, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, frame_id) - 1 AS i, count(*) OVER (PARTITION BY recording_id) AS n FROM frames),
    k AS (SELECT o, exp(-0.5 * (o / 1.5) ** 2) / (SELECT sum(exp(-0.5 * (unnest / 1.5) ** 2)) FROM unnest(range(-6, 7))) AS w FROM (SELECT unnest(range(-6, 7)) AS o)),
    p AS (SELECT recording_id, frame_id, w, n, ((i + o) % (2 * n) + 2 * n) % (2 * n) AS j FROM m, k),
    a AS (SELECT recording_id, frame_id, w, CASE WHEN j >= n THEN 2 * n - 1 - j ELSE j END AS j FROM p)
    SELECT a.frame_id, round(sum(w * x), 6) AS smooth FROM a JOIN m ON m.recording_id = a.recording_id AND m.i = a.j GROUP BY 1""")
def smooth_reflect(spark, d):
    return T.smooth_in_time(S.frames(spark, d), "pitch_hz", 1.5).withColumn("smooth", F.round("smooth", 6))


@R("peak_boundaries", f"""{FR}, e AS (SELECT recording_id, frame_id, pitch_hz, row_number() OVER w AS i, lag(pitch_hz) OVER w AS a, lead(pitch_hz) OVER w AS b FROM frames WHERE voicing WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, frame_id)),
    p AS (SELECT * FROM e WHERE (pitch_hz > a AND pitch_hz > b) OR (pitch_hz < a AND pitch_hz < b)) SELECT frame_id, coalesce((lag(i) OVER w + i) // 2, 1) AS low, coalesce((lead(i) OVER w + i) // 2, i) AS high FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY i)""")
def peak_boundaries(spark, d):
    return T.extremum_bounds(O.voiced(S.frames(spark, d)), "pitch_hz")


@R("interval_text", f"{NO} SELECT recording_id, array_to_string(list(CAST(round_even(midi, 0) - round_even(b, 0) AS BIGINT) ORDER BY start_us, note_id), ' ') AS steps FROM (SELECT *, lag(midi) OVER ({N}) AS b FROM notes) WHERE b IS NOT NULL GROUP BY 1")
def interval_text(spark, d):
    n = S.notes(spark, d).withColumn("s", (E.half_even("midi") - E.half_even(F.lag("midi").over(S.note_order()))).cast("long")).where("s is not null")
    g = n.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("start_us", "note_id", "s"))).getField("s").alias("s"))
    return g.select("recording_id", F.array_join(F.transform("s", lambda x: x.cast("string")), " ").alias("steps"))


@R("duplicate_rows", "SELECT lang, count(*) AS n, count(DISTINCT md5(text)) AS texts, count(*) - count(DISTINCT md5(text)) AS repeated FROM documents GROUP BY 1")
def duplicate_rows(spark, d):
    g = S.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("texts"))
    return g.withColumn("repeated", F.col("n") - F.col("texts"))


@R("method_comparison", f"""{NO}, {PH}, {GRAD}, a AS (SELECT 'gap' AS method, count(*) AS n FROM (SELECT DISTINCT recording_id, phrase FROM ph)), b AS (SELECT 'gradient' AS method, count(*) AS n FROM g WHERE voicing AND abs(gradient) < 60), c AS (SELECT 'notes' AS method, count(*) AS n FROM notes) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def method_comparison(spark, d):
    f = O.gradient(O.midi_or_zero(S.frames(spark, d)), "midi").where("voicing and abs(gradient) < 60")
    parts = {"gap": P.phrase_bounds(phrases(spark, d)), "gradient": f, "notes": S.notes(spark, d)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("method"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@R("view_range", f"{NO} SELECT recording_id, CAST(12 * floor(round_even(median(midi), 0) / 12) - 12 AS BIGINT) AS low, CAST(12 * floor(round_even(median(midi), 0) / 12) + 24 AS BIGINT) AS high FROM notes GROUP BY 1")
def view_range(spark, d):
    at = 12 * F.floor(E.half_even(F.median("midi")) / 12)
    return S.notes(spark, d).groupBy("recording_id").agg((at - 12).alias("low"), (at + 24).alias("high"))


@R("joint_argmax", f"""{SC}, {SCORED}, pt AS (SELECT recording_id, pc AS tonic, n / sum(n) OVER (PARTITION BY recording_id) AS p FROM counts), m AS (SELECT recording_id, scale_id, tonic, match_mass / sum(match_mass) OVER (PARTITION BY recording_id, tonic) AS p FROM hyp),
    j AS (SELECT m.recording_id, scale_id, m.tonic, round(m.p * pt.p, 9) AS p FROM m JOIN pt ON pt.recording_id = m.recording_id AND pt.tonic = m.tonic) SELECT recording_id, arg_max(scale_id, (p, -scale_id, -tonic)) AS scale_id, arg_max(tonic, (p, -scale_id, -tonic)) AS tonic, round(max(p), 6) AS p FROM j GROUP BY 1""")
def joint_argmax(spark, d):
    """The scale and tonic of the largest product of the tonic's probability and the scale's given the tonic."""
    f = S.frames(spark, d)
    t = H.pitch_class_counts(f)
    t = t.select("recording_id", F.col("pc").alias("tonic"), (F.col("n") / F.sum("n").over(Window.partitionBy("recording_id"))).alias("pt"))
    m = scored(spark, d).select("recording_id", "scale_id", "tonic", (F.col("match_mass") / F.sum("match_mass").over(Window.partitionBy("recording_id", "tonic"))).alias("pm"))
    j = m.join(t, ["recording_id", "tonic"]).withColumn("p", F.round(F.col("pm") * F.col("pt"), 9))
    key = F.struct("p", -F.col("scale_id"), -F.col("tonic"))
    return j.groupBy("recording_id").agg(F.max_by("scale_id", key).alias("scale_id"), F.max_by("tonic", key).alias("tonic"), F.round(F.max("p"), 6).alias("p"))


@R("editor_ids", f"{NO}, {PH} SELECT recording_id, note_id, 'p' || lpad((phrase + 1)::VARCHAR, 4, '0') AS phrase, 'n' || lpad((row_number() OVER ({N}))::VARCHAR, 5, '0') AS name FROM ph")
def editor_ids(spark, d):
    name = F.concat(F.lit("n"), F.lpad(F.row_number().over(S.note_order()).cast("string"), 5, "0"))
    return phrases(spark, d).select("recording_id", "note_id", F.concat(F.lit("p"), F.lpad((F.col("phrase") + 1).cast("string"), 4, "0")).alias("phrase"), name.alias("name"))


@R("iqr_threshold", f"{NO}, x AS (SELECT recording_id, start - lag(\"end\") OVER ({N}) AS gap FROM notes) SELECT recording_id, round(median(gap) + 1.5 * greatest(quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25), 1e-9), 5) AS threshold FROM x WHERE gap IS NOT NULL GROUP BY 1")
def iqr_threshold(spark, d):
    g = S.notes(spark, d).withColumn("gap", F.col("start") - F.lag("end").over(S.note_order())).where("gap is not null")
    q = g.groupBy("recording_id").agg(F.percentile("gap", [0.25, 0.5, 0.75]).alias("q"))
    return q.select("recording_id", F.round(F.col("q")[1] + 1.5 * F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-9)), 5).alias("threshold"))


@R("note_names", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 10 WHEN 3 THEN NULL ELSE 11 END AS step, CASE event_id % 5 WHEN 0 THEN 48 WHEN 1 THEN 66 WHEN 2 THEN 82 ELSE NULL END AS midi FROM events")
def note_names(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("C3", "F#", "Bb5", "H2", "B")]), (F.col("event_id") % 5).cast("int") + 1)
    step = E.note_step(F.regexp_extract(name, "^([A-H][#b]?)", 1))
    octave = F.regexp_extract(name, r"(-?\d+)$", 1).try_cast("int")
    midi = F.when(step.isNotNull() & (F.col("event_id") % 5 < 3), F.when(octave.isNull(), 60 + step).otherwise((octave + 1) * 12 + step))
    return S.table(spark, d, "events").select("event_id", step.alias("step"), midi.alias("midi"))


@R("iso_times", "SELECT event_id, epoch_us(date_trunc('second', ts)) AS us, NULL::BIGINT AS bad FROM events")
def iso_times(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return S.table(spark, d, "events").select("event_id", F.unix_micros(F.try_to_timestamp(text)).alias("us"), F.unix_micros(F.try_to_timestamp(F.lit("not a time"))).alias("bad"))


@R("json_cells", """SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 'invalid' ELSE 'ok' END AS state, '{"value":' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE (event_id * 0.5::DOUBLE)::VARCHAR END || '}' AS json FROM events""")
def json_cells(spark, d):
    e = S.table(spark, d, "events")
    bad = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    ok = F.from_json(bad, "k long").getField("k").isNotNull()
    value = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("event_id") * 0.5)
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(ok, "ok").otherwise("invalid").alias("state"), F.to_json(F.struct(E.finite(value).alias("value")), {"ignoreNullFields": "false"}).alias("json"))


@R("label_template", "SELECT page_id, lower(regexp_extract(url, '([^/]*)$', 1)) AS filename, '' AS class, '' AS tonic, 'autodetect' AS source FROM pages")
def label_template(spark, d):
    return S.table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "([^/]*)$", 1)).alias("filename"), F.lit("").alias("class"), F.lit("").alias("tonic"), F.lit("autodetect").alias("source"))


@R("class_status", "SELECT d.lang AS class, count(*) AS recordings, count(l.doc_id) AS labelled, coalesce(sum(quality), 0)::BIGINT AS good, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def class_status(spark, d):
    j = S.table(spark, d, "documents").select("doc_id", "lang").join(S.table(spark, d, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    return j.groupBy(F.col("lang").alias("class")).agg(F.count("*").alias("recordings"), F.count("has").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.count(F.when(F.col("has").isNull(), 1)).alias("missing"))


@R("vector_features", "SELECT label, count(*) AS n, arg_max(vec_id, (embedding[1], vec_id)) AS best, round(avg(list_sum([x::DOUBLE FOR x IN embedding[1:12]])), 6) AS mean FROM embeddings GROUP BY 1")
def vector_features(spark, d):
    e = S.table(spark, d, "embeddings")
    total = F.aggregate(F.slice("embedding", 1, 12), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.max_by("vec_id", F.struct(F.element_at("embedding", 1), "vec_id")).alias("best"), F.round(F.avg(total), 6).alias("mean"))


@R("fixed_weight_fusion", "WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, round(0.5 * l_quantity / 50 + 2.0 * (1 - l_discount * 10) - 1.0 * l_tax, 9) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber, l_partkey) AS place FROM f")
def fixed_weight_fusion(spark, d):
    li = S.table(spark, d, "lineitem").withColumn("h", F.col("l_quantity") / 50).withColumn("m", 1 - F.col("l_discount") * 10)
    s = F.round("combined", 9)
    w = Window.partitionBy("l_orderkey").orderBy(s.desc(), "l_linenumber", "l_partkey")
    return K.fused(li, {"h": 0.5, "m": 2.0, "l_tax": -1.0}).select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("place"))


@R("calibrated_threshold", f"""{S.with_('frames')},
    v AS (SELECT track, confidence, count(*) AS c FROM frames WHERE voicing AND pitch_hz > 0 GROUP BY 1, 2),
    w AS (SELECT min(n) AS wanted FROM (SELECT sum(c) AS n FROM v GROUP BY track)),
    k AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY confidence DESC)::BIGINT AS kept FROM v)
    SELECT track, min(confidence) FILTER (kept <= wanted) AS threshold, coalesce(max(kept) FILTER (kept <= wanted), 0)::BIGINT AS kept
    FROM k, w GROUP BY 1""")
def calibrated_threshold(spark, d):
    """For each track the confidence that leaves no more voiced frames than the smallest track has."""
    return T.calibrated(O.voiced(S.frames(spark, d)), "track", "confidence")


@R("ranking_learner")
def ranking_learner(spark, d):
    """A scaled multilayer perceptron over candidate features, trained on part of the groups and judged on the rest."""
    li = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song"), "l_quantity", "l_discount", "l_tax", "l_extendedprice", (F.col("l_returnflag") == "R").cast("double").alias("label"))
    return K.learned_ranking(li, "song", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])


QUERIES, ORACLE = R.queries, R.oracle
