"""Scalar functions, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import exprs as E
from ..operators import frames as O
from ..sources import adapters as S
from .registry import Registry

R = Registry()
FR, NO, SC = S.with_("frames"), S.with_("notes"), S.with_("scales")
LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in E.LABELS) + "]"
FLOOR12 = "(({0}) % 12 + 12) % 12"


@R("hz_to_midi", f"{FR} SELECT frame_id, round(69 + 12 * log2(pitch_hz / 440), 6) AS midi, round(440 * pow(2, (round(69 + 12 * log2(pitch_hz / 440), 6) - 69) / 12), 4) AS hz FROM frames WHERE pitch_hz > 0")
def hz_to_midi(spark, d):
    f = S.frames(spark, d).where("pitch_hz > 0").select("frame_id", F.round(E.hz_to_midi("pitch_hz"), 6).alias("midi"))
    return f.withColumn("hz", F.round(E.midi_to_hz("midi"), 4))


@R("pitch_class", f"{NO} SELECT note_id, pc, round(((midi % 12) + 12) % 12 * 100, 5) AS cents FROM notes")
def pitch_class(spark, d):
    return S.notes(spark, d).select("note_id", "pc", F.round(E.cents("midi"), 5).alias("cents"))


@R("circular_distance", f"{NO} SELECT note_id, c, round(abs(((a - c * 100 + 600) % 1200 + 1200) % 1200 - 600), 5) AS distance FROM (SELECT note_id, ((midi % 12) + 12) % 12 * 100 AS a FROM notes), (SELECT unnest(range(12)) AS c)")
def circular_distance(spark, d):
    n = S.notes(spark, d).select("note_id", E.cents("midi").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("c"))
    return n.select("note_id", "c", F.round(E.circular_distance("a", F.col("c") * 100), 5).alias("distance"))


MARKS = "CASE WHEN o < 0 THEN repeat('''', CAST(-o AS INT)) WHEN o > 0 THEN repeat('·', CAST(o AS INT)) ELSE '' END"


@R("label_from_midi", f"""{NO},
    n AS (
        SELECT note_id, floor((midi - (recording_id % 12 + 48)) / 12) AS o,
            CAST({FLOOR12.format('round_even(midi - recording_id % 12, 0)')} AS INT) AS s
        FROM notes)
    SELECT note_id, ({LABEL_LIST})[s + 1] || {MARKS} AS label FROM n""")
def label_from_midi(spark, d):
    return S.notes(spark, d).select("note_id", E.label("midi", F.col("recording_id") % 12).alias("label"))


@R("label_from_midi_events", f"""{NO},
    n AS (SELECT note_id, midi - 57.5 AS away, round_even((midi - 57.5) / 12, 0) AS o FROM notes)
    SELECT note_id, ({LABEL_LIST})[CAST({FLOOR12.format('round_even(away, 0)')} AS INT) + 1] || {MARKS} AS label FROM n""")
def label_from_midi_events(spark, d):
    """Labels above a tonic between two notes."""
    return S.notes(spark, d).select("note_id", E.event_label("midi", F.lit(57.5)).alias("label"))


@R("lm_token", f"""{NO}, n AS (SELECT note_id, round_even(midi, 0) - 50 AS a FROM notes)
    SELECT note_id, ({LABEL_LIST})[CAST({FLOOR12.format('a')} AS INT) + 1] || CASE WHEN floor(a / 12) <= -1 THEN '''' WHEN floor(a / 12) >= 1 THEN '''''' ELSE '' END AS token FROM n""")
def lm_token(spark, d):
    return S.notes(spark, d).select("note_id", E.lm_token("midi", F.lit(50)).alias("token"))


@R("motif_token", f"SELECT event_id, replace(trim(event_type), '·', '') || ':' || (((event_id % 12 - user_id % 12) % 12 + 12) % 12) AS token FROM events")
def motif_token(spark, d):
    e = S.table(spark, d, "events")
    return e.select("event_id", E.motif_token("event_type", F.col("event_id") % 12, F.col("user_id") % 12).alias("token"))


@R("name_normalise", "SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (' || p_type || ') ' || p_brand), '\\(.*?\\)', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM part")
def name_normalise(spark, d):
    raw = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(") "), F.col("p_brand"))
    return S.table(spark, d, "part").select("p_partkey", E.normal_name(raw).alias("name"))


@R("clock_to_seconds", "SELECT event_id, (event_id % 3600) * 1.0::DOUBLE AS seconds, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id // 60 * 60 + event_id % 60 AS DOUBLE) END AS from_text FROM events")
def clock_to_seconds(spark, d):
    e = S.table(spark, d, "events").select("event_id")
    text = F.when(F.col("event_id") % 7 == 0, F.lit("1:x")).otherwise(F.concat_ws(":", F.floor(F.col("event_id") / 60).cast("string"), (F.col("event_id") % 60).cast("string")))
    return e.select("event_id", E.clock_seconds((F.col("event_id") % 3600).cast("string")).alias("seconds"), E.clock_seconds(text).alias("from_text"))


@R("alias_lookup", "SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'b' WHEN 'machinery' THEN 'm' END AS known, coalesce(CASE lower(c_mktsegment) WHEN 'building' THEN 'b' WHEN 'machinery' THEN 'm' END, lower(c_mktsegment)) AS kept FROM customer")
def alias_lookup(spark, d):
    known = F.try_element_at(F.create_map(F.lit("building"), F.lit("b"), F.lit("machinery"), F.lit("m")), F.lower("c_mktsegment"))
    return S.table(spark, d, "customer").select("c_custkey", known.alias("known"), F.coalesce(known, F.lower("c_mktsegment")).alias("kept"))


@R("html_subtitle", """SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), regexp_extract(html, '<p>([^<]*)<', 1)) AS raw_title,
        len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links, regexp_extract_all(html, 'href="([^"]*)"', 1)[1] AS first_link, len(regexp_extract_all(html, 'src="([^"]*)"', 1)) AS sources FROM pages""")
def html_subtitle(spark, d):
    """The title of a page, else its heading, else its first words; and what it links to and plays."""
    of = lambda name: F.regexp_extract_all("html", F.lit(name + '="([^"]*)"'), F.lit(1))
    found = lambda tag: F.nullif(F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1), F.lit(""))
    title = F.coalesce(found("title"), found("h1"), F.regexp_extract("html", "<p>([^<]*)<", 1))
    return S.table(spark, d, "pages").select("page_id", title.alias("raw_title"), F.size(of("href")).cast("long").alias("links"), F.try_element_at(of("href"), F.lit(1)).alias("first_link"), F.size(of("src")).cast("long").alias("sources"))


@R("file_names", r"""SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS safe,
    lower(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')) AS stem FROM pages""")
def file_names(spark, d):
    return S.table(spark, d, "pages").select("page_id", E.safe_name("url").alias("safe"), E.stem("url").alias("stem"))


@R("ids_and_tokens", "SELECT c_custkey, sha256(c_name) AS sha256, translate(rtrim(to_base64(encode(c_name)), '='), '+/', '-_') AS token FROM customer")
def ids_and_tokens(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", F.sha2(F.col("c_name"), 256).alias("sha256"), E.url_token("c_name").alias("token"))


@R("chromatic_snap", f"{NO} SELECT note_id, CASE WHEN midi - floor(midi) <= ceil(midi) - midi THEN floor(midi) ELSE ceil(midi) END AS snapped FROM notes")
def chromatic_snap(spark, d):
    return S.notes(spark, d).select("note_id", E.snap("midi").alias("snapped"))


MAJOR = [0, 2, 4, 5, 7, 9, 11]


@R("scale_snap", f"""{NO},
    c AS (
        SELECT note_id, midi, 57.5 + (floor(round_even(midi - 57.5, 0) / 12) + o) * 12 + s AS x
        FROM notes, (SELECT unnest({MAJOR}) AS s), (SELECT unnest([-1, 0, 1]) AS o)),
    b AS (SELECT note_id, arg_max(x, (-round(abs(x - midi), 9), x)) AS x, min(round(abs(x - midi), 9)) AS away FROM c GROUP BY 1)
    SELECT note_id, CASE WHEN away <= 1 THEN x END AS snapped FROM notes LEFT JOIN b USING (note_id)""")
def scale_snap(spark, d):
    """Notes in a major scale on a tonic between two notes."""
    return S.notes(spark, d).select("note_id", E.snap_in_scale("midi", F.lit(57.5), MAJOR).alias("snapped"))


@R("corrected_triple", f"""{NO}
    SELECT note_id, CAST({FLOOR12.format('round_even(midi - recording_id % 12, 0)')} AS INT) AS step, CAST(round_even(midi, 0) AS INT) AS rounded,
        ({LABEL_LIST})[CAST({FLOOR12.format('round_even(midi - recording_id % 12, 0)')} AS INT) + 1] AS label FROM notes""")
def corrected_triple(spark, d):
    """Of each note its step above the tonic, its rounded pitch and its label without octave marks."""
    step = E.floor_mod(E.half_even(F.col("midi") - F.col("recording_id") % 12), 12).cast("int")
    return S.notes(spark, d).select("note_id", step.alias("step"), E.half_even("midi").cast("int").alias("rounded"), E.label_of(step).alias("label"))


@R("label_to_midi", f"""{NO}, n AS (SELECT *, recording_id % 12 AS tonic, CAST({FLOOR12.format('round_even(midi - recording_id % 12, 0)')} AS INT) AS s FROM notes WHERE midi IS NOT NULL)
    SELECT note_id, tonic + CASE s WHEN 2 THEN 1 WHEN 4 THEN 3 WHEN 6 THEN 5 WHEN 9 THEN 8 WHEN 11 THEN 10 ELSE s END
        + 12 * (4 + CAST(floor((midi - (tonic + 48)) / 12) AS INT)) AS midi FROM n""")
def label_to_midi(spark, d):
    """Labels read back as pitches: a step in capitals is found as the one in small letters, which comes first."""
    n = S.notes(spark, d).where("midi is not null").withColumn("tonic", F.col("recording_id") % 12)
    return n.select("note_id", E.label_midi(E.label("midi", "tonic"), "tonic").cast("long").alias("midi"))


TONICS = ["C", "C#", "Bb", "F#3", "Eb5", "261.625565", "62", "201", "60.5", "H", "", "c", " G "]


@R("tonic_resolution", f"""SELECT event_id, ([60.0, 61, 70, 54, 75, 69 + 12 * log2(261.625565 / 440), 62, 201, 60.5, 60, 60, 60, 67])[event_id % {len(TONICS)} + 1]::DOUBLE AS midi,
    ([60.0, 61, 70, 60, 60, 60, 60, 60, 60, 60, 60, 60, 67])[event_id % {len(TONICS)} + 1]::DOUBLE AS named FROM events""")
def tonic_resolution(spark, d):
    """Tonics written as names, notes, pitches or frequencies; and as bare names only, 60 for all others."""
    text = F.element_at(F.array(*[F.lit(x) for x in TONICS]), (F.col("event_id") % len(TONICS)).cast("int") + 1)
    return S.table(spark, d, "events").select("event_id", E.resolve_tonic(text).alias("midi"), E.note_midi(text).alias("named"))


@R("alias_match", """WITH a AS (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN p_brand || ', ' || upper(p_name) WHEN 1 THEN replace(p_name, ' ', '') || ',x' ELSE p_type END AS aliases FROM part)
    SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 3 = 1 AND NOT contains(p_name, ' ') AS same, p_partkey % 3 < 2 AS squeezed,
        CASE WHEN p_partkey % 3 = 0 OR p_partkey % 3 = 1 AND NOT contains(p_name, ' ') THEN p_name ELSE trim(split_part(aliases, ',', 1)) END AS predicted FROM a""")
def alias_match(spark, d):
    way = F.col("p_partkey") % 3
    squeezed = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(",x"))
    aliases = F.when(way == 0, F.concat_ws(", ", "p_brand", F.upper("p_name"))).when(way == 1, squeezed).otherwise(F.col("p_type"))
    p = S.table(spark, d, "part").select("p_partkey", "p_name", aliases.alias("aliases"))
    return p.select("p_partkey", E.same_name("aliases", "p_name").alias("same"), E.same_name("aliases", "p_name", True).alias("squeezed"), E.predicted_name("aliases", "p_name").alias("predicted"))


@R("bool_and_number_cells", """SELECT event_id, CASE WHEN lower(event_type) IN ('1', 'yes', 'click') THEN TRUE ELSE FALSE END AS flag, coalesce(try_cast(event_type AS DOUBLE), 0.0) AS number FROM events""")
def bool_and_number_cells(spark, d):
    e = S.table(spark, d, "events")
    cell = F.when(F.col("event_type") == "click", " Yes ").otherwise(F.col("event_type"))
    return e.select("event_id", E.truth(cell).alias("flag"), F.coalesce(F.col("event_type").try_cast("double"), F.lit(0.0)).alias("number"))


@R("scale_intervals", f"""{SC}, s AS (SELECT scale_id, list(step ORDER BY step) AS st FROM scale_steps GROUP BY scale_id),
    g AS (SELECT scale_id, [(coalesce(st[i + 1], st[1]) - st[i] + 11) % 12 + 1 FOR i IN range(1, len(st) + 1)] AS iv FROM s)
    SELECT scale_id, array_to_string(iv, ',') AS intervals, list_min([list_concat(iv[k + 1:len(iv)], iv[1:k]) FOR k IN range(len(iv))])::VARCHAR AS canonical, len(iv) AS notes FROM g""")
def scale_intervals(spark, d):
    s = S.scales(spark, d).withColumn("iv", A.intervals("mask"))
    text = F.concat(F.lit("["), F.array_join(F.transform(A.canonical(F.col("iv")), lambda x: x.cast("string")), ", "), F.lit("]"))
    return s.select("scale_id", F.array_join(F.transform("iv", lambda x: x.cast("string")), ",").alias("intervals"), text.alias("canonical"), F.size("iv").cast("long").alias("notes"))


@R("vector_roll", "SELECT vec_id, embedding[1 + vec_id % 64] AS front, list_position(embedding, list_max(embedding)) - 1 AS best, round(list_sum([x::DOUBLE * x FOR x IN embedding]), 6) AS norm2 FROM embeddings")
def vector_roll(spark, d):
    e = S.table(spark, d, "embeddings").withColumn("r", A.roll("embedding", (F.col("vec_id") % 64).cast("int"), 64))
    best = F.array_position("embedding", F.array_max("embedding")) - 1
    return e.select("vec_id", F.element_at("r", 1).alias("front"), best.cast("int").alias("best"), F.round(A.dot("embedding", "embedding"), 6).alias("norm2"))


@R("voiced_frames", f"{FR} SELECT recording_id, frame_id, pitch_hz FROM frames WHERE pitch_hz > 0 AND voicing")
def voiced_frames(spark, d):
    return O.voiced(S.frames(spark, d)).select("recording_id", "frame_id", "pitch_hz")


@R("confidence_rethreshold", f"{FR} SELECT frame_id, voicing AND confidence >= 0.5 AS voicing FROM frames")
def confidence_rethreshold(spark, d):
    return O.rethreshold(S.frames(spark, d), 0.5).select("frame_id", "voicing")


@R("time_window_first_last", f"""{FR}, b AS (SELECT *, min(t) OVER (PARTITION BY recording_id) AS t0, max(t) OVER (PARTITION BY recording_id) AS t1 FROM frames)
    SELECT 'first' AS part, frame_id FROM b WHERE t < t0 + 10 UNION ALL SELECT 'last', frame_id FROM b WHERE t >= greatest(t0, t1 - 10)""")
def time_window_first_last(spark, d):
    f = S.frames(spark, d)
    return O.time_window(f, first=10).select(F.lit("first").alias("part"), "frame_id").unionAll(O.time_window(f, last=10).select(F.lit("last").alias("part"), "frame_id"))


@R("band_pass", f"{FR} SELECT frame_id, pitch_hz FROM frames WHERE voicing AND pitch_hz >= 20 AND pitch_hz < 80")
def band_pass(spark, d):
    return O.band(S.frames(spark, d), 20, 80).select("frame_id", "pitch_hz")


@R("octave_range", f"""{NO}, m AS (SELECT recording_id, median(midi) AS med FROM notes GROUP BY recording_id)
    SELECT note_id FROM notes JOIN m USING (recording_id) WHERE midi BETWEEN 12 * floor(round_even(med, 0) / 12) + 2 - 12 AND 12 * floor(round_even(med, 0) / 12) + 2 + 12""")
def octave_range(spark, d):
    n = S.notes(spark, d)
    m = n.groupBy("recording_id").agg(F.median("midi").alias("med"))
    centre = 12 * F.floor(E.half_even("med") / 12) + 2
    return n.join(m, "recording_id").where(F.col("midi").between(centre - 12, centre + 12)).select("note_id")


@R("note_overlap", f"{NO} SELECT recording_id, count(*) AS n FROM notes WHERE start < 34140 AND \"end\" > 34100 GROUP BY recording_id")
def note_overlap(spark, d):
    return S.notes(spark, d).where("start < 34140 and end > 34100").groupBy("recording_id").agg(F.count("*").alias("n"))


@R("energy_gate", f"{FR} SELECT track, count(*) AS n, round(avg(pitch_hz), 6) AS mean FROM frames WHERE voicing AND energy >= 0.4 GROUP BY track")
def energy_gate(spark, d):
    return O.voiced(S.frames(spark, d)).where("energy >= 0.4").groupBy("track").agg(F.count("*").alias("n"), F.round(F.avg("pitch_hz"), 6).alias("mean"))


STATUS = """status AS (
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_transcription' WHEN lang IS NULL OR lang = '' THEN 'missing_class' WHEN lang NOT IN ('en', 'fr') THEN 'filtered_out_class'
        WHEN source LIKE '%9' THEN 'filtered_out_gender' WHEN source LIKE '%7' THEN 'filtered_out_instrument' WHEN toxic = 1 THEN 'invalid' WHEN n_chars < 200 THEN 'too_short' ELSE 'processed' END AS status
    FROM documents d LEFT JOIN labels l USING (doc_id))"""


def statuses(spark, d):
    """Documents as rows of a label table, labels as their transcriptions: the first state that holds of each."""
    docs = S.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(S.table(spark, d, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    status = (
        F.when(F.col("has").isNull(), "missing_transcription").when(F.col("lang").isNull() | (F.col("lang") == ""), "missing_class")
        .when(~F.col("lang").isin("en", "fr"), "filtered_out_class").when(F.col("source").endswith("9"), "filtered_out_gender").when(F.col("source").endswith("7"), "filtered_out_instrument")
        .when(F.col("toxic") == 1, "invalid").when(F.col("n_chars") < 200, "too_short").otherwise("processed")
    )
    return docs.select("doc_id", status.alias("status"))


@R("status_rows", f"WITH {STATUS} SELECT * FROM status")
def status_rows(spark, d):
    return statuses(spark, d)


@R("status_case", f"WITH {STATUS} SELECT status, count(*) AS n FROM status GROUP BY 1")
def status_case(spark, d):
    return statuses(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@R("library_filter", "SELECT count(*) AS n, sum(o_totalprice > 100000)::BIGINT AS large FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND lower(c_name) LIKE '%00012%'")
def library_filter(spark, d):
    c = S.table(spark, d, "customer").where(F.lower("c_name").contains("00012"))
    o = S.table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("n"), F.sum((F.col("o_totalprice") > 100000).cast("long")).alias("large"))


QUERIES, ORACLE = R.queries, R.oracle
