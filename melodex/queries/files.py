"""Tables written as files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ngrams as G
from ..sources import adapters as S
from ..sources import files as C
from .language import CNT, MOT, grams, motifs
from .registry import Registry
from .scoring import SC, SCORED, scored
from .sequences import NO

R = Registry()
#: Notes as cells: some pitches are no number, some starts are missing, some ends come first, some labels are empty.
CELLS = f"""{NO},
cells AS (
    SELECT recording_id, note_id, start_us, row_number() OVER (PARTITION BY recording_id ORDER BY start_us, note_id) - 1 AS row,
        CASE WHEN note_id % 13 = 0 THEN NULL WHEN note_id % 17 = 0 THEN round("end", 3) ELSE round(start, 3) END AS s,
        CASE WHEN note_id % 17 = 0 THEN round(start, 3) ELSE round("end", 3) END AS e, CASE WHEN note_id % 11 = 0 THEN NULL ELSE round(midi, 2) END AS m,
        CASE WHEN note_id % 19 = 0 THEN NULL ELSE track || '·' END AS label, CASE WHEN note_id % 7 = 0 THEN NULL ELSE pc END AS pc FROM notes)"""


def written(spark, d):
    """The notes as text tables, each of many recordings, which its column ``stem`` names."""
    n, i = S.notes(spark, d), F.col("note_id")
    start, end = F.round("start", 3).cast("string"), F.round("end", 3).cast("string")
    cells = n.select(
        F.concat(F.lit("Rec "), F.col("recording_id").cast("string")).alias("stem"), "start_us", "note_id",
        F.when(i % 13 == 0, "").when(i % 17 == 0, end).otherwise(start).alias("Start Time"), F.when(i % 17 == 0, start).otherwise(end).alias("end"),
        F.when(i % 11 == 0, "n/a").otherwise(F.coalesce(F.round("midi", 2).cast("string"), F.lit("none"))).alias("pitch_midi"),
        F.when(i % 19 == 0, " ").otherwise(F.concat("track", F.lit("·"))).alias("Sargam"), F.when(i % 7 == 0, "").otherwise(F.col("pc").cast("string")).alias("pitch_class"),
    )
    path = C.shared_path(spark, f"transcriptions-{uuid.uuid4().hex}")
    C.write_csv(cells, path, ["stem"], ["start_us", "note_id"])
    return path


def recording(c="stem"):
    return F.regexp_extract(c, r"^Rec (\d+)$", 1).cast("long")


@R("transcriptions_read", f"""{CELLS} SELECT recording_id, row, s AS start, e AS "end", m AS midi, round(440 * pow(2, (m - 69) / 12), 4) AS hz, coalesce(label, '') AS label
    FROM cells WHERE s IS NOT NULL AND m IS NOT NULL""")
def transcriptions_read(spark, d):
    t = C.read_transcriptions(spark, written(spark, d), "stem")
    return t.select(recording().alias("recording_id"), F.col("row").cast("long").alias("row"), "start", "end", "midi", F.round("hz", 4).alias("hz"), F.coalesce("label", F.lit("")).alias("label"))


@R("motif_notes_read", f"""{CELLS}, t AS (
        SELECT recording_id, row, replace(label, '·', '') AS label, coalesce(pc, CAST((round_even(m, 0) % 12 + 12) % 12 AS INT)) AS pc, coalesce(s, row) AS a, e AS b FROM cells)
    SELECT recording_id, row, least(a, b) AS start, greatest(a, b) AS "end", label || ':' || ((pc - 3 + 12) % 12) AS token FROM t WHERE label IS NOT NULL AND pc IS NOT NULL""")
def motif_notes_read(spark, d):
    t = C.read_motif_notes(spark, written(spark, d), 3, "stem")
    return t.select(recording().alias("recording_id"), F.col("row").cast("long").alias("row"), "start", "end", "token")


PATHS = """paths AS (
    SELECT '/results/' || event_type || '/Rec ' || user_id || CASE event_id % 4 WHEN 0 THEN '/transcribed_notes.csv' WHEN 1 THEN '/transcription_edits/transcription_edited.csv'
        WHEN 2 THEN '/transcription_edited.csv' ELSE '/x_transcribed_notes.csv' END AS path FROM events)"""


def paths(spark, d):
    way = F.col("event_id") % 4
    name = F.when(way == 0, "/transcribed_notes.csv").when(way == 1, "/transcription_edits/transcription_edited.csv").when(way == 2, "/transcription_edited.csv").otherwise("/x_transcribed_notes.csv")
    return S.table(spark, d, "events").select(F.concat(F.lit("/results/"), "event_type", F.lit("/Rec "), F.col("user_id").cast("string"), name).alias("path"))


@R("discovered_files", f"""WITH {PATHS}, p AS (SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(path, '/[^/]*$', '') AS dir FROM paths),
    f AS (SELECT *, CASE WHEN name = 'transcription_edited.csv' AND dir LIKE '%/transcription_edits' THEN regexp_replace(dir, '/[^/]*$', '') ELSE dir END AS folder FROM p)
    SELECT folder, lower(regexp_extract(folder, '([^/]*)$', 1)) AS stem, max(path) FILTER (name = 'transcribed_notes.csv') AS original, max(path) FILTER (name = 'transcription_edited.csv') AS edited
    FROM f WHERE name IN ('transcribed_notes.csv', 'transcription_edited.csv') GROUP BY 1, 2""")
def discovered_files(spark, d):
    return C.discover(paths(spark, d))


SUFFIX = "['.wav', '.MP3', '.txt', '.flac']"
WALK = f"""walk AS (
    SELECT '/audio' || repeat('/sub', (event_id % 5)::INT) || '/' || CASE WHEN event_id % 7 = 0 THEN '.' ELSE '' END || 'r' || event_id || ({SUFFIX})[event_id % 4 + 1] AS path, event_id FROM events)"""


@R("audio_walk", f"WITH {WALK} SELECT path FROM walk WHERE event_id % 5 < 3 AND event_id % 7 <> 0 AND event_id % 4 <> 2")
def audio_walk(spark, d):
    i = F.col("event_id")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".wav", ".MP3", ".txt", ".flac")]), (i % 4).cast("int") + 1)
    hidden = F.when(i % 7 == 0, ".").otherwise("")
    path = F.concat(F.lit("/audio"), F.repeat(F.lit("/sub"), (i % 5).cast("int")), F.lit("/"), hidden, F.lit("r"), i.cast("string"), suffix)
    return C.audio_files(S.table(spark, d, "events").select(path.alias("path")), "/audio")


@R("cache_paths", """SELECT event_id, '/c/' || user_id || '/vocals_pitch_data' || CASE event_type WHEN 'view' THEN '' ELSE '_' || event_type END || '.csv' AS path FROM events""")
def cache_paths(spark, d):
    path = C.cache_path(F.concat(F.lit("/c/"), F.col("user_id").cast("string")), F.lit("vocals"), F.col("event_type"), "view")
    return S.table(spark, d, "events").select("event_id", path.alias("path"))


@R("corpus_read", f"""{SC}, {SCORED}, r AS (
        SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round(fit, 6) DESC, scale_id, tonic) AS rank FROM fitted QUALIFY rank <= 5)
    SELECT 'rec' || recording_id AS stem, scale_id, tonic, round(fit, 4) AS fit, rank = 1 AS correct FROM r""")
def corpus_read(spark, d):
    """The best candidates of every recording, written as tables, each of many recordings, and read back as one data set for learning."""
    from ..operators.scoring import best_per_recording

    order = [F.round("fit", 6).desc(), F.col("scale_id"), F.col("tonic")]
    best = best_per_recording(scored(spark, d), order, 5)
    rows = best.select(F.concat(F.lit("rec"), F.col("recording_id").cast("string")).alias("stem"), "scale_id", "tonic", F.round("fit", 4).alias("fit"), "rank")
    path = C.shared_path(spark, f"candidates-{uuid.uuid4().hex}")
    C.write_csv(rows, path, ["stem"], ["rank"])
    read = C.read_corpus(spark, path)
    return read.select("stem", F.col("scale_id").cast("int").alias("scale_id"), F.col("tonic").cast("int").alias("tonic"), F.col("fit").cast("double").alias("fit"), (F.col("rank").cast("int") == 1).alias("correct"))


@R("features_read", "SELECT o_orderkey AS song, l_linenumber AS line, l_partkey AS part, l_quantity::DOUBLE AS mass, l_returnflag = 'R' AS correct FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def features_read(spark, d):
    """Feature files, an object for each order with its candidates, written as JSON and read back a candidate a row."""
    li = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song"), F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("double").alias("mass"), (F.col("l_returnflag") == "R").alias("correct")).alias("c"))
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("song"))
    path = C.shared_path(spark, f"features-{uuid.uuid4().hex}")
    li.join(o, "song").groupBy("song").agg(F.collect_list("c").alias("candidates")).write.json(path)
    schema = "song long, candidates array<struct<line: int, part: long, mass: double, correct: boolean>>"
    rows = spark.read.schema(schema).json(path)
    return rows.select("song", F.inline("candidates"))


@R("model_json", f"{CNT} SELECT class, n, ngram, cnt FROM cnt")
def model_json(spark, d):
    """A class language model as JSON, an object of counts for each class and order with keys joined by |, and read again."""
    counted = G.counts(grams(spark, d), ["class"])
    entries = F.map_from_entries(F.collect_list(F.struct("ngram", "cnt")))
    path = C.shared_path(spark, f"model-{uuid.uuid4().hex}")
    counted.groupBy("class", "n").agg(entries.alias("counts")).write.json(path)
    read = spark.read.schema("class long, n int, counts map<string, long>").json(path)
    return read.select("class", "n", F.explode("counts").alias("ngram", "cnt"))


@R("motif_index_json", f"""{MOT}, r AS (
        SELECT class, ngram, support, round(weight, 6) AS weight, row_number() OVER (PARTITION BY class ORDER BY support DESC, round(weight, 9) DESC, occurrences DESC, length(ngram) DESC, ngram) AS place FROM motifs),
    k AS (SELECT count(DISTINCT class) AS classes, count(*) AS motifs FROM r)
    SELECT '1' AS version, 3 AS min_len, 4 AS max_len, 2 AS min_support, classes AS kept_classes, motifs AS kept_motifs, r.class AS class, ngram, support, weight, place FROM r, k WHERE place <= 20""")
def motif_index_json(spark, d):
    """The motif index as one nested object, parameters, totals and the best motifs of each class, written and read again."""
    from pyspark.sql import Window

    m = motifs(spark, d)
    w = Window.partitionBy("class").orderBy(F.col("support").desc(), F.round("weight", 9).desc(), F.col("occurrences").desc(), F.length("ngram").desc(), "ngram")
    best = m.withColumn("place", F.row_number().over(w)).where("place <= 20").select("class", F.struct("place", "ngram", "support", F.round("weight", 6).alias("weight")).alias("m"))
    classes = best.groupBy("class").agg(F.sort_array(F.collect_list("m")).alias("motifs"))
    totals = m.agg(F.count_distinct("class").alias("kept_classes"), F.count("*").alias("kept_motifs"))
    params = F.struct(F.lit(3).alias("min_len"), F.lit(4).alias("max_len"), F.lit(2).alias("min_support"))
    whole = classes.agg(F.collect_list(F.struct("class", "motifs")).alias("classes")).crossJoin(totals)
    whole = whole.select(F.lit("1").alias("version"), params.alias("params"), F.struct("kept_classes", "kept_motifs").alias("totals"), "classes")
    path = C.shared_path(spark, f"motifs-{uuid.uuid4().hex}")
    whole.write.json(path)
    rows = spark.read.schema(whole.schema).json(path).select("version", "params.*", "totals.*", F.explode("classes").alias("c"))
    rows = rows.select("version", "min_len", "max_len", "min_support", "kept_classes", "kept_motifs", "c.class", F.explode("c.motifs").alias("m"))
    return rows.select("version", "min_len", "max_len", "min_support", "kept_classes", "kept_motifs", "class", "m.ngram", "m.support", "m.weight", "m.place")


QUERIES, ORACLE = R.queries, R.oracle
