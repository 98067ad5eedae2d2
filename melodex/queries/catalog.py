"""Catalog, sets, top-k, and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import joins as J
from ..sources import adapters as S
from .registry import Registry

R = Registry()


@R("library_counts", "SELECT " + ", ".join(f"count(*) FILTER (o_orderstatus = '{x}') AS {x}" for x in "FOPX") + " FROM orders")
def library_counts(spark, d):
    return C.counts_of(S.table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@R("library_rows", """SELECT c_custkey, count(o_orderkey) AS variants, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest, max(o_orderdate) AS activity FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def library_rows(spark, d):
    o = S.table(spark, d, "orders")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("variants"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.max("o_orderdate").alias("activity"))
    return S.table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left").withColumn("variants", F.coalesce("variants", F.lit(0)))


@R("report_freshness", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality IS NULL THEN 'unknown' WHEN md5(d.source) = md5(CASE WHEN l.quality = 1 THEN d.source ELSE d.lang END) THEN 'current' ELSE 'stale' END AS status
    FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def report_freshness(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "lang", "source").join(S.table(spark, d, "labels").withColumn("path", F.lit("report")), "doc_id", "left")
    made = F.when(F.col("quality").isNotNull(), F.md5(F.when(F.col("quality") == 1, F.col("source")).otherwise(F.col("lang")).cast("binary")))
    return docs.groupBy(C.freshness(F.col("path"), made, F.md5(F.col("source").cast("binary"))).alias("status")).agg(F.count("*").alias("n"))


@R("next_version", "SELECT p_type, coalesce(max(CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT)), 0) + 1 AS next FROM part GROUP BY 1")
def next_version(spark, d):
    return C.next_version(S.table(spark, d, "part"), "p_type", "p_brand")


@R("edit_manifest_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def edit_manifest_latest(spark, d):
    return C.latest(S.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


NOTES = "n AS (SELECT l_orderkey AS song, l_partkey % 5 AS note_id, l_linenumber * 1000000000000 + l_partkey AS pos, l_quantity AS start, l_quantity + l_tax * 10 - 0.3 AS \"end\" FROM lineitem), u AS (SELECT song, note_id, pos, least(start, \"end\") AS start, greatest(greatest(start, \"end\"), least(start, \"end\") + 0.001) AS \"end\" FROM (SELECT *, row_number() OVER (PARTITION BY song, note_id ORDER BY pos, start, \"end\") AS r FROM n) WHERE r = 1)"


def edits(spark, d):
    li = S.table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("song"), (F.col("l_partkey") % 5).alias("note_id"), (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey")).alias("pos"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_tax") * 10 - 0.3).alias("end"))


@R("edit_notes", f"WITH {NOTES} SELECT song, note_id, round(start, 6) AS start, round(\"end\", 6) AS \"end\" FROM u")
def edit_notes(spark, d):
    return C.normal_notes(edits(spark, d)).select("song", "note_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@R("edit_phrases", f"""WITH {NOTES}, p AS (SELECT o_orderkey AS song, 'p' || (k::VARCHAR) AS phrase, k FROM orders, (SELECT unnest([0, 1]) AS k)), x AS (SELECT song, phrase, unnest(CASE WHEN k = 0 THEN [0, 1, 2] ELSE [2, 3] END) AS note_id FROM p),
    f AS (SELECT song, note_id, min(phrase) AS phrase FROM x GROUP BY 1, 2) SELECT song, note_id, coalesce(phrase, 'auto-' || note_id) AS phrase, row_number() OVER (PARTITION BY song ORDER BY start, "end", note_id) AS place FROM u LEFT JOIN f USING (song, note_id)""")
def edit_phrases(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("song"))
    p = o.select("song", F.lit("p0").alias("phrase"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("note_ids")).unionAll(o.select("song", F.lit("p1"), F.array(F.lit(2), F.lit(3))))
    rows = C.owned(C.normal_notes(edits(spark, d)), p)
    return rows.select("song", "note_id", "phrase", F.row_number().over(Window.partitionBy("song").orderBy("start", "end", "note_id")).alias("place"))


@R("source_fallback", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def source_fallback(spark, d):
    e = S.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    e = e.withColumn("p", F.struct(F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2), "event_type"))
    return C.resolve(e, ["user_id"], "p").select("user_id", "event_type", "n")


@R("topk_per_recording", "SELECT recording_id, frame_id, place FROM (SELECT user_id AS recording_id, event_id AS frame_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 5")
def topk_per_recording(spark, d):
    w = Window.partitionBy("recording_id").orderBy(F.col("pitch_hz").desc(), "frame_id")
    return S.frames(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 5").select("recording_id", "frame_id", "place")


@R("gate_or_top20", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) FILTER (o_totalprice > 200000) OVER (PARTITION BY o_custkey) AS pos FROM orders) WHERE CASE WHEN pos > 0 THEN o_totalprice > 200000 ELSE r <= 20 END")
def gate_or_top20(spark, d):
    w = Window.partitionBy("o_custkey")
    o = S.table(spark, d, "orders").withColumn("pos", F.sum((F.col("o_totalprice") > 200000).cast("int")).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("o_totalprice").desc(), "o_orderkey")))
    return o.where(F.when(F.col("pos") > 0, F.col("o_totalprice") > 200000).otherwise(F.col("r") <= 20)).select("o_custkey", "o_orderkey")


@R("missing_recordings", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def missing_recordings(spark, d):
    return S.table(spark, d, "customer").select("c_custkey").join(S.table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@R("distinct_first_wins", "SELECT name, p_partkey FROM (SELECT lower(p_name) AS name, p_partkey, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def distinct_first_wins(spark, d):
    p = S.table(spark, d, "part").select(F.lower("p_name").alias("name"), "p_partkey")
    return J.first_wins(p, "name", ["p_partkey"])


@R("tonic_set_operations", """WITH e AS (SELECT user_id, list_sort(list(DISTINCT event_id % 12)) AS a, list_sort(list(DISTINCT CAST(floor(value) AS BIGINT) % 12)) AS b FROM events GROUP BY 1)
    SELECT user_id, array_to_string([x FOR x IN a IF list_contains(b, x)], ',') AS both, array_to_string([x FOR x IN a IF NOT list_contains(b, x)], ',') AS only_first, len(list_distinct(list_concat(a, b))) AS together FROM e""")
def tonic_set_operations(spark, d):
    e = S.table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.col("event_id") % 12)).alias("a"), F.sort_array(F.collect_set(F.floor("value") % 12)).alias("b"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return e.select("user_id", text(F.array_intersect("a", "b")).alias("both"), text(F.array_except("a", "b")).alias("only_first"), F.size(F.array_union("a", "b")).cast("long").alias("together"))


@R("union_all_songs", "SELECT 'customer' AS kind, c_custkey AS k, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def union_all_songs(spark, d):
    c, s = S.table(spark, d, "customer"), S.table(spark, d, "supplier")
    return c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance")).unionByName(s.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")))


@R("nation_cube", "SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)")
def nation_cube(spark, d):
    c = S.table(spark, d, "customer").join(S.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@R("adaptive_bins", """WITH s AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), b AS (SELECT *, CAST(floor(greatest(12, least(60, 2 * sqrt(n)))) AS INT) AS bins FROM s)
    SELECT event_type, CAST(least(floor((value - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM events JOIN b USING (event_type) GROUP BY 1, 2""")
def adaptive_bins(spark, d):
    e = S.table(spark, d, "events")
    s = e.groupBy("event_type").agg(F.count("*").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    s = s.withColumn("bins", F.floor(F.greatest(F.lit(12.0), F.least(F.lit(60.0), 2 * F.sqrt("m")))))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))), F.col("bins") - 1)
    return e.join(F.broadcast(s), "event_type").groupBy("event_type", at.alias("bin")).agg(F.count("*").alias("n"))


@R("negative_sample", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS songs FROM lineitem WHERE l_returnflag <> 'R' AND (l_partkey * 2654435761 + l_orderkey * 40503 + l_linenumber) % 200 = 0")
def negative_sample(spark, d):
    """A reproducible share of the incorrect rows, picked by their keys."""
    pick = (F.col("l_partkey") * 2654435761 + F.col("l_orderkey") * 40503 + F.col("l_linenumber")) % 200 == 0
    return S.table(spark, d, "lineitem").where((F.col("l_returnflag") != "R") & pick).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("songs"))


@R("rounded_sink", f"""{S.with_('notes')} SELECT note_id, round(start, 3) AS start, round("end", 3) AS "end", round(midi, 2) AS pitch_midi, pc AS pitch_class, round(energy, 4) AS energy FROM notes""")
def rounded_sink(spark, d):
    from ..sources.files import rounded_notes

    return rounded_notes(S.notes(spark, d)).select("note_id", "start", "end", "pitch_midi", "pitch_class", "energy")


@R("conversation_turns", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS mean_chars, count(*) FILTER (turn = 0) AS first FROM conversations GROUP BY 1")
def conversation_turns(spark, d):
    c = S.table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.count(F.when(F.col("turn") == 0, 1)).alias("first"))


@R("ornaments", f"{S.with_('notes')} SELECT note_id, \"end\" - start < 0.15 AS ornament FROM notes")
def ornaments(spark, d):
    return S.notes(spark, d).select("note_id", (F.col("end") - F.col("start") < 0.15).alias("ornament"))


EDITS = """log AS (
    SELECT recording_id, note_id, CASE note_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'move' ELSE 'add' END AS op, note_id AS seq, start + 0.01 AS start, "end" + 0.02 AS "end", midi FROM notes WHERE note_id % 5 < 3
    UNION ALL SELECT recording_id, note_id, 'move', note_id + 1000000, start - 0.01, "end", midi FROM notes WHERE note_id % 10 = 0),
last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY recording_id, note_id ORDER BY seq DESC) = 1)"""


@R("edits_replayed", f"""{S.with_('notes')}, {EDITS}, kept AS (SELECT * FROM notes WHERE note_id % 5 <> 2),
    m AS (SELECT coalesce(k.recording_id, l.recording_id) AS recording_id, coalesce(k.note_id, l.note_id) AS note_id, op, k.start AS ks, k."end" AS ke, l.start AS ls, l."end" AS le, k.midi AS km, l.midi AS lm
          FROM kept k FULL JOIN last l ON l.recording_id = k.recording_id AND l.note_id = k.note_id)
    SELECT recording_id, note_id, round(CASE WHEN op IS NULL THEN ks ELSE ls END, 6) AS start, round(CASE WHEN op IS NULL THEN ke ELSE le END, 6) AS "end", round(coalesce(km, lm), 6) AS midi
    FROM m WHERE op IS NULL OR op = 'move' AND ks IS NOT NULL OR op = 'add'""")
def edits_replayed(spark, d):
    """A log of deletions, moves and additions replayed over notes: of several edits of a note the last counts."""
    n = S.notes(spark, d).select("recording_id", "note_id", "start", "end", "midi")
    way = F.col("note_id") % 5
    op = F.when(way == 0, "delete").when(way == 1, "move").otherwise("add")
    first = n.where(way < 3).select("recording_id", "note_id", op.alias("op"), F.col("note_id").alias("seq"), (F.col("start") + 0.01).alias("start"), (F.col("end") + 0.02).alias("end"), "midi")
    more = n.where("note_id % 10 = 0").select("recording_id", "note_id", F.lit("move").alias("op"), (F.col("note_id") + 1000000).alias("seq"), (F.col("start") - 0.01).alias("start"), "end", "midi")
    out = C.replay(n.where(way != 2), first.unionByName(more))
    return out.select("recording_id", "note_id", *[F.round(c, 6).alias(c) for c in ("start", "end", "midi")])


QUERIES, ORACLE = R.queries, R.oracle
