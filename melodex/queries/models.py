"""Stored models, segments, spellings in stages, and the learner that leaves each recording out."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import leave_one_out as L
from ..operators import model_store as M
from ..operators import names as N
from ..operators import ngrams as G
from ..operators import phrases as P
from ..operators import reports as T
from ..operators import segments as W
from ..operators.scoring import best_per_recording
from ..sources import adapters as S
from ..sources import files as C
from .language import ADD, LAMBDAS, PROB, TOK, scores
from .language import grams as class_grams
from .language import paths
from .registry import Registry
from .scoring import SC, SCORED, scored
from .sequences import NO, PH, phrases

R = Registry()
LEAST_TOKENS = 24
RECURSIVE = "WITH RECURSIVE"


# Segments.

SEGMENTS = f"""sizes AS (
        SELECT recording_id, phrase, count(*) + 1 AS tokens, min(start) AS start, max("end") AS "end" FROM ph GROUP BY 1, 2),
    through AS (SELECT *, sum(tokens) OVER (PARTITION BY recording_id ORDER BY phrase) AS through FROM sizes),
    reach AS (
        SELECT a.recording_id, a.phrase,
            coalesce(min(b.phrase) FILTER (b.through >= a.through - a.tokens + {LEAST_TOKENS}), max(b.phrase)) + 1 AS stop
        FROM through a JOIN through b ON b.recording_id = a.recording_id AND b.phrase >= a.phrase GROUP BY 1, 2),
    seg AS (
        SELECT recording_id, 0::BIGINT AS segment, phrase AS first, stop FROM reach WHERE phrase = 0
        UNION ALL
        SELECT r.recording_id, s.segment + 1, r.phrase, r.stop
        FROM seg s JOIN reach r ON r.recording_id = s.recording_id AND r.phrase = s.first + greatest(1, (s.stop - s.first) // 2))"""


def phrase_sizes(spark, d):
    """A phrase's tokens: its notes and its beginning."""
    return P.phrase_bounds(phrases(spark, d)).select("recording_id", "phrase", (F.col("notes") + 1).alias("tokens"), "start", "end")


@R(
    "segment_windows",
    f"""{NO.replace("WITH", RECURSIVE, 1)}, {PH}, {SEGMENTS}
    SELECT s.recording_id, segment, first, stop, sum(tokens)::BIGINT AS tokens, round(min(start), 6) AS start, round(max("end"), 6) AS "end"
    FROM seg s JOIN sizes z ON z.recording_id = s.recording_id AND z.phrase >= first AND z.phrase < stop GROUP BY 1, 2, 3, 4""",
)
def segment_windows(spark, d):
    """Overlapping runs of phrases with at least 24 tokens, stepping by half their phrases, and their times."""
    sizes = phrase_sizes(spark, d)
    found = W.segments(sizes, LEAST_TOKENS)
    first = sizes.select("recording_id", F.col("phrase").alias("first"), F.round("start", 6).alias("start"))
    last = sizes.select("recording_id", (F.col("phrase") + 1).alias("stop"), F.round("end", 6).alias("end"))
    return found.join(first, ["recording_id", "first"]).join(last, ["recording_id", "stop"]).select("recording_id", "segment", "first", "stop", "tokens", "start", "end")


@R(
    "segment_classes",
    PROB.replace("LOO", "0").replace("WITH", RECURSIVE, 1)
    + f""",
    ew AS (
        SELECT n, ngram, 1 / (1 - sum(p * log2(p))) AS weight
        FROM (SELECT n, ngram, cnt / sum(cnt) OVER (PARTITION BY n, ngram) AS p FROM cnt) GROUP BY 1, 2),
    bw AS (SELECT recording_id, seq, pos, arg_max(weight, n) AS weight FROM gr JOIN ew USING (n, ngram) WHERE pos > 1 GROUP BY 1, 2, 3),
    per AS (
        SELECT recording_id, seq AS phrase, class, sum(weight * ln(p)) AS total, sum(weight) AS weight
        FROM pos JOIN bw USING (recording_id, seq, pos) GROUP BY 1, 2, 3),
    {SEGMENTS.replace("FROM ph GROUP", "FROM (SELECT *, seq AS phrase FROM ph) GROUP")},
    ranked AS (
        SELECT s.recording_id, segment, class, round(sum(total) / sum(weight), 6) AS score
        FROM seg s JOIN per p ON p.recording_id = s.recording_id AND p.phrase >= first AND p.phrase < stop GROUP BY 1, 2, 3)
    SELECT *, row_number() OVER (PARTITION BY recording_id, segment ORDER BY score DESC, class) AS place FROM ranked QUALIFY place <= 3""",
)
def segment_classes(spark, d):
    """The three likeliest classes of each segment, from sums of its phrases."""
    g = class_grams(spark, d)
    m = M.train(g, 3, ADD, LAMBDAS)
    p = paths(spark, d)
    scored = G.score_paths(p, m.counts, m.classes, m.vocabulary, m.order, list(m.lambdas), m.k, m.contexts)
    per = G.score_recordings(p, scored, weights=G.path_weights(p, M.entropy_weights(m)), by=("recording_id", "seq")).withColumnRenamed("seq", "phrase")
    sums = W.over_segments(W.segments(phrase_sizes(spark, d), LEAST_TOKENS), per, ["class"], ["total", "weight"])
    w = Window.partitionBy("recording_id", "segment").orderBy(F.col("score").desc(), "class")
    rows = sums.select("recording_id", "segment", "class", F.round(F.col("total") / F.col("weight"), 6).alias("score"))
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 3")


# Stored models: classes of very different sizes, by the whole root of a recording's id.

CLASS = "CAST(floor(sqrt(recording_id)) AS BIGINT) AS class"
ROOTS = PROB.replace("LOO", "0").replace("recording_id % 4 AS class", CLASS)
KEPT = "class IN (SELECT class FROM gr GROUP BY 1 HAVING count(DISTINCT recording_id) >= 3)"
STORED = ROOTS.replace("FROM cnt WHERE n = 1 GROUP BY 1), v AS", f"FROM cnt WHERE n = 1 AND {KEPT} GROUP BY 1), v AS")


def stored(spark, d, halves=False):
    """A model of classes with at least three recordings, written as a version and read back; ``halves``: after one of every
    other recording."""
    g = class_grams(spark, d).withColumn("class", F.floor(F.sqrt("recording_id")))
    path = C.shared_path(spark, f"model-{uuid.uuid4().hex}")
    if halves:
        M.save(M.train(g.where("recording_id % 2 = 0"), 2, 1.0, [0.4, 0.6]), path)
    M.save(M.train(g, 3, ADD, LAMBDAS, 3), path)
    return g, path


@R("stored_model_score", STORED + " SELECT recording_id, class, positions, round(logprob / positions, 6) AS mean FROM sc")
def stored_model_score(spark, d):
    """All recordings scored by the last version of a stored model, nothing counted anew."""
    path = stored(spark, d, halves=True)[1]
    s = M.score_recordings(M.load(spark, path), paths(spark, d))
    return s.select("recording_id", "class", "positions", F.round(F.col("logprob") / F.col("positions"), 6).alias("mean"))


@R(
    "stored_model_counts",
    f"""{STORED}
    SELECT 'count' AS kind, class, n, ngram AS key, cnt AS times FROM cnt WHERE {KEPT}
    UNION ALL SELECT 'context', class, n, context, ctx FROM ctx WHERE {KEPT}
    UNION ALL SELECT 'tokens', class, 1, '', tokens FROM tot
    UNION ALL SELECT 'recordings', class, 1, '', count(DISTINCT recording_id) FROM gr WHERE {KEPT} GROUP BY class
    UNION ALL SELECT 'vocabulary', -1, 3, '0.2|0.3|0.5', v FROM v""",
)
def stored_model_counts(spark, d):
    """What a stored model holds, read back: counts, contexts, sizes of classes, vocabulary and weights."""
    m = M.load(spark, stored(spark, d)[1], 1)
    row = lambda kind, rows, key, times, n="n": rows.select(F.lit(kind).alias("kind"), "class", F.expr(n).cast("int").alias("n"), F.expr(key).alias("key"), F.col(times).alias("times"))
    out = row("count", m.counts, "ngram", "cnt").union(row("context", m.contexts, "context", "ctx"))
    out = out.union(row("tokens", m.classes, "''", "tokens", "1")).union(row("recordings", m.classes, "''", "recordings", "1"))
    made = spark.range(1).select(F.lit("vocabulary"), F.lit(-1).cast("long"), F.lit(m.order), F.lit("|".join(map(str, m.lambdas))), F.lit(m.vocabulary).cast("long"))
    return out.union(made)


@R(
    "known_class_candidates",
    f"""{SC}, {SCORED},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round(fit, 6) DESC, scale_id, tonic) AS rank FROM fitted QUALIFY rank <= 5),
    sizes AS (SELECT CAST(floor(sqrt(recording_id)) AS BIGINT) AS class FROM (SELECT DISTINCT user_id AS recording_id FROM events) GROUP BY 1 HAVING count(*) >= 3)
    SELECT recording_id, scale_id, tonic, rank, scale_id % 16 AS class FROM ranked WHERE scale_id % 16 IN (SELECT class FROM sizes)""",
)
def known_class_candidates(spark, d):
    """Of each recording's five best hypotheses those of classes that a stored model has."""
    m = M.load(spark, stored(spark, d)[1])
    best = best_per_recording(scored(spark, d), [F.round("fit", 6).desc(), F.col("scale_id"), F.col("tonic")], 5)
    rows = best.select("recording_id", "scale_id", "tonic", "rank", (F.col("scale_id") % 16).cast("long").alias("class"))
    return M.known_classes(rows, m)


# The learner.


def candidate_features(spark, d):
    """(recording_id, class, hist, lm, residual, label): each class of each recording. hist: the share of notes on the steps that
    fall to the class; lm: the mean log probability without the recording; residual: the deletions of that of the class's scales that deletes least."""
    s = scores(spark, d, True).select("recording_id", "class", (F.col("logprob") / F.col("positions")).alias("lm"))
    n = S.notes(spark, d)
    whole = Window.partitionBy("recording_id")
    h = n.groupBy("recording_id", (F.col("pc") % 4).cast("long").alias("class")).agg(F.count("*").alias("n"))
    h = h.select("recording_id", "class", (F.col("n") / F.sum("n").over(whole)).alias("hist"))
    rates = T.deletion_of_scales(n, S.scales(spark, d), "scale_id", -0.06, 0.7)
    rates = rates.groupBy("recording_id", ((F.col("scale_id") - 1) % 4).cast("long").alias("class")).agg(F.min("residual").alias("residual"))
    j = s.join(h, ["recording_id", "class"], "left").withColumn("hist", F.coalesce("hist", F.lit(0.0))).join(rates, ["recording_id", "class"])
    return j.select("recording_id", "class", "hist", "lm", "residual", (F.col("class") == F.col("recording_id") % 4).cast("int").alias("label"))


@R("leave_one_out_learner")
def leave_one_out_learner(spark, d):
    """Weights of histogram, language model and deletions, learned for each recording from all others, and the rank that they give its own class."""
    rows = C.settled(candidate_features(spark, d), "features")
    return L.left_out_ranks(rows, ["hist", "lm", "residual"], "class")


# Spellings.

SUFFIXES = [" Steel", " Brass"]
SPELLINGS = """WITH k AS (
        SELECT found, min(place) AS place FROM (
            SELECT p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'hoti' ELSE 'ti' END AS found, p_partkey AS place FROM part) GROUP BY 1),
    labels AS (
        SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'i', 'ee') WHEN 2 THEN 'no ' || p_name || ' left'
            WHEN 3 THEN p_name || ' Steel' WHEN 4 THEN upper(p_name) || ' Brass' WHEN 5 THEN p_name || 'ti' WHEN 6 THEN p_name || 'hoti'
            WHEN 7 THEN upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), 'i', 'ee') ELSE substr(p_name, 1, 5) END AS name FROM part),
    w AS (SELECT DISTINCT name FROM labels),
    ways AS (
        SELECT name, 0 AS way, 'exact' AS stage, name AS t, true AS strict FROM w
        UNION ALL SELECT name, 1, 'case', name, false FROM w
        UNION ALL SELECT name, 2, 'i_to_ee', replace(name, 'i', 'ee'), true FROM w WHERE contains(name, 'i')
        UNION ALL SELECT name, 3, 'ee_to_i', replace(name, 'ee', 'i'), true FROM w WHERE contains(name, 'ee')
        UNION ALL SELECT name, 4, 'ti_to_hoti', substr(name, 1, length(name) - 2) || 'hoti', true FROM w WHERE name LIKE '%ti'
        UNION ALL SELECT name, 5, 'hoti_to_ti', substr(name, 1, length(name) - 4) || 'ti', true FROM w WHERE name LIKE '%hoti'
        UNION ALL SELECT name, way + 4, 'variant_case', t, false FROM (
            SELECT name, 2 AS way, replace(name, 'i', 'ee') AS t FROM w WHERE contains(name, 'i')
            UNION ALL SELECT name, 3, replace(name, 'ee', 'i') FROM w WHERE contains(name, 'ee')
            UNION ALL SELECT name, 4, substr(name, 1, length(name) - 2) || 'hoti' FROM w WHERE name LIKE '%ti'
            UNION ALL SELECT name, 5, substr(name, 1, length(name) - 4) || 'ti' FROM w WHERE name LIKE '%hoti')
        UNION ALL SELECT name, 10, 'suffix', trim(substr(name, 1, length(name) - 6)), true FROM w WHERE name LIKE '% Steel' OR name LIKE '% Brass'
        UNION ALL SELECT name, 11, 'suffix_case', trim(substr(name, 1, length(name) - 6)), false FROM w WHERE name LIKE '% Steel' OR name LIKE '% Brass'
        UNION ALL SELECT w.name, 20, 'contains', k.found, false FROM w JOIN k ON contains(lower(w.name), lower(k.found)) AND length(k.found) >= 4),
    met AS (
        SELECT name, way, stage, k.found, place FROM ways JOIN k ON lower(t) = lower(k.found) WHERE NOT strict OR t = k.found OR t = lower(k.found)),
    chain AS (
        SELECT w.name, arg_min(found, (way, place, found)) AS found, arg_min(stage, (way, place, found)) AS stage
        FROM w LEFT JOIN met USING (name) GROUP BY 1)"""


def labelled(spark, d):
    """Parts' names written in many ways, and the known names: parts' own, some with an ending."""
    p, name = S.table(spark, d, "part"), F.col("p_name")
    end = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "hoti").otherwise("ti")
    known = p.groupBy(F.concat(name, end).alias("found")).agg(F.min("p_partkey").alias("place"))
    ee = lambda c: F.replace(c, F.lit("i"), F.lit("ee"))
    forms = [
        F.upper(name), ee(name), F.concat(F.lit("no "), name, F.lit(" left")), F.concat(name, F.lit(" Steel")), F.concat(F.upper(name), F.lit(" Brass")),
        F.concat(name, F.lit("ti")), F.concat(name, F.lit("hoti")), F.concat(F.upper(F.substring(name, 1, 1)), ee(F.substring(name, 2, 1 << 20))), F.substring(name, 1, 5),
    ]
    form = F.element_at(F.array(*forms), (F.col("p_partkey") % 9).cast("int") + 1)
    return p.select("p_partkey", form.alias("name")), known


@R("spelling_chain", f"{SPELLINGS} SELECT * FROM chain")
def spelling_chain(spark, d):
    """Every label with the known name that it means, and at which stage of spelling that was found."""
    labels, known = labelled(spark, d)
    return N.spelling_chain(labels, known, SUFFIXES)


@R(
    "name_mismatches",
    f"""{SPELLINGS} SELECT name AS old_name, found AS new_name, coalesce(stage, 'missing') AS stage, count(*) AS occurrences
    FROM labels JOIN chain USING (name) WHERE coalesce(stage, '') <> 'exact' GROUP BY 1, 2, 3""",
)
def name_mismatches(spark, d):
    """Labels to rename or to add: all that are not known as they stand, with their stage and how often they occur."""
    labels, known = labelled(spark, d)
    times = labels.groupBy("name").agg(F.count("*").alias("occurrences"))
    found = N.spelling_chain(labels, known, SUFFIXES).join(times, "name")
    return found.where(F.coalesce("stage", F.lit("")) != "exact").select(F.col("name").alias("old_name"), F.col("found").alias("new_name"), F.coalesce("stage", F.lit("missing")).alias("stage"), "occurrences")


QUERIES, ORACLE = R.queries, R.oracle
