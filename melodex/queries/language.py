"""N-gram models of classes, motifs, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import ngrams as G
from ..operators import ranking as K
from ..operators import reports as T
from ..sources import adapters as S
from .registry import Registry

R = Registry()
#: Tokens: event types of users; a class is a user's id modulo 4; a sequence is a phrase (a session of 0.5 s).
TOK = f"""{S.with_('notes')}, ph AS (SELECT *, sum(CASE WHEN start_us - le > {S.UNIT // 2} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_us, note_id)::BIGINT AS seq FROM (SELECT *, lag(end_us) OVER (PARTITION BY recording_id ORDER BY start_us, note_id) AS le FROM notes)),
    arr AS (SELECT recording_id, recording_id % 4 AS class, seq, list_concat(['<BOS>'], list(track ORDER BY start_us, note_id)) AS tokens FROM ph GROUP BY 1, 2, 3),
    gr AS (SELECT recording_id, class, seq, n, pos, array_to_string(tokens[pos - n + 1:pos], '|') AS ngram FROM (SELECT *, unnest(range(n, len(tokens) + 1)) AS pos FROM arr, (SELECT unnest([1, 2, 3]) AS n)))"""
CTX = "regexp_replace(CASE WHEN contains(ngram, '|') THEN ngram ELSE '' END, '\\|[^|]*$', '')"
CNT = f"{TOK}, cnt AS (SELECT class, n, ngram, count(*) AS cnt FROM gr GROUP BY 1, 2, 3), ctx AS (SELECT class, n, {CTX} AS context, sum(cnt)::BIGINT AS ctx FROM cnt WHERE n >= 2 GROUP BY 1, 2, 3)"


def tokens(spark, d):
    from ..operators.phrases import gap_phrases

    return gap_phrases(S.notes(spark, d), 0.5, "seq").withColumn("class", F.col("recording_id") % 4)


def grams(spark, d, least=1, most=3):
    return G.windowed_ngrams(tokens(spark, d), ["recording_id", "class", "seq"], ["start_us", "note_id"], "track", least, most)


def paths(spark, d):
    """At each token the n-grams that end there, in partitions by recordings."""
    return G.windowed_paths(tokens(spark, d), ["recording_id", "class", "seq"], ["start_us", "note_id"], "track", 3)


@R("ngram_explode", f"{TOK} SELECT recording_id, seq, n, pos, ngram FROM gr")
def ngram_explode(spark, d):
    return grams(spark, d).select("recording_id", "seq", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "ngram")


@R("lm_counts", f"{CNT} SELECT class, n, ngram, cnt FROM cnt")
def lm_counts(spark, d):
    return G.counts(grams(spark, d), ["class"])


@R("lm_context_counts", f"{CNT} SELECT class, n, context, ctx FROM ctx")
def lm_context_counts(spark, d):
    return G.context_counts(G.counts(grams(spark, d), ["class"]), ["class"])


@R("lm_totals", f"{TOK} SELECT class, count(*) AS tokens, count(DISTINCT recording_id) AS recordings, count(DISTINCT ngram) AS types FROM gr WHERE n = 1 GROUP BY 1")
def lm_totals(spark, d):
    return grams(spark, d, 1, 1).groupBy("class").agg(F.count("*").alias("tokens"), F.count_distinct("recording_id").alias("recordings"), F.count_distinct("ngram").alias("types"))


@R("vocabulary", f"""{TOK}
    SELECT ngram AS token, count(DISTINCT class) AS classes, count(DISTINCT recording_id) AS recordings, count(*) AS n
    FROM gr WHERE n = 1 GROUP BY 1""")
def vocabulary(spark, d):
    """All tokens of all classes."""
    g = grams(spark, d, 1, 1).groupBy(F.col("ngram").alias("token"))
    return g.agg(F.count_distinct("class").alias("classes"), F.count_distinct("recording_id").alias("recordings"), F.count("*").alias("n"))


@R("lm_entropy", f"{CNT}, s AS (SELECT n, ngram, cnt / sum(cnt) OVER (PARTITION BY n, ngram) AS p FROM cnt) SELECT n, ngram, round(1 / (1 - sum(p * log2(p))), 6) AS weight FROM s GROUP BY 1, 2")
def lm_entropy(spark, d):
    e = G.entropy_weights(G.counts(grams(spark, d), ["class"]))
    return e.withColumn("weight", F.round("weight", 6))


LAMBDAS, ADD = [0.2, 0.3, 0.5], 0.01
PROB = f"""{CNT}, tot AS (SELECT class, sum(cnt)::BIGINT AS tokens FROM cnt WHERE n = 1 GROUP BY 1), v AS (SELECT count(DISTINCT ngram) AS v FROM cnt WHERE n = 1),
    own AS (SELECT recording_id, class, n, ngram, count(*) AS cnt FROM gr GROUP BY 1, 2, 3, 4), octx AS (SELECT recording_id, class, n, {CTX} AS context, sum(cnt)::BIGINT AS ctx FROM own WHERE n >= 2 GROUP BY 1, 2, 3, 4),
    otot AS (SELECT recording_id, class, sum(cnt)::BIGINT AS tokens FROM own WHERE n = 1 GROUP BY 1, 2),
    q AS (SELECT recording_id, seq, n, pos, ngram, {CTX} AS context, tot.class AS class, tot.tokens FROM gr CROSS JOIN tot WHERE gr.pos > 1),
    parts AS (SELECT q.recording_id, q.seq, q.pos, q.class, q.n, (CASE q.n WHEN 1 THEN 0.2 WHEN 2 THEN 0.3 ELSE 0.5 END)::DOUBLE *
        (coalesce(cnt.cnt, 0) - LOO * coalesce(own.cnt, 0) + 0.01::DOUBLE) / (CASE WHEN q.n = 1 THEN q.tokens - LOO * coalesce(otot.tokens, 0) ELSE coalesce(ctx.ctx, 0) - LOO * coalesce(octx.ctx, 0) END + 0.01::DOUBLE * v) AS part
        FROM q CROSS JOIN v LEFT JOIN cnt ON cnt.class = q.class AND cnt.n = q.n AND cnt.ngram = q.ngram LEFT JOIN ctx ON ctx.class = q.class AND ctx.n = q.n AND ctx.context = q.context
        LEFT JOIN own ON own.recording_id = q.recording_id AND own.class = q.class AND own.n = q.n AND own.ngram = q.ngram LEFT JOIN octx ON octx.recording_id = q.recording_id AND octx.class = q.class AND octx.n = q.n AND octx.context = q.context
        LEFT JOIN otot ON otot.recording_id = q.recording_id AND otot.class = q.class),
    pos AS (SELECT recording_id, seq, pos, class, sum(part) + (CASE max(n) WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0 END)::DOUBLE / (SELECT v FROM v) AS p FROM parts GROUP BY 1, 2, 3, 4),
    sc AS (SELECT recording_id, class, sum(ln(p)) AS logprob, count(*) AS positions FROM pos GROUP BY 1, 2)"""


def scores(spark, d, leave_one_out):
    counted = G.counts(grams(spark, d), ["class"])
    totals = counted.where("n = 1").groupBy("class").agg(F.sum("cnt").alias("tokens"))
    v = counted.where("n = 1").select("ngram").distinct().count()
    p, own = paths(spark, d), None
    if leave_one_out:
        mine = G.counts(grams(spark, d), ["recording_id", "class"])
        own = G.own_paths(p.groupBy("recording_id", "path").agg(F.count("*").alias("times")), counted, totals, mine, v, 3, LAMBDAS, ADD)
    return G.score_recordings(p, G.score_paths(p, counted, totals, v, 3, LAMBDAS, ADD), own)


@R("lm_score", PROB.replace("LOO", "0") + " SELECT recording_id, class, positions, round(logprob / positions, 6) AS mean FROM sc")
def lm_score(spark, d):
    return scores(spark, d, False).select("recording_id", "class", "positions", F.round(F.col("logprob") / F.col("positions"), 6).alias("mean"))


@R("lm_rank", PROB.replace("LOO", "0") + " SELECT recording_id, class, row_number() OVER (PARTITION BY recording_id ORDER BY round(logprob, 6) DESC, class) AS rank FROM sc")
def lm_rank(spark, d):
    w = Window.partitionBy("recording_id").orderBy(F.round("logprob", 6).desc(), "class")
    return scores(spark, d, False).select("recording_id", "class", F.row_number().over(w).alias("rank"))


@R("lm_weighted_score", PROB.replace("LOO", "0") + """,
    ew AS (SELECT n, ngram, 1 / (1 - sum(p * log2(p))) AS weight FROM (SELECT n, ngram, cnt / sum(cnt) OVER (PARTITION BY n, ngram) AS p FROM cnt) GROUP BY 1, 2),
    bw AS (SELECT recording_id, seq, pos, arg_max(weight, n) AS weight FROM gr JOIN ew USING (n, ngram) WHERE pos > 1 GROUP BY 1, 2, 3)
    SELECT recording_id, class, round(sum(weight * ln(p)) / sum(weight), 6) AS mean FROM pos JOIN bw USING (recording_id, seq, pos) GROUP BY 1, 2""")
def lm_weighted_score(spark, d):
    """The mean log probability of a recording's tokens under each class, weighed by how much an n-gram tells classes apart."""
    counted = G.counts(grams(spark, d), ["class"])
    totals = counted.where("n = 1").groupBy("class").agg(F.sum("cnt").alias("tokens"))
    v = counted.where("n = 1").select("ngram").distinct().count()
    p = paths(spark, d)
    s = G.score_recordings(p, G.score_paths(p, counted, totals, v, 3, LAMBDAS, ADD), weights=G.path_weights(p, G.entropy_weights(counted)))
    return s.select("recording_id", "class", F.round(F.col("total") / F.col("weight"), 6).alias("mean"))


LOO = PROB.replace("LOO", "1")


@R("lm_loo_subtractive", LOO + " SELECT recording_id, class, round(logprob, 5) AS logprob FROM sc")
def lm_loo_subtractive(spark, d):
    return scores(spark, d, True).select("recording_id", "class", F.round("logprob", 5).alias("logprob"))


@R("class_accuracy", LOO + """, rk AS (SELECT recording_id, class, row_number() OVER (PARTITION BY recording_id ORDER BY round(logprob, 6) DESC, class) AS r FROM sc),
    own_r AS (SELECT recording_id, min(CASE WHEN class = recording_id % 4 THEN r END) AS r FROM rk GROUP BY 1)
    SELECT recording_id % 4 AS class, count(*) AS recordings, count(*) FILTER (r = 1) AS top1, count(*) FILTER (r <= 5) AS top5, count(r) AS found FROM own_r GROUP BY 1""")
def class_accuracy(spark, d):
    """For each class how many of its recordings find it at all, first, and among the first five, each left out of its counts."""
    w = Window.partitionBy("recording_id").orderBy(F.round("logprob", 6).desc(), "class")
    ranked = scores(spark, d, True).withColumn("r", F.row_number().over(w))
    own = ranked.groupBy("recording_id").agg(F.min(F.when(F.col("class") == F.col("recording_id") % 4, F.col("r"))).alias("r"))
    return own.groupBy((F.col("recording_id") % 4).alias("class")).agg(F.count("*").alias("recordings"), F.count_if(F.col("r") == 1).alias("top1"), F.count_if(F.col("r") <= 5).alias("top5"), F.count("r").alias("found"))


@R("mrr_topk", LOO + """, rk AS (SELECT recording_id, class, row_number() OVER (PARTITION BY recording_id ORDER BY round(logprob, 6) DESC, class) AS r FROM sc), own_r AS (SELECT recording_id, r FROM rk WHERE class = recording_id % 4)
    SELECT count(*) AS recordings, round(avg((r = 1)::INT), 4) AS top1, round(avg((r <= 3)::INT), 4) AS top3, round(avg(1.0::DOUBLE / r), 4) AS mrr FROM own_r""")
def mrr_topk(spark, d):
    w = Window.partitionBy("recording_id").orderBy(F.round("logprob", 6).desc(), "class")
    r = scores(spark, d, True).withColumn("r", F.row_number().over(w)).where(F.col("class") == F.col("recording_id") % 4)
    return r.agg(F.count("*").alias("recordings"), F.round(F.avg((F.col("r") == 1).cast("int")), 4).alias("top1"), F.round(F.avg((F.col("r") <= 3).cast("int")), 4).alias("top3"), F.round(F.avg(1 / F.col("r")), 4).alias("mrr"))


@R("confusion_matrix", LOO + """, best AS (SELECT recording_id, arg_max(class, (round(logprob, 6), -class)) AS predicted FROM sc GROUP BY 1)
    SELECT recording_id % 4 AS truth, """ + ", ".join(f"count(*) FILTER (predicted = {i}) AS predicted_{i}" for i in range(4)) + " FROM best GROUP BY 1")
def confusion_matrix(spark, d):
    best = scores(spark, d, True).groupBy("recording_id").agg(F.max_by("class", F.struct(F.round("logprob", 6), -F.col("class"))).alias("predicted"))
    p = best.groupBy((F.col("recording_id") % 4).alias("truth")).pivot("predicted", [0, 1, 2, 3]).agg(F.count(F.lit(1)))
    return p.select("truth", *(F.coalesce(F.col(str(i)), F.lit(0)).alias(f"predicted_{i}") for i in range(4)))


@R("confusion_pairs", LOO + """, best AS (SELECT recording_id, arg_max(class, (round(logprob, 6), -class)) AS predicted FROM sc GROUP BY 1)
    SELECT least(recording_id % 4, predicted) AS a, greatest(recording_id % 4, predicted) AS b, count(*) AS total, count(*) FILTER (recording_id % 4 < predicted) AS forward, array_to_string(list_sort(list(recording_id))[1:5], ',') AS samples FROM best WHERE recording_id % 4 <> predicted GROUP BY 1, 2""")
def confusion_pairs(spark, d):
    best = scores(spark, d, True).groupBy("recording_id").agg(F.max_by("class", F.struct(F.round("logprob", 6), -F.col("class"))).alias("predicted"))
    t = F.col("recording_id") % 4
    pairs = best.where(t != F.col("predicted")).withColumns({"a": F.least(t, "predicted"), "b": F.greatest(t, "predicted")})
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("recording_id")))
    five = F.sort_array(F.collect_list(F.when(F.col("r") <= 5, F.col("recording_id"))))
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("total"), F.count(F.when(t < F.col("predicted"), 1)).alias("forward"), five.alias("s"))
    return out.select("a", "b", "total", "forward", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("samples"))


MOT = f"""{TOK}, whole AS (SELECT recording_id, recording_id % 4 AS class, list(track ORDER BY start_us, note_id) AS tokens FROM notes GROUP BY 1, 2),
    mg AS (SELECT recording_id, class, pos, array_to_string(tokens[pos - n + 1:pos], '|') AS ngram FROM (SELECT *, unnest(range(n, len(tokens) + 1)) AS pos FROM whole, (SELECT unnest([3, 4]) AS n))),
    once AS (SELECT class, recording_id, ngram, count(*) AS occ FROM mg GROUP BY 1, 2, 3), size AS (SELECT class, count(DISTINCT recording_id) AS recordings FROM mg GROUP BY 1),
    per AS (SELECT class, ngram, count(*) AS support, sum(occ)::BIGINT AS occurrences FROM once GROUP BY 1, 2),
    st AS (SELECT *, support / total AS specificity, -sum(support / total * log2(support / total)) OVER (PARTITION BY ngram) AS entropy FROM (SELECT *, sum(support) OVER (PARTITION BY ngram) AS total FROM per)),
    motifs AS (SELECT st.*, support / recordings AS coverage, specificity / (1 + entropy) AS weight FROM st JOIN size USING (class) WHERE support >= 2)"""


def motif_grams(spark, d):
    n = S.notes(spark, d).withColumn("class", F.col("recording_id") % 4)
    return G.windowed_ngrams(n, ["recording_id", "class"], ["start_us", "note_id"], "track", 3, 4, start=False)


def motifs(spark, d):
    return G.motif_stats(motif_grams(spark, d)).where("support >= 2")


@R("motif_support", f"{MOT} SELECT class, ngram, support, occurrences, round(coverage, 6) AS coverage FROM motifs")
def motif_support(spark, d):
    return motifs(spark, d).select("class", "ngram", "support", "occurrences", F.round("coverage", 6).alias("coverage"))


@R("motif_entropy_weight", f"{MOT} SELECT class, ngram, round(specificity, 6) AS specificity, round(entropy, 6) AS entropy, round(weight, 6) AS weight FROM motifs")
def motif_entropy_weight(spark, d):
    return motifs(spark, d).select("class", "ngram", *(F.round(c, 6).alias(c) for c in ("specificity", "entropy", "weight")))


@R("motif_index", f"{MOT} SELECT class, ngram, place FROM (SELECT class, ngram, row_number() OVER (PARTITION BY class ORDER BY support DESC, round(weight, 9) DESC, occurrences DESC, length(ngram) DESC, ngram) AS place FROM motifs) WHERE place <= 20")
def motif_index(spark, d):
    w = Window.partitionBy("class").orderBy(F.col("support").desc(), F.round("weight", 9).desc(), F.col("occurrences").desc(), F.length("ngram").desc(), "ngram")
    return motifs(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 20").select("class", "ngram", "place")


@R("motif_score", f"{MOT} SELECT mg.recording_id, m.class, round(sum(weight), 5) AS score, count(*) AS hits, count(DISTINCT mg.ngram) AS motifs FROM mg JOIN motifs m USING (ngram) GROUP BY 1, 2")
def motif_score(spark, d):
    return G.motif_scores(motif_grams(spark, d), motifs(spark, d), ["recording_id"]).withColumn("score", F.round("score", 5))


@R("motif_overlay", f"""{MOT},
    mine AS (SELECT mg.recording_id, m.class AS class, round(sum(weight), 5) AS total FROM mg JOIN motifs m USING (ngram) GROUP BY 1, 2),
    top AS (SELECT * FROM mine QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY total DESC, class) <= 2),
    pg AS (
        SELECT recording_id, seq, array_to_string(tokens[pos - n + 1:pos], '|') AS ngram
        FROM (SELECT *, unnest(range(n, len(tokens) + 1)) AS pos FROM arr, (SELECT unnest([3, 4]) AS n)) WHERE NOT contains(array_to_string(tokens[pos - n + 1:pos], '|'), '<BOS>')),
    b AS (SELECT recording_id, seq, round(min(start), 6) AS start, round(max("end"), 6) AS "end" FROM ph GROUP BY 1, 2),
    o AS (
        SELECT pg.recording_id AS recording_id, seq, m.class AS class, round(sum(weight), 5) AS score, count(*) AS hits, array_to_string(list_sort(list(DISTINCT ngram)), ' ') AS motifs
        FROM pg JOIN motifs m USING (ngram) GROUP BY 1, 2, 3)
    SELECT recording_id, seq, class, start, "end", score, hits, motifs FROM o SEMI JOIN top USING (recording_id, class) JOIN b USING (recording_id, seq)""")
def motif_overlay(spark, d):
    """For the two best classes of a recording each phrase's motifs: its bounds, their number, score and names."""
    m = motifs(spark, d)
    mine = G.motif_scores(motif_grams(spark, d), m, ["recording_id"]).withColumn("score", F.round("score", 5))
    w = Window.partitionBy("recording_id").orderBy(F.col("score").desc(), "class")
    top = mine.withColumn("r", F.row_number().over(w)).where("r <= 2").select("recording_id", "class")
    g = grams(spark, d, 3, 4).where(~F.col("ngram").contains(G.START))
    met = g.drop("class").join(m.select("class", "ngram", "weight"), "ngram").join(top, ["recording_id", "class"], "left_semi")
    o = met.groupBy("recording_id", "seq", "class").agg(F.round(F.sum("weight"), 5).alias("score"), F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("ngram")), " ").alias("motifs"))
    bounds = tokens(spark, d).groupBy("recording_id", "seq").agg(F.round(F.min("start"), 6).alias("start"), F.round(F.max("end"), 6).alias("end"))
    return o.join(bounds, ["recording_id", "seq"])


@R("motif_ranking", f"""{MOT},
    hit AS (SELECT mg.recording_id, m.class AS class, ngram, count(*) AS n, round(count(*) * any_value(weight), 9) AS part FROM mg JOIN motifs m USING (ngram) GROUP BY 1, 2, 3),
    r AS (SELECT recording_id, class, round(sum(part), 5) AS score, sum(n)::BIGINT AS hits, count(*) AS motifs FROM hit GROUP BY 1, 2),
    k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, class) <= 2),
    t AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY recording_id, class ORDER BY part DESC, n DESC, ngram) <= 20)
    SELECT k.recording_id AS recording_id, k.class AS class, score, hits, motifs, array_to_string(list(ngram ORDER BY part DESC, n DESC, ngram), ' ') AS top_motifs
    FROM k JOIN t USING (recording_id, class) GROUP BY ALL""")
def motif_ranking(spark, d):
    """The two best classes of each recording by its motifs, with the twenty of the largest part."""
    met = motif_grams(spark, d).drop("class").join(motifs(spark, d).select("class", "ngram", "weight"), "ngram")
    hit = met.groupBy("recording_id", "class", "ngram").agg(F.count("*").alias("n"), F.round(F.count("*") * F.first("weight"), 9).alias("part"))
    w = Window.partitionBy("recording_id", "class").orderBy(F.col("part").desc(), F.col("n").desc(), "ngram")
    hit = hit.withColumn("at", F.row_number().over(w))
    names = F.transform(F.sort_array(F.collect_list(F.when(F.col("at") <= 20, F.struct("at", "ngram")))), lambda x: x["ngram"])
    r = hit.groupBy("recording_id", "class").agg(F.round(F.sum("part"), 5).alias("score"), F.sum("n").alias("hits"), F.count("*").alias("motifs"), F.array_join(names, " ").alias("top_motifs"))
    best = Window.partitionBy("recording_id").orderBy(F.col("score").desc(), "class")
    return r.withColumn("r", F.row_number().over(best)).where("r <= 2").drop("r")


@R("common_patterns", f"""{TOK}, wd AS (SELECT recording_id, seq, i, tokens[i:least(i + 4, len(tokens))] AS w FROM (SELECT *, unnest(range(2, len(tokens) - 1)) AS i FROM arr)),
    sub AS (SELECT array_to_string(w[a:a + n - 1], '|') AS pattern, n FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS a FROM wd, (SELECT unnest([3, 4, 5]) AS n)))
    SELECT pattern, n, count(*) AS freq FROM sub GROUP BY 1, 2 HAVING count(*) >= 2""")
def common_patterns(spark, d):
    """Sub-sequences of overlapping windows of up to five tokens; counted in every window, on purpose."""
    w = S.note_order("seq")
    rows = tokens(spark, d).select("track", *[F.lead("track", k).over(w).alias(f"_{k}") for k in range(1, 5)]).where("_2 is not null")
    w = rows.select(F.array_compact(F.array("track", "_1", "_2", "_3", "_4")).alias("tokens"))
    return G.ngrams(w, 3, 5).groupBy(F.col("ngram").alias("pattern"), F.col("n").cast("long").alias("n")).agg(F.count("*").alias("freq")).where("freq >= 2")


LI = "WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'R' AS ok, l_quantity / (max(l_quantity) OVER (PARTITION BY l_orderkey) + 1e-12) - 2 * l_discount + l_tax AS score FROM lineitem)"


def lines(spark, d):
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").alias("ok"))
    share = F.col("l_quantity") / (F.max("l_quantity").over(Window.partitionBy("l_orderkey")) + 1e-12)
    return li.withColumn("score", F.round(share - 2 * F.col("l_discount") + F.col("l_tax"), 9))


@R("competition_rank", LI + " SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (PARTITION BY l_orderkey ORDER BY round(score, 9) DESC) AS rank FROM f")
def competition_rank(spark, d):
    return K.competition_rank(lines(spark, d), "l_orderkey", "score").select("l_orderkey", "l_linenumber", "l_partkey", "rank")


RANKS = LI + ", b AS (SELECT *, max(round(score, 9)) FILTER (ok) OVER (PARTITION BY l_orderkey) AS best FROM f), r AS (SELECT l_orderkey, count(*) AS n, CASE WHEN max(best) IS NULL THEN count(*) + 1 ELSE 1 + count(*) FILTER (round(score, 9) > best) END AS rank FROM b GROUP BY 1)"


@R("correct_ranks", RANKS + " SELECT l_orderkey, rank, n FROM r")
def correct_ranks(spark, d):
    return K.correct_ranks(lines(spark, d), "l_orderkey", "score", "ok")


@R("rank_metrics", RANKS + " SELECT round(avg(1.0::DOUBLE / rank), 4) AS mrr, round(avg((rank <= 1)::INT), 4) AS top1, round(avg((rank <= 3)::INT), 4) AS top3, round(avg((rank <= 5)::INT), 4) AS top5, round(avg((rank <= 10)::INT), 4) AS top10, floor(median(rank))::BIGINT AS median_rank, round(avg(rank), 4) AS mean_rank, count(*) AS songs FROM r")
def rank_metrics(spark, d):
    return K.rank_metrics(K.correct_ranks(lines(spark, d), "l_orderkey", "score", "ok"))


@R("group_max_share", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / (max(l_extendedprice) OVER (PARTITION BY l_orderkey) + 1e-12), 6) AS share, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS any_correct FROM lineitem")
def group_max_share(spark, d):
    w = Window.partitionBy("l_orderkey")
    li = S.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") / (F.max("l_extendedprice").over(w) + 1e-12), 6).alias("share"), F.bool_or(F.col("l_returnflag") == "R").over(w).alias("any_correct"))


@R("variant_summary_p95", "SELECT l_shipmode_like AS variant, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, max(l_extendedprice) AS max, count(*) FILTER (l_discount > 0.05) AS discounted FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1")
def variant_summary_p95(spark, d):
    li = S.table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("variant"))
    return li.agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.percentile("l_extendedprice", 0.95), 4).alias("p95"), F.max("l_extendedprice").alias("max"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("discounted"))


@R("lm_rerank", LOO + f""",
    {S.SQL["scales"]},
    h AS (SELECT recording_id, pc % 4 AS class, count(*) - 10.0::DOUBLE AS hist FROM notes GROUP BY 1, 2),
    away AS (
        SELECT recording_id, note_id, scale_id, min(abs(((midi % 12 - step + 6) % 12 + 12) % 12 - 6)) AS far
        FROM notes CROSS JOIN scale_steps GROUP BY 1, 2, 3),
    rate AS (SELECT recording_id, scale_id, avg(CASE WHEN round(far, 9) <= 1 THEN 0.0::DOUBLE ELSE 1 END) AS rate FROM away GROUP BY 1, 2),
    size AS (SELECT scale_id, count(*) AS k FROM scale_steps GROUP BY 1),
    del AS (
        SELECT recording_id, (scale_id - 1) % 4 AS class, min(rate - (-0.06 * k + 0.7)) AS residual
        FROM rate JOIN size USING (scale_id) GROUP BY 1, 2),
    j AS (
        SELECT sc.recording_id, sc.class, coalesce(hist, 0) AS hist, logprob / positions AS lm, residual
        FROM sc JOIN del USING (recording_id, class) LEFT JOIN h ON h.recording_id = sc.recording_id AND h.class = sc.class),
    g AS (
        SELECT *, CASE WHEN count(*) FILTER (hist > 0) OVER w > 0 THEN hist > 0 ELSE row_number() OVER (PARTITION BY recording_id ORDER BY hist DESC, class) <= 2 END AS gated
        FROM j WINDOW w AS (PARTITION BY recording_id)),
    b AS (
        SELECT *, min(hist) FILTER (gated) OVER w AS h0, max(hist) FILTER (gated) OVER w AS h1, min(lm) FILTER (gated) OVER w AS l0, max(lm) FILTER (gated) OVER w AS l1
        FROM g WINDOW w AS (PARTITION BY recording_id)),
    c AS (
        SELECT *, CASE WHEN gated THEN round(0.5 * (hist - h0) / (CASE WHEN h1 > h0 THEN h1 - h0 ELSE 1 END)
            + 2.0 * (lm - l0) / (CASE WHEN l1 > l0 THEN l1 - l0 ELSE 1 END) - 2.0 * residual, 7) ELSE -999 END AS combined FROM b)
    SELECT recording_id, class, gated, round(residual, 6) AS residual, combined, row_number() OVER (PARTITION BY recording_id ORDER BY combined DESC, class) AS lm_rank FROM c""")
def lm_rerank(spark, d):
    """Classes by histogram, language model and the share of notes that the class's scale would delete; every scale belongs to a
    class, and the one that deletes least counts for it."""
    s = scores(spark, d, True).select("recording_id", "class", (F.col("logprob") / F.col("positions")).alias("lm"))
    n = S.notes(spark, d)
    h = n.groupBy("recording_id", (F.col("pc") % 4).cast("long").alias("class")).agg((F.count("*") - F.lit(10.0)).alias("hist"))
    rates = T.deletion_of_scales(n, S.scales(spark, d), "scale_id", -0.06, 0.7)
    rates = rates.groupBy("recording_id", ((F.col("scale_id") - 1) % 4).cast("long").alias("class")).agg(F.min("residual").alias("residual"))
    j = s.join(h, ["recording_id", "class"], "left").withColumn("hist", F.coalesce("hist", F.lit(0.0))).join(rates, ["recording_id", "class"])
    return K.rerank(j, fallback=2, places=7).select("recording_id", "class", "gated", F.round("residual", 6).alias("residual"), "combined", "lm_rank")


@R("evaluation_rows", LOO + """, r AS (SELECT *, round(logprob / positions, 6) AS mean, row_number() OVER (PARTITION BY recording_id ORDER BY round(logprob, 6) DESC, class) AS r FROM sc)
    SELECT recording_id, recording_id % 4 AS true_class, max(class) FILTER (r = 1) AS predicted, bool_or(r = 1 AND class = recording_id % 4) AS correct, max(r) FILTER (class = recording_id % 4) AS true_rank,
        max(mean) FILTER (r = 1) AS score_1, max(mean) FILTER (r = 2) AS score_2, max(mean) FILTER (r = 3) AS score_3, max(class) FILTER (r = 1) AS class_1, max(class) FILTER (r = 2) AS class_2, max(class) FILTER (r = 3) AS class_3
    FROM r GROUP BY 1""")
def evaluation_rows(spark, d):
    """A row for each recording: its class, the predicted one, its rank, and the three best classes with their scores."""
    w = Window.partitionBy("recording_id").orderBy(F.round("logprob", 6).desc(), "class")
    r = scores(spark, d, True).withColumn("mean", F.round(F.col("logprob") / F.col("positions"), 6)).withColumn("r", F.row_number().over(w))
    own, at = F.col("class") == F.col("recording_id") % 4, lambda c, k: F.max(F.when(F.col("r") == k, F.col(c)))
    tops = [at(c, k).alias(f"{n}_{k}") for c, n in (("mean", "score"), ("class", "class")) for k in (1, 2, 3)]
    out = r.groupBy("recording_id").agg(at("class", 1).alias("predicted"), F.bool_or((F.col("r") == 1) & own).alias("correct"), F.max(F.when(own, F.col("r"))).alias("true_rank"), *tops)
    return out.withColumn("true_class", F.col("recording_id") % 4)


@R("fold_learner")
def fold_learner(spark, d):
    """Logistic regression with classes of equal weight, judged on the orders that it did not see."""
    return K.fold_weights(lines(spark, d).withColumnRenamed("l_orderkey", "song"), "song", ["l_quantity", "l_discount", "l_tax"], "ok")


@R("pairwise_ranker")
def pairwise_ranker(spark, d):
    """Weights of the features by pairwise logistic regression, and the share of pairs that they order rightly."""
    names = ["d_l_quantity", "d_l_discount", "d_l_tax"]
    p = J.pairs(lines(spark, d), "l_orderkey", "ok", ["l_quantity", "l_discount", "l_tax"], ["l_linenumber", "l_partkey"])
    w = K.pairwise_weights(p, names)
    right = K.fused(p, dict(zip(names, w, strict=True)), "margin").agg(F.avg((F.col("margin") > 0).cast("double")).alias("right"), F.count("*").alias("pairs"))
    return right.select(F.array(*[F.lit(x) for x in w]).alias("weights"), "right", "pairs")


QUERIES, ORACLE = R.queries, R.oracle
