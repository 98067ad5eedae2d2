"""Rank metrics, confusions, fusion of scores, and learners of ranking weights."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def competition_rank(rows: DataFrame, group: str, score: str, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.rank().over(Window.partitionBy(group).orderBy(F.col(score).desc())))


def correct_ranks(rows: DataFrame, group: str, score: str, correct: str) -> DataFrame:
    """(group, rank, n): 1 + how many score higher than the best correct row; n + 1 where none is correct."""
    best = F.max(F.when(F.col(correct), F.col(score))).over(Window.partitionBy(group))
    rows = rows.withColumn("_best", best)
    out = rows.groupBy(group).agg(F.max("_best").alias("_b"), F.sum((F.col(score) > F.col("_best")).cast("long")).alias("_over"), F.count("*").alias("n"))
    return out.select(group, F.when(F.col("_b").isNull(), F.col("n") + 1).otherwise(1 + F.col("_over")).alias("rank"), "n")


def rank_metrics(ranks: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    top = lambda k: F.round(F.avg((F.col("rank") <= k).cast("double")), 4).alias(f"top{k}")
    aggs = [F.round(F.avg(1 / F.col("rank")), 4).alias("mrr"), *(top(k) for k in (1, 3, 5, 10)), F.floor(F.median("rank")).alias("median_rank"), F.round(F.avg("rank"), 4).alias("mean_rank"), F.count("*").alias("songs")]
    return ranks.groupBy(*by).agg(*aggs) if by else ranks.agg(*aggs)


def fused(rows: DataFrame, weights: dict[str, float], name: str = "combined") -> DataFrame:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.col(c)
    return rows.withColumn(name, total)


def pair_matrix(pairs: DataFrame, features: list[str]) -> DataFrame:
    """Differences (correct less incorrect) labelled 1, and mirrored labelled 0."""
    up = pairs.select(F.lit(1.0).alias("label"), *features)
    return up.unionByName(pairs.select(F.lit(0.0).alias("label"), *((-F.col(f)).alias(f) for f in features)))


def pairwise_weights(pairs: DataFrame, features: list[str], l2: float = 1e-4) -> list[float]:
    """Weights of a linear score by logistic regression on pairs, without an intercept; Spark halves the penalty."""
    data = VectorAssembler(inputCols=features, outputCol="x").transform(pair_matrix(pairs, features))
    model = LogisticRegression(featuresCol="x", fitIntercept=False, standardization=False, regParam=2 * l2, maxIter=50).fit(data)
    return [float(x) for x in model.coefficients]


def rerank(rows: DataFrame, fallback: int = 20, histogram: float = 0.5, model: float = 2.0, deletion: float = 2.0, places: int = 4) -> DataFrame:
    """Adds gated, combined and lm_rank to hypotheses (recording_id, class, hist, lm, residual): those with a positive score of
    the histogram pass the gate, or the best ``fallback`` where none has; among them the scores of histogram and language model,
    each spread over 0 to 1, are weighed, and the share of deleted notes over the expected one is taken off. The others get
    -999. A model's score of -900 and below is none, and has no part in the spread."""
    w = Window.partitionBy("recording_id")
    pos, place = F.sum((F.col("hist") > 0).cast("int")).over(w), F.row_number().over(w.orderBy(F.col("hist").desc(), "class"))
    rows = rows.withColumn("gated", F.when(pos > 0, F.col("hist") > 0).otherwise(place <= fallback))
    inside = {"hist": F.col("gated"), "lm": F.col("gated") & (F.col("lm") > -900)}
    for c, ok in inside.items():
        x = F.when(ok, F.col(c))
        lo, hi = F.coalesce(F.min(x).over(w), F.lit(0.0)), F.coalesce(F.max(x).over(w), F.lit(1.0))
        rows = rows.withColumn(f"n_{c}", (F.col(c) - lo) / F.when(hi > lo, hi - lo).otherwise(1.0))
    score = F.round(histogram * F.col("n_hist") + model * F.col("n_lm") - deletion * F.col("residual"), places)
    rows = rows.withColumn("combined", F.when(F.col("gated"), score).otherwise(-999.0)).drop("n_hist", "n_lm")
    return rows.withColumn("lm_rank", F.row_number().over(w.orderBy(F.col("combined").desc(), "class")))


def fold_weights(rows: DataFrame, group: str, features: list[str], label: str, folds: int = 5) -> DataFrame:
    """(fold, weights, top1, top3, groups): logistic regression with classes of equal weight, learned without one fold of the groups
    and judged on it, for each fold; groups fall into folds by a hash."""
    from pyspark.ml.functions import vector_to_array

    spark = rows.sparkSession
    fold = F.pmod(F.xxhash64(F.lit("fold"), group), F.lit(folds)).cast("int")
    data = VectorAssembler(inputCols=features, outputCol="x").transform(rows.select(group, *features, F.col(label).cast("double").alias("label"), fold.alias("fold"))).cache()
    out = []
    for k in range(folds):  # each a fit of its own
        train = data.where(F.col("fold") != k)
        n, ones = train.agg(F.count("*"), F.sum("label")).first()
        if not n or not 0 < (ones or 0) < n:
            continue
        weight = F.when(F.col("label") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones)))
        model = LogisticRegression(featuresCol="x", weightCol="w", maxIter=50, regParam=1.0 / n).fit(train.withColumn("w", weight))
        judged = model.transform(data.where(F.col("fold") == k)).withColumn("score", vector_to_array("probability")[1]).withColumn("ok", F.col("label") == 1)
        m = correct_ranks(judged, group, "score", "ok").agg(F.avg((F.col("rank") <= 1).cast("double")), F.avg((F.col("rank") <= 3).cast("double")), F.count("*")).first()
        out.append((k, [float(x) for x in model.coefficients], m[0], m[1], m[2]))
    data.unpersist()
    return spark.createDataFrame(out, "fold int, weights array<double>, top1 double, top3 double, groups long")


def learned_ranking(rows: DataFrame, group: str, features: list[str], held_out: int = 5) -> DataFrame:
    """Metrics of a scaled multilayer perceptron on the groups kept out (one in ``held_out`` by hash); rows have a label of 0 or 1."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    out = F.pmod(F.xxhash64(F.lit("fold"), group), F.lit(held_out)) == 0
    steps = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), MultilayerPerceptronClassifier(featuresCol="x", layers=[len(features), 16, 8, 2], maxIter=15, seed=1)]
    model = Pipeline(stages=steps).fit(rows.where(~out))
    judged = model.transform(rows.where(out)).withColumn("score", vector_to_array("probability")[1]).withColumn("ok", F.col("label") == 1)
    return rank_metrics(correct_ranks(judged, group, "score", "ok"))
