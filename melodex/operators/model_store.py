"""A class language model as versioned tables: written once, read back, and scored from without counting anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngrams as G


@dataclass(frozen=True)
class Model:
    """counts (class, n, ngram, cnt), contexts (class, n, context, ctx), classes (class, tokens, recordings), and how they were
    made: the order, add-k's share, the orders' weights (lowest first), and how many tokens all classes' texts have, those of
    classes left out among them."""

    counts: DataFrame
    contexts: DataFrame
    classes: DataFrame
    order: int
    k: float
    lambdas: tuple[float, ...]
    vocabulary: int


def train(grams: DataFrame, order: int, k: float, lambdas: list[float], least_recordings: int = 1) -> Model:
    """The model of n-grams (recording_id, class, n, ngram). Classes of fewer recordings are left out, after the vocabulary is
    counted."""
    some = grams.where(F.col("n") <= order)
    classes = some.where("n = 1").groupBy("class").agg(F.count("*").alias("tokens"), F.count_distinct("recording_id").alias("recordings")).where(F.col("recordings") >= least_recordings)
    vocabulary = some.where("n = 1").agg(F.count_distinct("ngram")).first()[0]
    counts = G.counts(some, ["class"]).join(classes.select("class"), "class", "left_semi")
    return Model(counts, G.context_counts(counts, ["class"]), classes, order, k, tuple(lambdas), vocabulary)


def save(model: Model, path: str) -> int:
    """Writes the model as the next version below ``path`` and returns its number, from 1. Counts and contexts lie in a folder
    for each order; what says how they were made is written last, so that a version that broke off is never read."""
    spark = model.counts.sparkSession
    version = max((r[0] for r in _versions(spark, path)), default=0) + 1
    at = f"{path}/version={version}"
    for name, rows in (("counts", model.counts), ("contexts", model.contexts)):
        rows.repartition("class", "n").write.mode("overwrite").partitionBy("n").parquet(f"{at}/{name}")
    model.classes.write.mode("overwrite").parquet(f"{at}/classes")
    meta = [(version, model.order, model.k, list(model.lambdas), model.vocabulary)]
    spark.createDataFrame(meta, META).coalesce(1).write.parquet(f"{path}/made/version={version}")
    return version


META = "number int, order int, k double, lambdas array<double>, vocabulary long"


def _versions(spark: SparkSession, path: str) -> list:
    """(number, ...) of each whole version, by number."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/made")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return []
    return sorted(spark.read.schema(META).parquet(f"{path}/made").select("number", "order", "k", "lambdas", "vocabulary").collect())


def load(spark: SparkSession, path: str, version: int | None = None) -> Model:
    """The model of a version, the last whole one if none is given."""
    known = {r["number"]: r for r in _versions(spark, path)}
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {version if version is not None else ''} of a model in {path}")
    r = known[max(known) if version is None else version]
    at = f"{path}/version={r['number']}"
    table = lambda name: spark.read.parquet(f"{at}/{name}")
    return Model(table("counts"), table("contexts"), table("classes"), r["order"], r["k"], tuple(r["lambdas"]), r["vocabulary"])


def known_classes(rows: DataFrame, model: Model, by: str = "class") -> DataFrame:
    """The rows of classes that the model has."""
    return rows.join(model.classes.select(F.col("class").alias(by)), by, "left_semi")


def score_positions(model: Model, grams: DataFrame) -> DataFrame:
    """(recording_id, seq, pos, class, p) of n-grams (recording_id, seq, pos, n, ngram) under each class of the model."""
    totals = model.classes.select("class", "tokens")
    return G.score_positions(grams, model.counts, totals, model.vocabulary, model.order, list(model.lambdas), model.k, contexts=model.contexts)


def score_recordings(model: Model, paths: DataFrame) -> DataFrame:
    """(recording_id, class, logprob, positions) of the positions' paths (recording_id, path) under each class of the model."""
    scored = G.score_paths(paths, model.counts, model.classes, model.vocabulary, model.order, list(model.lambdas), model.k, model.contexts)
    return G.score_recordings(paths, scored)


def entropy_weights(model: Model) -> DataFrame:
    return G.entropy_weights(model.counts)
