"""Joins: unique matches, name lookups in stages, range joins, skylines, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .names import alike


def unique_match(labels: DataFrame, files: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Each label with the one file of its first key, else of its next. More than one file is ambiguous and matches nothing:
    adds ``id_`` and ``match``: the key, 'ambiguous' or 'missing'."""
    rows = labels
    for k in keys:
        found = files.groupBy(k).agg(F.count("*").alias(f"_n_{k}"), F.min(id_).alias(f"_{k}"))
        rows = rows.join(found, k, "left")
    hit, kind = F.lit(None), F.lit("missing")
    for k in reversed(keys):
        n = F.col(f"_n_{k}")
        hit = F.when(n == 1, F.col(f"_{k}")).when(n.isNull(), hit)
        kind = F.when(n == 1, k).when(n > 1, "ambiguous").otherwise(kind)
    return rows.withColumn("match", kind).withColumn(id_, hit).drop(*(f"_{k}" for k in keys), *(f"_n_{k}" for k in keys))


def fuzzy_lookup(wanted: DataFrame, known: DataFrame, name: str = "name", order: str = "scale_id") -> DataFrame:
    """Each name with the first entry equal to it but for case, else with the first that holds it or is held by it; null if
    there is none, as for null and empty names."""
    w = wanted.select(name, F.lower(name).alias("_w")).distinct()
    k = known.select(F.lower(name).alias("_k"), F.col(order).alias("_o")).groupBy("_k").agg(F.min("_o").alias("_o"))
    exact = w.join(k, F.col("_w") == F.col("_k")).where("_w != ''").select(name, F.col("_o").alias("exact"))
    loose = alike(w, k, "_w", "_k").join(k, "_k").join(w, "_w").groupBy(name).agg(F.min("_o").alias("loose"))
    return wanted.join(exact, name, "left").join(loose, name, "left").withColumn(order, F.coalesce("exact", "loose")).withColumn("how", F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "contains").otherwise("none")).drop("exact", "loose")


def contained_anti(points: DataFrame, spans: DataFrame, bucket: float) -> DataFrame:
    """Points (recording_id, t) outside all closed spans (recording_id, start, end): an equi-join on buckets of time."""
    s = spans.select("recording_id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("_b"))
    p = points.withColumn("_b", F.floor(F.col("t") / bucket))
    return p.join(s, (p["recording_id"] == s["recording_id"]) & (p["_b"] == s["_b"]) & (p["t"] >= s["_s"]) & (p["t"] <= s["_e"]), "left_anti").drop("_b")


def skyline(rows: DataFrame, partition: list[str], first: str, second: str) -> DataFrame:
    """Rows that no other of the partition dominates (at least as good in both, better in one; more is better).

    Of each first only the best second can stay, and does if it is over the best of all better firsts: a running maximum over
    the distinct firsts, which then meet the rows. No window goes over all rows.
    """
    tops = rows.groupBy(*partition, first).agg(F.max(second).alias("_own"))
    better = Window.partitionBy(*partition).orderBy(F.col(first).desc()).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_best", F.max("_own").over(better)).where("_best is null or _own > _best").drop("_best")
    tops = tops.withColumnsRenamed({c: f"_t_{c}" for c in [*partition, first]})
    same = [F.col(c) == F.col(f"_t_{c}") for c in partition] + [F.col(first).eqNullSafe(F.col(f"_t_{first}")), F.col(second) == F.col("_own")]
    return rows.join(tops, same).select(*rows.columns)


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def pairs(rows: DataFrame, group: str, correct: str, features: list[str], order: list[str]) -> DataFrame:
    """For each group its first correct row against every incorrect one: differences of the features."""
    good = first_wins(rows.where(correct), group, order).select(group, *(F.col(f).alias(f"_{f}") for f in features))
    bad = rows.where(~F.col(correct))
    return bad.join(good, group).select(group, *order, *((F.col(f"_{f}") - F.col(f)).alias(f"d_{f}") for f in features))


def spelled_alike(wanted: DataFrame, known: DataFrame, name: str = "name", found: str = "found") -> DataFrame:
    """Each name with the known one that is equal (stage 1), equal but for case (2) or but for ee written as i (3); stage 9 if
    none is. One equi-join on the loosest form, then the best stage."""
    form = lambda c: F.replace(F.lower(c), F.lit("ee"), F.lit("i"))
    met = wanted.withColumn("_f", form(name)).join(known.withColumn("_f", form(found)), "_f")
    stage = F.when(F.col(name) == F.col(found), 1).when(F.lower(name) == F.lower(found), 2).otherwise(3)
    best = met.withColumn("stage", stage).groupBy(name).agg(F.min(F.struct("stage", found)).alias("b"))
    return wanted.join(best, name, "left").select(name, F.col(f"b.{found}").alias(found), F.coalesce("b.stage", F.lit(9)).alias("stage"))
