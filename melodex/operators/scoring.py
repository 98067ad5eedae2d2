"""Ranks hypotheses (scale, tonic) of recordings by how their pitch distribution fits."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from .histogram import EPSILON, count_peaks


@dataclass(frozen=True)
class Weights:
    """Fixed values of the score."""

    match: float = 0.40
    observed: float = 0.25
    likelihood: float = 1.0
    extra: float = 1.10
    complexity: float = 0.1
    size: float = 0.25
    band: float = 0.80
    drone: float = 0.20
    scale: float = 1000.0


def best_per_recording(rows: DataFrame, order: list[Column], n: int | None = None, name: str = "rank", partition: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return out.where(F.col(name) <= n) if n else out


#: Scales are a dimension: up to so many are broadcast, beyond Spark chooses.
BROADCAST_SCALES = 100_000


def hypotheses(dist: DataFrame, scales: DataFrame, tonics: list[int] | None = None) -> DataFrame:
    """(recording_id, scale_id, tonic) and sums over the scale's notes. dist: (recording_id, p), p the shares of the twelve
    notes; other columns stay. scales: (scale_id, mask); those of one note are no hypotheses.

    A recording's shares are turned to each tonic once; then every hypothesis is a row of its own, a sum of at most twelve
    products, without an aggregate or a shuffle. The few rows of the distribution become hundreds of times as many here, so
    they are dealt to all partitions first: by their size alone they would be coalesced.
    """
    n = int(dist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = [c for c in dist.columns if c != "p"]
    turned = dist.repartition(n, "recording_id").select(*keep, "p", F.array_max("p").alias("most"), F.explode(F.array(*[F.lit(t) for t in (range(12) if tonics is None else tonics)])).alias("tonic"))
    at = lambda i: F.get("p", (F.col("tonic") + i) % 12)
    turned = turned.select(*keep, "most", "tonic", *[at(i).alias(f"q{i}") for i in range(12)], *[F.log(at(i) + EPSILON).alias(f"l{i}") for i in range(12)])
    on = [F.get("mask", F.lit(i)).cast("int").alias(f"m{i}") for i in range(12)]
    size = F.aggregate("mask", F.lit(0), lambda s, x: s + x.cast("int"))
    masks = scales.select("scale_id", size.cast("long").alias("size"), *on).where("size >= 2")
    met = turned.crossJoin(F.broadcast(masks) if masks.count() <= BROADCAST_SCALES else masks)
    total = lambda x: reduce(add, [F.col(f"m{i}") * F.col(f"{x}{i}") for i in range(12)])
    drone = F.greatest(*[F.col(f"m{i}") * F.col(f"q{i}") for i in (5, 6, 7)])
    sums = [total("q").alias("match_mass"), total("l").alias("loglike"), (F.col("m0") * F.col("q0")).alias("p0"), drone.alias("p_drone")]
    return met.select(*keep, "scale_id", "tonic", "size", "most", *sums)


def shares(profile: DataFrame) -> DataFrame:
    """The profiles of recordings with p, the shares of the twelve notes' masses, and n_peaks."""
    total = F.aggregate("mass_", F.lit(0).cast("long"), lambda s, x: s + x)
    rows = profile.withColumnRenamed("mass", "mass_")
    p = F.transform("mass_", lambda x: (x + EPSILON) / (total + 12 * EPSILON))
    return rows.select("recording_id", p.alias("p"), "counts", "band", count_peaks("cells").alias("n_peaks"))


def score(hyp: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Adds the score's columns to hypotheses with n_peaks, the recording's detected peaks."""
    k = F.col("size")
    rows = hyp.withColumn("extra_mass", 1 - F.col("match_mass")).withColumn("observed", F.col("match_mass") / k / (F.col("most") + EPSILON))
    rows = rows.withColumn("loglike_norm", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + (F.col("loglike") / (k + EPSILON)) / (math.log(12) + EPSILON))))
    rows = rows.withColumn("complexity", F.greatest(F.lit(0.0), (k - 5) / 12)).withColumn("size_penalty", w.size * F.abs(k - F.col("n_peaks")) / 4)
    rows = rows.withColumn("primary", F.col("p0") + F.greatest(F.lit(0.0), "p_drone"))
    fit = w.match * F.col("match_mass") + w.observed * F.col("observed") + w.likelihood * F.col("loglike_norm") - (w.extra * F.col("extra_mass") + w.complexity * F.col("complexity") + F.col("size_penalty"))
    return rows.withColumn("fit_raw", fit)


def boost(scored: DataFrame, drone: bool = False, w: Weights = Weights()) -> DataFrame:
    """Adds up, fit and salience to hypotheses with band, the frames of each note in a band, and, with ``drone``, those of an
    accompaniment: the tonic's share of the band, and the shares of the tonic and its fifth of the accompaniment; clipped to 1
    either way, so that high scores tie."""
    at = lambda c, i: F.get(c, (F.col("tonic") + i) % 12)
    share = lambda c, i: at(c, i) / (F.array_max(c) + EPSILON)
    up = w.band * share("band", 0)
    if drone:
        up = up + F.coalesce(w.drone * (share("drone", 0) + share("drone", 7)), F.lit(0.0))
    rows = scored.withColumn("up", up)
    raw = F.col("fit_raw") + F.col("up")
    return rows.withColumn("fit", w.scale * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).withColumn("salience", at("band", 0))


def bits(on: Callable[[int], Column]) -> Column:
    """Twelve conditions as a number of twelve bits."""
    return reduce(add, [F.when(on(i), F.lit(1 << i)).otherwise(0) for i in range(12)])


def low_notes(found: DataFrame) -> DataFrame:
    """(recording_id, p, low): the notes of recordings that lie in a valley, but for the ``n_peaks`` most frequent ones, as bits. Needs
    p, counts and dips, the twelve flags."""
    order = F.reverse(F.array_sort(F.transform("counts", lambda x, i: F.struct(x.alias("n"), i.alias("pc")))))
    tops = F.transform(F.slice(order, 1, F.greatest(F.col("n_peaks"), F.lit(0))), lambda x: x["pc"])
    rows = found.select("recording_id", "p", "dips", tops.alias("_tops"))
    return rows.select("recording_id", "p", bits(lambda i: F.get("dips", F.lit(i)) & ~F.array_contains("_tops", i)).alias("low"))


def valleys(hyp: DataFrame) -> DataFrame:
    """Adds valley_penalty to hypotheses with on, the scale's notes as bits, and low (``low_notes``): how many notes are in both, once
    the low ones are turned to the tonic. There are hundreds of hypotheses for each recording, so they meet as numbers."""
    turned = F.call_function("shiftright", "low", "tonic").bitwiseOR(F.call_function("shiftleft", "low", 12 - F.col("tonic")))
    return hyp.withColumn("valley_penalty", F.bit_count(turned.bitwiseAND(F.col("on"))).cast("int"))


def saturated(boosted: DataFrame, places: int = 9) -> DataFrame:
    """(recording_id, scale_id, tonic, raw): the hypotheses whose score before it is clipped lies beyond 1, to ``places``.

    They are told apart by a generator: a filter would be pushed down to the hypotheses, and a score with all its sums worked out
    anew there, for each of its uses. Only scores close to 1 or beyond are rounded.
    """
    rows = boosted.select("recording_id", "scale_id", "tonic", (F.col("fit_raw") + F.col("up")).alias("_raw"))
    beyond = (F.abs("_raw") > 1 - 10.0 ** (1 - places)) & (F.abs(F.round("_raw", places)) > 1)
    return rows.select("recording_id", "scale_id", "tonic", F.explode(F.when(beyond, F.array("_raw"))).alias("raw"))


def turned_vectors(rows: DataFrame, melody: str, accompaniment: str) -> DataFrame:
    """(recording_id, tonic, melody, accompaniment): twelve shares each, to six places, from each tonic on."""
    total = F.aggregate(accompaniment, F.lit(0).cast("long"), lambda s, x: s + x)
    shares = F.when(total > 0, F.transform(accompaniment, lambda x: x / total)).otherwise(F.array_repeat(F.lit(0.0), 12))
    each = rows.select("recording_id", F.col(melody).alias("p"), shares.alias("a"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("tonic"))
    text = lambda c: F.array_join(F.transform(A.roll(c, "tonic"), lambda x: F.round(x, 6).cast("decimal(9,6)").cast("string")), ",")
    return each.select("recording_id", "tonic", text("p").alias("melody"), text("a").alias("accompaniment"))


def by_intervals(notes: DataFrame, scales: DataFrame) -> DataFrame:
    """(recording_id, tonic, scale_id, steps) of recordings' notes (recording_id, pcs): the scales whose intervals, from their first
    note on, are those between the recording's notes from the tonic on. Sets of notes are numbers of twelve bits: turned to its
    tonic a recording's is the scale's own, so they meet in an equi-join."""
    turn = lambda b, i: F.shiftright(b, i).bitwiseOR(F.shiftleft(b, 12 - i)).bitwiseAND(F.lit(4095))
    sets = notes.select("recording_id", bits(lambda i: F.array_contains("pcs", i)).alias("_bits")).where("_bits > 0")
    each = F.array(*[F.struct(F.lit(i).alias("tonic"), turn(F.col("_bits"), i).alias("_set")) for i in range(12)])
    turned = sets.select("recording_id", F.inline(F.filter(each, lambda x: x["_set"].bitwiseAND(F.lit(1)) == 1)))
    steps = F.filter(F.transform("mask", lambda on, i: F.when(on == 1, i)), lambda i: i.isNotNull())
    known = scales.select("scale_id", F.array_join(F.transform(steps, lambda x: x.cast("string")), ",").alias("steps"), F.size(steps).alias("k"), F.array_min(steps).alias("_first"), bits(lambda i: F.get("mask", F.lit(i)) == 1).alias("_bits"))
    own = reduce(lambda rest, i: F.when(F.col("_first") == i, turn(F.col("_bits"), i)).otherwise(rest), range(12), F.col("_bits"))
    known = known.where("k >= 2").select("scale_id", "steps", own.alias("_set"))
    return turned.join(known, "_set").select("recording_id", "tonic", "scale_id", "steps")


def ranked(boosted: DataFrame, n: int | None = None) -> DataFrame:
    """Ties: primary, salience, then scale and tonic. Scores are compared to nine digits, so that sums in another order rank alike."""
    return best_per_recording(boosted, [F.round("fit", 6).desc(), F.round("primary", 9).desc(), F.col("salience").desc(), F.col("scale_id"), F.col("tonic")], n)
