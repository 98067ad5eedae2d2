"""Further scoring parts, sweeps and statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.arrays import gaussian_kernel
from ..sources.adapters import by_time
from .histogram import EPSILON


def drone_boost(counts: DataFrame, weight: float = 0.2) -> DataFrame:
    """(recording_id, tonic, boost): the shares of a note and of its fifth in the accompaniment's counts (recording_id, pc, n)."""
    s = counts.withColumn("s", F.col("n") / (F.max("n").over(Window.partitionBy("recording_id")) + EPSILON))
    pair = s.select("recording_id", F.col("pc").alias("tonic"), "s").unionAll(s.select("recording_id", F.pmod(F.col("pc") - 7, F.lit(12)), "s"))
    return pair.groupBy("recording_id", "tonic").agg((weight * F.sum("s")).alias("boost"))


def _places(voiced: DataFrame, off: int, sigma: float) -> DataFrame:
    """(recording_id, pc, lo, mid, hi): the smoothed 1-cent histogram at each note and ``off`` cents to its sides.

    Only 36 places of the smoothed histogram are asked for, so each cent meets those in reach of the kernel: a table of fixed
    size (36 times the kernel), broadcast.
    """
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    reach = [((pc * 100 + side * off + o) % 1200, pc, side, kernel[o + r]) for pc in range(12) for side in (-1, 0, 1) for o in range(-r, r + 1)]
    k = voiced.sparkSession.createDataFrame(reach, "bin int, pc int, side int, w double")
    hist = voiced.groupBy("recording_id", F.floor(E.cents(E.hz_to_midi("pitch_hz"))).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    at = lambda side: F.round(F.coalesce(F.sum(F.when(F.col("side") == side, F.col("c") * F.col("w"))), F.lit(0.0)), 9)
    return hist.join(F.broadcast(k), "bin", "left").groupBy("recording_id", "pc").agg(at(-1).alias("lo"), at(0).alias("mid"), at(1).alias("hi"))


def valleys(voiced: DataFrame, off: int = 15, sigma: float = 5.0) -> DataFrame:
    """(recording_id, valleys, slopes): of the twelve notes, how many lie lower than the places ``off`` cents to both sides, or
    to one."""
    places = _places(voiced, off, sigma)
    lower = lambda side: F.col("mid") < F.col(side)
    return places.groupBy("recording_id").agg(F.count_if(lower("lo") & lower("hi")).alias("valleys"), F.count_if(lower("lo") | lower("hi")).alias("slopes"))


def dips(voiced: DataFrame, off: int = 15, sigma: float = 5.0) -> DataFrame:
    """(recording_id, dips): for each of the twelve notes whether it lies lower than the places to both its sides."""
    low = F.bool_or((F.col("mid") < F.col("lo")) & (F.col("mid") < F.col("hi")))
    at = lambda i: F.coalesce(F.bool_or(F.when(F.col("pc") == i, F.col("low"))), F.lit(False))
    flags = _places(voiced, off, sigma).groupBy("recording_id", "pc").agg(low.alias("low"))
    return flags.groupBy("recording_id").agg(F.array(*[at(i) for i in range(12)]).alias("dips"))


def transition_activity(transitions: DataFrame) -> DataFrame:
    rows = transitions.select("recording_id", F.col("from_pc").alias("pc"), "n").unionAll(transitions.select("recording_id", "to_pc", "n"))
    return rows.groupBy("recording_id", "pc").agg(F.sum("n").alias("activity"))


def deletion_rates(notes: DataFrame, scale: list[int], slope: float, level: float) -> DataFrame:
    """The share of notes outside a scale, and what it is over the expected one. A note without a pitch is a note, but not outside.
    To six places of nine: halves, as of 128 notes, go up, not as the last bit of a difference has it."""
    six = lambda x: F.round(x.cast("decimal(18,9)"), 6).cast("double")
    rate = F.avg(F.coalesce(~F.col("pc").isin(scale), F.lit(False)).cast("double"))
    return notes.groupBy("recording_id").agg(six(rate).alias("rate"), six(rate - (slope * len(scale) + level)).alias("residual"))


def deletion_of_scales(notes: DataFrame, scales: DataFrame, key: str, slope: float, level: float, most: float = 1.0) -> DataFrame:
    """(recording_id, key, rate, residual): for each scale the share of a recording's notes further than ``most`` from all of the
    scale's, and what that is over the share expected of a scale of its size. Of a note only the steps that are near count, and few
    sets of steps are near at once: notes are counted by these before they meet the scales, a dimension."""
    place = E.cents("midi") / 100
    bit = lambda i: F.pow(F.lit(2), i).cast("int")
    near = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda s, i: s + F.when(F.round(E.circular_distance(place, i.cast("double"), 12.0), 9) <= most, bit(i)).otherwise(0))
    counted = notes.groupBy("recording_id", F.coalesce(near, F.lit(0)).alias("_near")).agg(F.count("*").alias("_n"))
    on = F.aggregate(F.transform("mask", lambda x, i: F.when(x == 1, bit(i)).otherwise(0)), F.lit(0), lambda s, x: s + x)
    size = F.aggregate("mask", F.lit(0), lambda s, x: s + x.cast("int"))
    met = counted.crossJoin(F.broadcast(scales.select(key, on.alias("_on"), size.alias("size"))))
    gone = F.sum(F.when(F.col("_near").bitwiseAND(F.col("_on")) == 0, F.col("_n")).otherwise(0))
    out = met.groupBy("recording_id", key).agg((gone / F.sum("_n")).alias("rate"), F.max("size").alias("size"))
    return out.select("recording_id", key, "rate", (F.col("rate") - (slope * F.col("size") + level)).alias("residual"))


def band_grid(voiced: DataFrame, lows: Iterable[int], widths: Iterable[int], gates: Iterable[int], best: int = 5) -> DataFrame:
    grid = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(lo + w).alias("hi"), F.lit(g).alias("gate")) for lo in lows for w in widths for g in gates])
    rows = voiced.select("recording_id", "pitch_hz", "confidence", F.inline(grid)).where("pitch_hz >= lo and pitch_hz < hi and confidence * 100 >= gate")
    c = rows.groupBy("lo", "hi", "gate", "recording_id", E.pitch_class(E.hz_to_midi("pitch_hz")).alias("pc")).agg(F.count("*").alias("n"))
    pick = c.groupBy("lo", "hi", "gate", "recording_id").agg(F.max_by("pc", F.struct("n", -F.col("pc"))).alias("pick"))
    a = pick.groupBy("lo", "hi", "gate").agg(F.count("*").alias("covered"), F.sum((F.col("pick") == F.col("recording_id") % 12).cast("long")).alias("correct"))
    w = Window.partitionBy("gate").orderBy(F.col("correct").desc(), F.col("hi") - F.col("lo"), "lo")
    return a.withColumn("place", F.row_number().over(w)).where(F.col("place") <= best)


def smooth_in_time(frames: DataFrame, value: str, sigma: float) -> DataFrame:
    """(frame_id, smooth): Gaussian smoothing over rows, mirrored at the ends (the end row twice), again and again where
    the kernel is longer than the recording. A weighted sum over a frame of rows, with the mirrored rows added near the ends."""
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    w = by_time()
    rows = frames.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("recording_id")))
    rows = rows.withColumn("_near", F.collect_list(value).over(w.rowsBetween(-r, r))).withColumn("_from", F.greatest(F.col("_i") - r, F.lit(0)))
    total = F.lit(0.0)
    for o, k in zip(range(-r, r + 1), kernel, strict=True):
        j = F.pmod(F.col("_i") + o, 2 * F.col("_n"))
        j = F.when(j >= F.col("_n"), 2 * F.col("_n") - 1 - j).otherwise(j)
        total = total + k * F.element_at("_near", (j - F.col("_from") + 1).cast("int"))
    return rows.select("frame_id", total.alias("smooth"))


def extremum_bounds(voiced: DataFrame, value: str) -> DataFrame:
    """(frame_id, low, high): for each local extremum the row numbers midway to the extrema before and after."""
    w = by_time()
    rows = voiced.withColumn("i", F.row_number().over(w)).withColumn("a", F.lag(value).over(w)).withColumn("b", F.lead(value).over(w))
    x = F.col(value)
    rows = rows.where(((x > F.col("a")) & (x > F.col("b"))) | ((x < F.col("a")) & (x < F.col("b"))))
    e = Window.partitionBy("recording_id").orderBy("i")
    mid = lambda other: F.floor((other + F.col("i")) / 2)
    return rows.select("frame_id", F.coalesce(mid(F.lag("i").over(e)), F.lit(1)).alias("low"), F.coalesce(mid(F.lead("i").over(e)), F.col("i")).alias("high"))


def calibrated(rows: DataFrame, group: str, score: str) -> DataFrame:
    """(group, threshold, kept): the least score from which on a group keeps no more rows than the smallest group has; null and
    0 if its highest score alone has more. Sums over the distinct scores from above."""
    known = rows.groupBy(group, score).agg(F.count("*").alias("c"))
    wanted = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n").alias("wanted"))
    above = Window.partitionBy(group).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = known.withColumn("kept", F.sum("c").over(above)).crossJoin(F.broadcast(wanted))  # of one row
    fits = F.col("kept") <= F.col("wanted")
    out = at.groupBy(group).agg(F.min(F.when(fits, F.col(score))).alias("threshold"), F.max(F.when(fits, F.col("kept"))).alias("kept"))
    return out.select(group, "threshold", F.coalesce("kept", F.lit(0)).alias("kept"))
