"""Octave-folded distributions of pitch, and peaks in them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from ..functions import arrays as A
from ..functions import exprs as E
from ..sources.adapters import by_time
from .frames import voiced

EPSILON = 1e-12
NOTED = ArrayType(StructType().add("pc", IntegerType()).add("cent", DoubleType()).add("distance", DoubleType()))


def dense(keys: DataFrame, bins: int, name: str = "bin") -> DataFrame:
    """Every key with every bin."""
    return keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias(name))


def _on() -> Column:
    return F.col("voicing") & (F.col("pitch_hz") > 0)


def steps(frames: DataFrame) -> DataFrame:
    """(recording_id, step): the median step between a recording's first 50 frames, 1 if it has but one. Spark keeps no more than
    these 50 of each group ahead of the shuffle."""
    w = by_time()
    first = frames.select("recording_id", "t_us", "frame_id", "t").withColumn("_r", F.row_number().over(w)).where("_r <= 50")
    return first.withColumn("_dt", F.col("t") - F.lag("t").over(w)).groupBy("recording_id").agg(F.coalesce(F.median("_dt"), F.lit(1.0)).alias("step"))


def folded(frames: DataFrame, bins: int, weighted: bool = True, zeros: bool = True) -> DataFrame:
    """(recording_id, bin, count), with zeros, unless they are not asked for: voiced frames by their place in the octave. Where all frames of the recording are
    voiced they weigh their confidence times the median step between the first 50 frames (without it, if there is but one),
    unless ``weighted`` is off. Frames are added up by bins first; what they weigh is decided on the bins."""
    at = F.when(_on(), F.least(F.floor(E.cents(E.hz_to_midi("pitch_hz")) * bins / 1200), F.lit(bins - 1)).cast("int"))
    found = frames.groupBy("recording_id", at.alias("bin")).agg(F.count("*").alias("n"), F.sum("confidence").alias("sure"))
    on = found.where("bin is not null")
    if weighted:
        whole = found.groupBy("recording_id").agg(F.max(F.col("bin").isNull()).alias("off")).join(steps(frames), "recording_id")
        on = on.join(whole, "recording_id").select("recording_id", "bin", F.when(F.col("off"), F.col("n")).otherwise(F.col("sure") * F.col("step")).alias("count"))
    else:
        on = on.select("recording_id", "bin", F.col("n").cast("double").alias("count"))
    if not zeros:
        return on
    full = dense(on.select("recording_id").distinct(), bins)
    return full.join(on, ["recording_id", "bin"], "left").select("recording_id", "bin", F.coalesce("count", F.lit(0.0)).alias("count"))


def vectors(hist: DataFrame) -> DataFrame:
    """(recording_id, h): the counts as an array in the order of bins."""
    return hist.groupBy("recording_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "count"))), lambda x: x["count"]).alias("h"))


def twelve(rows: DataFrame, pc: Column, name: str) -> DataFrame:
    """(recording_id, pc, name): the rows of each of the twelve notes, with zeros, in one aggregate. A null note counts nowhere,
    but its recording is there."""
    sums = F.array(*[F.count(F.when(pc == i, 1)) for i in range(12)])
    return rows.groupBy("recording_id").agg(sums.alias("h")).select("recording_id", F.posexplode("h").alias("pc", name))


def window_mass(frames: DataFrame, half_width: float = 35.0) -> DataFrame:
    """(recording_id, pc, mass), with zeros: voiced frames whose whole cent is within half_width of a note."""
    cent = F.floor(E.cents(E.hz_to_midi("pitch_hz")))
    rows = voiced(frames).select("recording_id", F.pmod(cent + half_width, F.lit(1200.0)).alias("m"))
    return twelve(rows, F.when(F.col("m") % 100 < 2 * half_width, F.floor(F.col("m") / 100)), "mass")


def distribution(masses: DataFrame) -> DataFrame:
    """Adds p: the share of each note, never quite zero."""
    total = F.sum("mass").over(Window.partitionBy("recording_id"))
    return masses.withColumn("p", (F.col("mass") + EPSILON) / (total + 12 * EPSILON))


def pitch_class_counts(frames: DataFrame) -> DataFrame:
    """(recording_id, pc, n), with zeros."""
    rows = voiced(frames).select("recording_id", E.pitch_class(E.hz_to_midi("pitch_hz")).alias("p"))
    return twelve(rows, F.col("p"), "n")


def salience_survivors(counts: DataFrame) -> DataFrame:
    """Notes heard more than the mean over all twelve."""
    return counts.withColumn("mean", F.avg("n").over(Window.partitionBy("recording_id"))).where("n > mean")


def smoothed(hist: DataFrame, bins: int, sigma: float) -> DataFrame:
    return vectors(hist).withColumn("smooth", A.smooth_circular("h", bins, sigma))


def find_peaks(x: np.ndarray, prominence: float, distance: int) -> np.ndarray:
    """Interior local maxima (the middle of a plateau) of at least a prominence; of those nearer than distance, the higher."""
    rises = np.flatnonzero(np.diff(x, prepend=x[0]))  # where a new level begins
    starts = np.concatenate([[0], rises])
    ends = np.append(starts[1:], len(x)) - 1
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (starts[top] + ends[top]) // 2
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[i]:
            close = np.abs(peaks - peaks[i]) < distance
            close[i] = False
            keep[close] = False
    out = []
    for p in peaks[keep]:
        left, right = x[: p + 1][::-1], x[p:]
        wall_l, wall_r = np.flatnonzero(left > x[p]), np.flatnonzero(right > x[p])
        low_l = left[: wall_l[0] if len(wall_l) else None].min()
        low_r = right[: wall_r[0] if len(wall_r) else None].min()
        if x[p] - max(low_l, low_r) >= prominence:
            out.append(p)
    return np.array(out, int)


def _peaks_of(x: np.ndarray, share: float, distance: int, least: float, high_ends: bool) -> list[int]:
    x = np.round(x, 9)  # so that levels are equal however their sums were added up
    need, n = max(least, share * x.max()), len(x)
    found = set(find_peaks(x, need, distance).tolist())
    return sorted(found | {i for i in (0, n - 1) if x[i] > x[i - 1] and x[i] > x[(i + 1) % n] and (x[i] >= need or not high_ends)})


def peaks(vectors: DataFrame, column: str, share: float, distance: int, least: float = 0.0, high_ends: bool = True) -> DataFrame:
    """Adds peaks: the bins of the peaks of an array column, and either end where it tops both circular neighbours and, with
    ``high_ends``, the threshold. One vectorised call for each batch of recordings."""

    @F.pandas_udf("array<int>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([_peaks_of(np.asarray(v, float), share, distance, least, high_ends) for v in batch])

    return vectors.withColumn("peaks", run(column))


def validated_peaks(high: DataFrame, low: DataFrame, high_bins: int, low_bins: int, tolerance: float = 45.0) -> DataFrame:
    """High-resolution peaks near a low-resolution one (all, if there is none), nearest to each note: (recording_id, pc, cent, distance)."""
    centre = lambda i, n: (i + 0.5) * 1200 / n
    both = high.select("recording_id", F.col("peaks").alias("high")).join(low.select("recording_id", F.col("peaks").alias("low")), "recording_id")
    near = F.filter("high", lambda x: (F.size("low") == 0) | F.exists("low", lambda y: E.circular_distance(centre(x, high_bins), centre(y, low_bins)) <= tolerance))
    rows = both.select("recording_id", F.explode(near).alias("b")).withColumn("cent", centre(F.col("b"), high_bins))
    rows = rows.withColumn("pc", F.pmod(E.half_even(F.col("cent") / 100), F.lit(12)).cast("int")).withColumn("distance", E.circular_distance("cent", F.col("pc") * 100.0))
    best = F.row_number().over(Window.partitionBy("recording_id", "pc").orderBy("distance", "b"))
    return rows.withColumn("r", best).where("r = 1").select("recording_id", "pc", "cent", "distance")


def profile(frames: DataFrame, band: tuple[float, float] = (100.0, 300.0), half_width: float = 35.0) -> DataFrame:
    """(recording_id, mass, counts, band, cells): all that hypotheses need of a recording, in one pass over its frames.

    mass: of each of the twelve notes the voiced frames near it, as ``window_mass``; counts: those whose nearest note it is;
    band: the same of the frames in a frequency band; cells: (cent, low, weight), the frames by whole cents and by low bins,
    at most some 1,300 of a recording.
    """
    cent = E.cents(E.hz_to_midi("pitch_hz"))
    on = lambda c: F.when(_on(), c)
    keys = [on(F.floor(cent).cast("int")).alias("cent"), on(F.least(F.floor(cent * 33 / 1200), F.lit(32)).cast("int")).alias("low"), on(E.pitch_class(E.hz_to_midi("pitch_hz"))).alias("pc")]
    inside = (F.col("pitch_hz") >= band[0]) & (F.col("pitch_hz") < band[1])
    cells = frames.groupBy("recording_id", *keys).agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"), F.sum("confidence").alias("sure"))
    off = F.pmod(F.col("cent") + half_width, F.lit(1200.0))
    cells = cells.withColumn("near", F.when(off % 100 < 2 * half_width, F.floor(off / 100)))
    twelve_of = lambda note, n: F.array(*[F.sum(F.when(F.col(note) == i, F.col(n)).otherwise(0)) for i in range(12)])
    listed = F.collect_list(F.when(F.col("cent").isNotNull(), F.struct("cent", "low", "n", "sure")))
    found = cells.groupBy("recording_id").agg(twelve_of("near", "n").alias("mass"), twelve_of("pc", "n").alias("counts"), twelve_of("pc", "inside").alias("band"), listed.alias("cells"), F.max(F.col("cent").isNull()).alias("off"))
    weight = lambda x: F.when(F.col("off"), x["n"].cast("double")).otherwise(x["sure"] * F.col("step"))
    weighed = F.transform("cells", lambda x: F.struct(x["cent"].alias("cent"), x["low"].alias("low"), weight(x).alias("weight")))
    return found.where(F.size("cells") > 0).join(steps(frames), "recording_id").select("recording_id", "mass", "counts", "band", weighed.alias("cells"))


def _smooth_wrapped(x: np.ndarray, sigma: float) -> np.ndarray:
    kernel = np.array(A.gaussian_kernel(sigma))
    r = len(kernel) // 2
    return np.convolve(np.concatenate([x[-r:], x, x[:r]]), kernel, "valid")


def noted(high: list[int], low: list[int], high_bins: int = 100, low_bins: int = 33, tolerance: float = 45.0) -> list[tuple[int, float, float]]:
    """(pc, cent, distance) of the validated peaks of one recording, as ``validated_peaks`` finds them, by notes."""
    centre = lambda i, n: (np.asarray(i, float) + 0.5) * 1200 / n
    h, lo = centre(high, high_bins), centre(low, low_bins)
    if len(lo):
        apart = np.abs((h[:, None] - lo[None] + 600) % 1200 - 600)
        h = h[(apart <= tolerance).any(axis=1)]
    pc = np.rint(h / 100).astype(int) % 12
    away = np.abs((h - pc * 100.0 + 600) % 1200 - 600)
    best: dict[int, tuple[float, float]] = {}
    for p, c, a in zip(pc.tolist(), h.tolist(), away.tolist(), strict=True):
        best[p] = min(best.get(p, (a, c)), (a, c))
    return [(p, c, a) for p, (a, c) in sorted(best.items())]


def _noted_cells(cent: np.ndarray, low: np.ndarray, weight: np.ndarray) -> list[tuple[int, float, float]]:
    cent, low, weight = np.asarray(cent, int), np.asarray(low, int), np.asarray(weight, float)
    high = _smooth_wrapped(np.bincount(np.minimum(cent * 100 // 1200, 99), weight, 100), 0.8)
    coarse = np.bincount(low, weight, 33)
    return noted(_peaks_of(high, 0.01, 2, 1.0, True), _peaks_of(coarse, 0.03, 1, 0.0, True))


@F.pandas_udf(IntegerType())
def _count_noted(cent: pd.Series, low: pd.Series, weight: pd.Series) -> pd.Series:
    return pd.Series([len(_noted_cells(*x)) for x in zip(cent, low, weight, strict=True)], dtype="int32")


@F.pandas_udf(NOTED)
def _all_noted(cent: pd.Series, low: pd.Series, weight: pd.Series) -> pd.Series:
    named = lambda x: [{"pc": p, "cent": c, "distance": a} for p, c, a in x]
    return pd.Series([named(_noted_cells(*x)) for x in zip(cent, low, weight, strict=True)], dtype=object)


def _parts(cells: str) -> list[Column]:
    """Cells as three arrays of numbers, which go to Python as they lie in memory, not as an object for each cell."""
    return [F.col(f"{cells}.{k}") for k in ("cent", "low", "weight")]


def count_peaks(cells: str) -> Column:
    """How many notes the detected peaks of recordings make, by their cells (cent, low, weight)."""
    return _count_noted(*_parts(cells))


def detected_peaks(frames: DataFrame) -> DataFrame:
    """(recording_id, pc, cent, distance): the validated peaks of recordings' histograms, of 100 bins smoothed and of 33, both from
    the cells of one pass over the frames."""
    found = profile(frames).select("recording_id", _all_noted(*_parts("cells")).alias("notes"))
    return found.select("recording_id", F.inline("notes"))


def peak_counts(recordings: DataFrame, high: DataFrame, low: DataFrame, high_bins: int, low_bins: int, tolerance: float = 45.0, note_tolerance: float = 35.0, default: int = 7) -> DataFrame:
    """(recording_id, peaks): how many of the twelve notes have a high-resolution peak near them that lies near a
    low-resolution one on the line, not the circle; ``default`` for recordings without a histogram."""
    centre = lambda i, n: (i + 0.5) * 1200 / n
    both = high.select("recording_id", F.col("peaks").alias("high")).join(low.select("recording_id", F.col("peaks").alias("low")), "recording_id")
    near = F.filter("high", lambda x: F.exists("low", lambda y: F.abs(centre(x, high_bins) - centre(y, low_bins)) <= tolerance))
    note = F.transform(near, lambda b: F.floor(centre(b, high_bins) / 100 + 0.5))
    off = F.filter(F.arrays_zip(near.alias("b"), note.alias("n")), lambda x: F.abs(centre(x["b"], high_bins) - x["n"] * 100) <= note_tolerance)
    counted = both.select("recording_id", F.size(F.array_distinct(F.transform(off, lambda x: x["n"] % 12))).alias("n"))
    return recordings.join(counted, "recording_id", "left").select("recording_id", F.coalesce("n", F.lit(default)).alias("peaks"))


def gaussian_vector(found: DataFrame, column: str = "smooth", half_width: float = 75.0, samples: int = 1000, floor: float = 1e-6) -> DataFrame:
    """(recording_id, pc, height, deviation, sigma) of recordings with a smoothed histogram and its peaks: the histogram around a
    peak as some ``samples`` samples, a Gaussian's mean and spread of them; of the peaks nearest to a note the highest. Samples are whole numbers to three
    digits: levels are equal to nine only, so that what should be whole can be off by some 1e-6."""
    whole = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    rounded = F.transform(F.array(F.transform(column, lambda x: F.round(x, 9))), lambda v: F.named_struct(F.lit("v"), v, F.lit("sum"), whole(v)))  # the sum is taken once, not for each bin
    shares = F.transform(rounded, lambda r: F.transform(r["v"], lambda x: x / r["sum"]))[0]
    each = found.select("recording_id", shares.alias("v"), F.explode("peaks").alias("peak"))
    n, step = 100, 12.0
    away = lambda i: F.least(F.abs(i - F.col("peak")), n - F.abs(i - F.col("peak"))) * step
    near = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda x: away(x["i"]) <= half_width)
    each = each.withColumn("near", near).withColumn("mass", F.aggregate("near", F.lit(0.0), lambda s, x: s + x["v"]))
    scale = F.greatest(F.lit(1.0), F.floor(F.round(samples / F.greatest("mass", F.lit(1e-6)), 3)).cast("double"))
    rows = each.withColumn("scale", scale).select("recording_id", "peak", F.get("v", "peak").alias("height"), "scale", F.inline("near"))
    rows = rows.withColumn("k", F.greatest(F.lit(1.0), F.floor(F.round(F.col("v") * F.col("scale"), 3)).cast("double"))).withColumn("c", (F.col("i") + 0.5) * step)
    g = rows.groupBy("recording_id", "peak", "height").agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("c")) / F.sum("k")).alias("mu"), (F.sum(F.col("k") * F.col("c") * F.col("c")) / F.sum("k")).alias("m2")).where("n >= 5")
    at = (F.col("peak") + 0.5) * step
    g = g.withColumns({"pc": F.pmod(E.half_even(at / 100), F.lit(12)).cast("int"), "deviation": F.pmod(F.col("mu") - at + 600, F.lit(1200.0)) - 600, "sigma": F.sqrt(F.greatest(F.col("m2") - F.col("mu") * F.col("mu"), F.lit(0.0)) + floor)})
    best = F.row_number().over(Window.partitionBy("recording_id", "pc").orderBy(F.round("height", 9).desc(), "peak"))
    return g.withColumn("r", best).where("r = 1").select("recording_id", "pc", "height", "deviation", "sigma")


def gaussian_at(hist: DataFrame, peaks: DataFrame, bins: int, half_width: float = 75.0, floor: float = 1e-6) -> DataFrame:
    """For peaks (recording_id, cent) the mean, spread and deviation from the nearest note of the histogram around them."""
    cells = hist.select("recording_id", "bin", F.floor("count").alias("w")).where("w > 0")
    each = cells.join(peaks.groupBy("recording_id").agg(F.collect_set("cent").alias("_cents")), "recording_id")
    off = lambda cent: F.pmod((F.col("bin") + 0.5) * 1200 / bins - cent + 600, F.lit(1200.0)) - 600
    near = F.filter("_cents", lambda cent: F.abs(off(cent)) <= half_width)
    rows = each.select("recording_id", "bin", "w", F.explode(near).alias("cent")).withColumn("off", off(F.col("cent")))
    g = rows.groupBy("recording_id", "cent").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("off")) / F.sum("w")).alias("m"), (F.sum(F.col("w") * F.col("off") * F.col("off")) / F.sum("w")).alias("m2"))
    mean = F.col("cent") + F.col("m")
    return g.select("recording_id", "cent", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0)) + floor).alias("sigma"), (mean - 100 * E.half_even(mean / 100)).alias("deviation"))
