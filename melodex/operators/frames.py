"""Operators on frames: filters, derivatives, runs, interpolation, as-of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.adapters import by_time


def voiced(frames: DataFrame) -> DataFrame:
    return frames.where("pitch_hz > 0 and voicing")


def rethreshold(frames: DataFrame, least: float) -> DataFrame:
    return frames.withColumn("voicing", F.col("voicing") & (F.col("confidence") >= least))


def time_window(frames: DataFrame, first: float | None = None, last: float | None = None) -> DataFrame:
    """The first or last seconds of each recording: from start on, before end."""
    w = Window.partitionBy("recording_id")
    rows = frames.withColumn("_t0", F.min("t").over(w)).withColumn("_t1", F.max("t").over(w))
    if first is not None:
        rows = rows.where(F.col("t") < F.col("_t0") + first)
    if last is not None:
        rows = rows.where(F.col("t") >= F.greatest(F.col("_t0"), F.col("_t1") - last))
    return rows.drop("_t0", "_t1")


def band(frames: DataFrame, low: float, high: float) -> DataFrame:
    return voiced(frames).where((F.col("pitch_hz") >= low) & (F.col("pitch_hz") < high))


def midi_or_zero(frames: DataFrame) -> DataFrame:
    """Pitch with unvoiced frames as zero: their edges have large gradients."""
    return frames.withColumn("midi", F.when(F.col("voicing"), E.hz_to_midi("pitch_hz")).otherwise(0.0))


def gradient(rows: DataFrame, value: str, name: str = "gradient") -> DataFrame:
    """Second-order differences for uneven steps; one-sided at the ends."""
    w, v, t = by_time(), F.col(value), F.col("t")
    near = {"_before": F.lag(value).over(w), "_after": F.lead(value).over(w), "_hs": t - F.lag("t").over(w), "_hd": F.lead("t").over(w) - t}
    before, after, hs, hd = map(F.col, near)  # columns: an expression used many times would be as many window functions
    inner = (hs * hs * after + (hd * hd - hs * hs) * v - hd * hd * before) / (hs * hd * (hd + hs))
    return rows.withColumns(near).withColumn(name, F.when(before.isNull(), (after - v) / hd).when(after.isNull(), (v - before) / hs).otherwise(inner)).drop(*near)


def derivative(rows: DataFrame, value: str, name: str = "derivative") -> DataFrame:
    """Size of the first difference; zero for the first row."""
    w = by_time()
    step = F.col("t") - F.lag("t").over(w)
    return rows.withColumn(name, F.coalesce(F.abs(F.try_divide(F.col(value) - F.lag(value).over(w), step)), F.lit(0.0)))


def islands(rows: DataFrame, flag: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of rows where ``flag`` holds; null elsewhere."""
    w = by_time()
    rows = rows.withColumn("_f", F.coalesce(flag, F.lit(False)))
    begins = F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))
    return rows.withColumn("_b", begins.cast("int")).withColumn(name, F.when(F.col("_f"), F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_f", "_b")


def with_next(frames: DataFrame) -> DataFrame:
    """Adds midi, gradient and the time of the next frame, the last one's own."""
    return gradient(midi_or_zero(frames), "midi").withColumn("next_t", F.coalesce(F.lead("t").over(by_time()), F.col("t")))


def is_still(most: float) -> Column:
    return F.col("voicing") & (F.abs("gradient") < most)


def stationary_events(frames: DataFrame, most: float, least_duration: float) -> DataFrame:
    """Runs of voiced frames with a small gradient: (recording_id, run, start, end, midi, energy). A run ends at the time of
    the first frame after it."""
    runs = islands(with_next(frames), is_still(most)).where("run is not null")
    out = runs.groupBy("recording_id", "run").agg(F.min("t").alias("start"), F.max("next_t").alias("end"), F.median("midi").alias("midi"), F.avg("energy").alias("energy"), F.count("*").alias("frames"))
    return out.where(F.col("end") - F.col("start") >= least_duration)


def sign() -> Column:
    return F.when(F.col("voicing"), F.signum("gradient"))


def inflections(frames: DataFrame) -> DataFrame:
    """Frames where the gradient's sign changes before the next; unvoiced frames have no sign."""
    rows = gradient(midi_or_zero(frames), "midi").withColumn("sign", sign())
    return rows.withColumn("next_sign", F.lead("sign").over(by_time())).where("sign != next_sign")


def events_and_turns(frames: DataFrame, most: float, least_duration: float) -> DataFrame:
    """(recording_id, start, end, midi, energy): the stationary events, and as points the inflections outside their closed spans.

    The frames are dealt out and sorted once, and a recording's rows stay in its partition: each row left belongs to its run or
    is a point of its own. Medians are read off sorted rows, and a point is held against the latest end of the events that have
    begun. Rows without a recording are in no event's span.
    """
    w = by_time()
    rows = with_next(frames).withColumn("sign", sign()).withColumn("_other", ~F.coalesce(is_still(most), F.lit(False)))
    others = F.sum(F.col("_other").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))  # the same within a run
    rows = rows.withColumns({"next_sign": F.lead("sign").over(w), "_i": F.row_number().over(w), "_others": others}).withColumn("run", F.when(~F.col("_other"), F.col("_others")))
    if least_duration > 0:
        run = Window.partitionBy("recording_id", "run")
        rows = rows.withColumn("run", F.when(F.max("next_t").over(run) - F.min("t").over(run) >= least_duration, F.col("run")))
    alone = F.col("run").isNull()
    rows = rows.where(~alone | (F.col("sign") != F.col("next_sign"))).withColumn("_i", F.when(alone, F.col("_i"))).withColumn("end", F.when(alone, F.col("t")).otherwise(F.col("next_t")))
    by = ["recording_id", "run", "_i"]
    each, k, n = Window.partitionBy(*by), F.col("_k"), F.col("_n")
    rows = rows.withColumn("_k", F.row_number().over(each.orderBy("midi"))).withColumn("_n", F.count("*").over(each))
    median = 0.5 * F.max(F.when(k == F.floor((n + 1) / 2), F.col("midi"))) + 0.5 * F.max(F.when(k == F.floor(n / 2) + 1, F.col("midi")))
    out = rows.groupBy(*by).agg(F.min("t").alias("start"), F.max("end").alias("end"), median.alias("midi"), F.avg("energy").alias("energy"))
    through = F.max(F.when(~alone, F.col("end"))).over(Window.partitionBy("recording_id").orderBy("start"))
    outside = F.col("recording_id").isNull() | F.col("_through").isNull() | (F.col("_through") < F.col("start"))
    return out.withColumn("_through", through).where(~alone | outside).select("recording_id", "start", "end", "midi", "energy")


def interpolate(rows: DataFrame, value: str, name: str = "filled") -> DataFrame:
    """Fills nulls on a line between neighbours by row number, flat beyond the ends."""
    w = by_time()
    rows = rows.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.struct("_i", F.col(value).alias("v")))
    rows = rows.withColumn("_p", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.try_divide(F.col("_i") - F.col("_p._i"), F.col("_n._i") - F.col("_p._i"))
    return rows.withColumn(name, F.coalesce(F.col(value), line, F.col("_p.v"), F.col("_n.v"))).drop("_i", "_p", "_n")


def asof_nearest(points: DataFrame, frames: DataFrame, value: str) -> DataFrame:
    """For points (recording_id, point_id, t_us) the value of the nearest frame in time; of two as near, the earlier.

    One pass over the union in time order, no range join: the last frame up to the point and the first from it on.
    """
    left = points.select("recording_id", "t_us", F.lit(None).cast("double").alias("v"), "point_id", F.lit(None).cast("long").alias("at"))
    right = frames.select("recording_id", "t_us", F.col(value).alias("v"), F.lit(None).cast("long").alias("point_id"), F.col("t_us").alias("at"))
    seen = F.when(F.col("at").isNotNull(), F.struct("at", "v"))
    w = Window.partitionBy("recording_id").orderBy("t_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("recording_id").orderBy("t_us").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = left.unionByName(right).withColumn("before", F.max(seen).over(w)).withColumn("after", F.min(seen).over(back)).where("point_id is not null")
    use_before = F.col("after").isNull() | (F.col("t_us") - F.col("before.at") <= F.col("after.at") - F.col("t_us"))
    return rows.select("recording_id", "point_id", F.when(F.col("before").isNotNull() & use_before, F.col("before.v")).otherwise(F.col("after.v")).alias(value))


def mode_in_rows(frames: DataFrame, each: int) -> DataFrame:
    """The commonest rounded pitch in a window of rows to either side; of those as common, the least."""
    rows = voiced(frames).withColumn("pitch", E.half_even(E.hz_to_midi("pitch_hz")).cast("int"))
    near = F.collect_list("pitch").over(by_time().rowsBetween(-each, each))
    counted = F.transform(F.array_distinct("near"), lambda x: F.struct((-F.size(F.filter("near", lambda y: y == x))).alias("n"), x.alias("pitch")))
    return rows.withColumn("near", near).withColumn("snapped", F.array_min(counted).getField("pitch")).drop("near")
