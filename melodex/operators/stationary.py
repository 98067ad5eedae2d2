"""Notes as stationary stretches of the voiced pitch, joined to the one before where their pitches are alike."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.adapters import by_time
from .phrases import chunks, walk

NOTES = "recording_id long, note long, start double, end double, midi double, pitch_hz double, confidence double, energy double, parts long"


def stretches(voiced: DataFrame, steepest: float, least: float, period: float) -> DataFrame:
    """(recording_id, start, end, midi, confidence, energy, frames): maximal runs of voiced frames whose pitch changes by less than
    ``steepest`` semitones a second from the voiced frame before; the first frame counts as still. A run lasts to the voiced frame
    after it (its last frame, at the end), ``least`` seconds at least; frames at one time are taken as a period apart."""
    w = by_time()
    midi, gap = E.hz_to_midi("pitch_hz"), F.col("t") - F.lag("t").over(w)
    rows = voiced.withColumn("_m", midi)
    slope = F.abs((F.col("_m") - F.lag("_m").over(w)) / F.when(gap == 0, period).otherwise(gap))
    rows = rows.withColumn("_still", F.coalesce(slope < steepest, F.lit(True))).withColumn("_after", F.coalesce(F.lead("t").over(w), F.col("t")))
    new = F.col("_still") & ~F.coalesce(F.lag("_still").over(w), F.lit(False))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_still")
    runs = rows.groupBy("recording_id", "_run").agg(F.min("t").alias("start"), F.max("_after").alias("end"), F.median("_m").alias("midi"), F.avg("confidence").alias("confidence"), F.avg("energy").alias("energy"), F.count("*").alias("frames"))
    return runs.where(F.col("end") - F.col("start") >= least)


def _joined(rows: Iterator[tuple], alike: float) -> Iterator[tuple]:
    last = None
    for recording, _, start, end, midi, confidence, energy, cut, n in rows:
        hz = 440 * 2 ** ((midi - 69) / 12)
        if last and not cut and abs(midi - last[4]) < alike:
            before, own = last[3] - last[2], end - start
            mean = (last[7] * before + energy * own) / (before + own) if before + own > 0 else energy
            last[3:] = [end, (last[4] + midi) / 2, hz, confidence, mean, last[8] + 1]
            continue
        if last:
            yield tuple(last)
        last = [recording, n if cut or not last else last[1] + 1, start, end, midi, hz, confidence, energy, 1]
    yield tuple(last)


def stationary_notes(voiced: DataFrame, steepest: float = 0.15, least: float = 0.1, alike: float = 0.3, period: float = 0.01) -> DataFrame:
    """(recording_id, note, start, end, midi, pitch_hz, confidence, energy, parts): stretches, each joined to the note before if its
    pitch is within ``alike`` of that one's. The joined note's pitch is midway between both, its energy their mean by length, its
    frequency and confidence those of the stretch that came last; note numbers the pieces' first stretches, in order.

    A note's pitch is never more than half of ``alike`` from its last stretch's. So where two stretches are one and a half times
    ``alike`` apart a new note begins whatever came before, and recordings are cut there.
    """
    w = Window.partitionBy("recording_id").orderBy("start", "end")
    rows = stretches(voiced, steepest, least, period)
    cut = F.coalesce(F.abs(F.col("midi") - F.lag("midi").over(w)) >= 1.5 * alike, F.lit(False))
    rows = chunks(rows.select("recording_id", "start", "end", "midi", "confidence", "energy", cut.alias("_cut"), (F.row_number().over(w) - 1).cast("long").alias("_n")), F.col("_cut"), w)
    return walk(rows, ["start", "end"], lambda x: _joined(x, alike), NOTES)
