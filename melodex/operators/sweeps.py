"""Sweeps over bands of frequency, weights and gates: how often each setting finds the tonic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E

NO_FIT = -1000.0
KINDS = ("band_only", "band_allowed", "hist_only", "hist_allowed", "combined_only", "combined_allowed")


def bands(low: int, high: int, step: int, least: int) -> list[tuple[int, int]]:
    return [(lo, hi) for lo in range(low, high, step) for hi in range(lo + least, high + 1, step)]


def band_prefixes(frames: DataFrame, edges: list[int], gates: dict[str, Column]) -> DataFrame:
    """(recording_id, gate, prefixes): for each pitch class how many of a gate's frames lie between the first edge and each edge.

    Each frame falls into one slot between edges, whatever the number of bands, and is counted by partial sums; a band is then a
    difference of two prefixes. frames: (recording_id, pitch_hz, ...); gates: conditions on a frame.
    """
    slot = F.when(F.col("pitch_hz") < edges[-1], F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("pitch_hz"))))
    gate = F.filter(F.array(*[F.when(c, F.lit(g)) for g, c in gates.items()]), lambda x: x.isNotNull())
    rows = frames.select("recording_id", slot.alias("_slot"), E.pitch_class(E.hz_to_midi("pitch_hz")).alias("_pc"), F.explode(gate).alias("gate")).where("_slot > 0 and _pc is not null")
    counted = rows.groupBy("recording_id", "gate", "_pc", "_slot").agg(F.count("*").alias("_n"))
    each = F.map_from_entries(F.collect_list(F.struct((F.col("_pc") * len(edges) + F.col("_slot")).cast("int").alias("at"), "_n")))  # of twelve times the edges at most
    cells = counted.groupBy("recording_id", "gate").agg(each.alias("_m"))
    have = lambda i, s: F.coalesce(F.try_element_at("_m", (i * len(edges) + s).cast("int")), F.lit(0).cast("long"))
    through = lambda i: F.aggregate(F.sequence(F.lit(1), F.lit(len(edges) - 1)), F.array(F.lit(0).cast("long")), lambda sums, s: F.concat(sums, F.array(F.element_at(sums, -1) + have(i, s))))
    return cells.select("recording_id", "gate", F.transform(F.sequence(F.lit(0), F.lit(11)), through).alias("prefixes"))


def _best(score: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Of each row the first of the allowed tonics with the highest of twelve scores, NaN ones left out; -1 if there is none. A tonic that is not known is -2, which none is."""
    known = np.where(allowed & ~np.isnan(score), score, -np.inf)
    return np.where(np.isneginf(known.max(axis=1)), -1, known.argmax(axis=1))


def _found(tonic: np.ndarray, allowed: np.ndarray, fits: np.ndarray, through: list[np.ndarray], settings: list[tuple[int, int, float]], places: int) -> np.ndarray:
    """(gate, setting, count): how many of a block's recordings have frames in the band, and of each of KINDS how many are found.

    tonic: of each recording; allowed, fits: of each of its twelve tonics; through: for each gate its prefixes by tonic and edge;
    settings: (first edge, last edge, weight) by the edges' places.
    """
    every = np.ones_like(allowed)
    hits = lambda score: [int((_best(score, a) == tonic).sum()) for a in (every, allowed)]
    by_fit, filled, out = hits(np.round(fits, places)), np.where(np.isnan(fits), NO_FIT, fits), []
    for sums in through:
        for a, b, weight in settings:
            n = (sums[:, :, b] - sums[:, :, a]).astype(float)
            most = n.max(axis=1, keepdims=True)
            both = np.round(filled + weight * n / np.maximum(most, 1), places)
            out.append([int((most > 0).sum()), *hits(np.where(n > 0, n, np.nan)), *by_fit, *hits(both)])
    return np.array(out)


def sweep(recordings: DataFrame, prefixes: DataFrame, edges: list[int], gates: list[str], settings: list[tuple[int, int, float]], places: int = 9) -> DataFrame:
    """(gate, lo, hi, weight, total, band_frames, and of each of KINDS how many recordings it finds) of all settings and gates.

    recordings: (recording_id, tonic, allowed, fits): the true tonic, those allowed, and of each of the twelve the best fit or null.
    By band: the allowed tonic with the most frames in the band, if any has one; by hist: that of the best fit; combined: that of
    the best fit (``NO_FIT`` where there is none) plus weight times its share of the band's fullest note. Scores are rounded to
    ``places``; of equals the lowest tonic. ``only``: all twelve are allowed.

    A task goes through its recordings block by block, all settings over a block's arrays, and sends one row of counts for each
    setting, so no recording is multiplied by the settings.
    """
    wide = prefixes.groupBy("recording_id").pivot("gate", gates).agg(F.first("prefixes"))
    none = F.array_repeat(F.lit(0).cast("long"), 12 * len(edges))
    flat = [F.coalesce(F.flatten(f"`{g}`"), none).alias(f"g{i}") for i, g in enumerate(gates)]
    may = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.array_contains("allowed", i))
    no_fits = F.array_repeat(F.lit(None).cast("double"), 12)
    met = recordings.join(wide, "recording_id", "left").select(F.coalesce("tonic", F.lit(-2)).alias("tonic"), may.alias("may"), F.coalesce("fits", no_fits).alias("fits"), *flat)
    at = [(edges.index(lo), edges.index(hi), float(w)) for lo, hi, w in settings]
    width, names = len(edges), [f"g{i}" for i in range(len(gates))]

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums = 0, 0
        for x in blocks:
            if len(x):
                through = [np.stack(x[g].to_numpy()).reshape(-1, 12, width) for g in names]
                total += len(x)
                sums = sums + _found(x["tonic"].to_numpy(), np.stack(x["may"].to_numpy()).astype(bool), np.stack(x["fits"].to_numpy()).astype(float), through, at, places)
        if total:
            keys = pd.DataFrame([(g, lo, hi, float(w)) for g in gates for lo, hi, w in settings], columns=["gate", "lo", "hi", "weight"])
            yield pd.concat([keys.assign(total=total), pd.DataFrame(sums, columns=["band_frames", *KINDS])], axis=1)

    counted = met.mapInPandas(run, "gate string, lo int, hi int, weight double, total long, band_frames long, " + ", ".join(f"{k} long" for k in KINDS))
    return counted.groupBy("gate", "lo", "hi", "weight").agg(*[F.sum(c).alias(c) for c in ("total", "band_frames", *KINDS)])


def best_bands(swept: DataFrame, best: int = 5) -> DataFrame:
    """Of each gate and weight the best bands: those that find most combined, then by band alone, then the narrowest, then the first."""
    w = Window.partitionBy("gate", "weight").orderBy(F.col("combined_allowed").desc(), F.col("band_allowed").desc(), F.col("hi") - F.col("lo"), "lo", "hi")
    return swept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= best)


def best_weight(swept: DataFrame) -> DataFrame:
    """Of each gate and band the weight that finds most combined, the smallest of equals."""
    w = Window.partitionBy("gate", "lo", "hi").orderBy(F.col("combined_allowed").desc(), "weight")
    return swept.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
