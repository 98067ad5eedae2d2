"""The three commands as plans: each returns lazy DataFrames by name, and only those asked for are computed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import frames as O
from ..operators import histogram as H
from ..operators import ngrams as G
from ..operators import phrases as P
from ..operators import scoring as C
from ..sources.adapters import UNIT


@dataclass(frozen=True)
class Settings:
    confidence: float = 0.0
    band: tuple[float, float] = (100.0, 300.0)
    top: int = 20
    gradient: float = 60.0
    least_event: float = 0.0
    merge: tuple[float, float, float, float] = (0.7, 0.1, 0.18, 0.12)
    phrase_gap: float = 0.5
    least_notes: int = 2
    silence: tuple[float, float] = (0.1, 0.25)
    lambdas: list[float] = field(default_factory=lambda: [0.2, 0.3, 0.5])
    add: float = 0.01


def detect(frames: DataFrame, scales: DataFrame, s: Settings = Settings(), accompaniment: DataFrame | None = None, tonics: list[int] | None = None) -> dict[str, DataFrame]:
    """Frames to ranked hypotheses (scale, tonic). The scales are filtered before they meet the recordings, and a recording's
    rows stay in its partition from the distribution to the rank."""
    f = O.rethreshold(frames, s.confidence)
    found = C.shares(H.profile(f, s.band))
    if accompaniment is not None:
        drone = H.profile(accompaniment).select("recording_id", F.col("counts").alias("drone"))
        found = found.join(drone, "recording_id", "left")
    scored = C.boost(C.score(C.hypotheses(found, scales, tonics)), accompaniment is not None)
    return {"profiles": found, "candidates": C.ranked(scored, s.top)}


def analyse(frames: DataFrame, s: Settings = Settings(), scale: list[int] | None = None, tonic: int = 0) -> dict[str, DataFrame]:
    """Frames to notes, phrases and their statistics: stationary events and the turns outside them, merged, cut at gaps and at
    silences, and snapped to a scale if one is given."""
    f = O.rethreshold(frames, s.confidence)
    rows = O.events_and_turns(f, s.gradient, s.least_event)
    rows = rows.withColumn("note_id", F.row_number().over(Window.partitionBy("recording_id").orderBy("start", "end", "midi")).cast("long"))
    notes = P.merge_notes(rows, *s.merge)
    notes = notes.withColumn("start_us", F.round(F.col("start") * UNIT).cast("long")).withColumn("end_us", F.round(F.col("end") * UNIT).cast("long")).withColumn("pc", E.pitch_class("midi"))
    cut = P.split_in_order(P.gap_phrases(notes, s.phrase_gap), P.silences(f, *s.silence)).withColumn("phrase", F.dense_rank().over(Window.partitionBy("recording_id").orderBy("phrase", "part"))).drop("part")
    phrases = P.phrase_bounds(cut).where(F.col("notes") >= s.least_notes)
    out = {"notes": cut, "phrases": phrases, "transitions": P.transition_probabilities(P.transitions(cut, ["phrase"])), "clusters": P.clusters(P.intervals(cut))}
    return out | ({"snapped": P.snap_to_scale(notes, scale, tonic)} if scale else {})


def evaluate(tokens: DataFrame, order: int = 3, s: Settings = Settings()) -> dict[str, DataFrame]:
    """Tokens (recording_id, class, seq, start_us, note_id, token) to leave-one-out scores of every class, ranks and a summary. The
    corpus is counted once; a recording's own counts are taken off where it is scored."""
    grams = G.windowed_ngrams(tokens, ["recording_id", "class", "seq"], ["start_us", "note_id"], "token", 1, order)
    counted = G.counts(grams, ["class"])
    totals = counted.where("n = 1").groupBy("class").agg(F.sum("cnt").alias("tokens"))
    vocabulary = max(1, counted.where("n = 1").select("ngram").distinct().count())
    paths = G.windowed_paths(tokens, ["recording_id", "class", "seq"], ["start_us", "note_id"], "token", order)
    known = paths.groupBy("recording_id", "path").agg(F.count("*").alias("times"))
    own = G.own_paths(known, counted, totals, G.counts(grams, ["recording_id", "class"]), vocabulary, order, s.lambdas, s.add)
    scores = G.score_recordings(paths, G.score_paths(paths, counted, totals, vocabulary, order, s.lambdas, s.add), own)
    w = Window.partitionBy("recording_id").orderBy(F.round("logprob", 6).desc(), "class")
    ranks = scores.withColumn("rank", F.row_number().over(w))
    own = ranks.join(tokens.select("recording_id", "class").distinct(), ["recording_id", "class"], "left_semi")
    summary = own.agg(F.round(F.avg((F.col("rank") == 1).cast("int")), 4).alias("top1"), F.round(F.avg((F.col("rank") <= 3).cast("int")), 4).alias("top3"), F.round(F.avg(1 / F.col("rank")), 4).alias("mrr"), F.count("*").alias("recordings"))
    return {"counts": counted, "ranks": ranks, "summary": summary}
