"""Small fixtures for the rules that decide results: ties, rounding, anchors, edges."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from melodex.functions import arrays as A
from melodex.functions import exprs as E
from melodex.operators import catalog as C
from melodex.operators import frames as O
from melodex.operators import histogram as H
from melodex.operators import joins as J
from melodex.operators import ngrams as G
from melodex.operators import phrases as P
from melodex.operators import ranking as K
from melodex.operators import reports as T
from melodex.operators import segments as W
from melodex.sources import files
from melodex.sources.adapters import UNIT


def values(spark, expr, rows, schema="x double"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(expr).collect()]


def frames(spark, midi, step=0.1, energy=None, voicing=None):
    n = len(midi)
    rows = [(1, i, int(i * step * UNIT), i * step, 440 * 2 ** ((m - 69) / 12) if m else 0.0, 1.0, bool(m) if voicing is None else voicing[i], 1.0 if energy is None else energy[i]) for i, m in enumerate(midi)]
    assert n
    return spark.createDataFrame(rows, "recording_id long, frame_id long, t_us long, t double, pitch_hz double, confidence double, voicing boolean, energy double")


def notes(spark, rows):
    """(start, end, midi)"""
    full = [(1, i, round(s * UNIT), round(e * UNIT), float(s), float(e), float(m), round(m) % 12, 1.0) for i, (s, e, m) in enumerate(rows)]
    return spark.createDataFrame(full, "recording_id long, note_id long, start_us long, end_us long, start double, end double, midi double, pc int, energy double")


def test_rounding_is_half_even(spark):
    assert values(spark, E.half_even("x"), [60.5, 61.5, -0.5]) == [60, 62, 0]


def test_modulo_and_division_floor(spark):
    assert values(spark, E.pitch_class("x"), [-1.0, 12.0, -13.0]) == [11, 0, 11]
    assert values(spark, F.floor(F.col("x") / 12), [-1.0]) == [-1]


def test_token_octave_is_clipped(spark):
    assert values(spark, E.lm_token("x", F.lit(60)), [36.0, 59.0, 60.0, 72.0, 84.0]) == ["Sa'", "Ni'", "Sa", "Sa''", "Sa''"]


def test_labels(spark):
    assert values(spark, E.label("x", F.lit(0)), [48.0, 60.0, 47.0, 72.0, 35.9]) == ["Sa", "Sa·", "Ni'", "Sa··", "Sa''"]
    assert values(spark, E.label("x", F.lit(2)), [50.0, 49.6, 61.0]) == ["Sa", "Sa'", "Ni"]
    assert values(spark, E.event_label("x", F.lit(60)), [60.0, 54.0, 66.2, 67.0, 78.0, 48.0]) == ["Sa", "Ma", "Ma·", "Pa·", "Ma··", "Sa'"]
    assert values(spark, E.event_label("x", F.lit(61.5)), [61.5, 62.6, 67.0]) == ["Sa", "re", "Ma"]
    assert values(spark, E.label_step("x"), ["Re", "re", "Pa··", "no"], "x string") == [1, 1, 7, None]
    assert values(spark, E.plain_label("x"), [" Sa’", "Sa'", "Sa·`"], "x string") == ["Sa", "Sa'", "Sa"]


def test_hz_and_midi(spark):
    assert values(spark, E.hz_to_midi("x"), [440.0, 0.0, -1.0, float("inf"), float("nan")]) == [69.0, None, None, None, None]
    assert values(spark, E.midi_to_hz("x"), [69.0, 57.0]) == [440.0, 220.0]
    assert values(spark, E.snap("x"), [60.5, 60.6, -0.5]) == [60.0, 61.0, -1.0]
    assert values(spark, E.circular_distance("x", F.lit(10.0)), [1190.0, 610.0]) == [20.0, 600.0]


def test_names_and_cells(spark):
    assert values(spark, E.normal_name("x"), ["A (x) B-c_d", None], "x string") == ["a b c d", ""]
    assert values(spark, E.clock_seconds("x"), ["90", "1:30", "1:00:01", "-1", "1:2:3:4", "x"], "x string") == [90, 90, 3601, None, None, None]
    assert values(spark, E.name_list("x"), [None, "['A', B,, ]"], "x string") == [["Unknown"], ["A", "B"]]
    assert values(spark, E.truth("x"), ["Yes", " t ", "1.0", "0", None], "x string") == [True, True, True, False, None]
    assert values(spark, E.stem("x"), ["/a/B.c.CSV", "plain", ".hidden"], "x string") == ["b.c", "plain", ".hidden"]
    assert values(spark, E.safe_name("x"), ["..a b/c..", "ok"], "x string") == ["a_b_c", "ok"]
    assert values(spark, E.note_step("x"), ["C#", "Bb", "c", "H"], "x string") == [1, 10, None, None]
    assert values(spark, E.url_token("x"), ["a?>b"], "x string") == ["YT8-Yg"]


def test_roll_intervals_and_rotation(spark):
    row = spark.range(1).select(A.roll(F.sequence(F.lit(0), F.lit(11)), F.lit(5)).alias("r"), A.intervals(F.array(*[F.lit(int(i in (0, 4, 7))) for i in range(12)])).alias("i"))
    r = row.select("r", "i", A.canonical(F.col("i")).alias("c")).first()
    assert (r["r"][:2], r["i"], r["c"]) == ([5, 6], [4, 3, 5], [3, 5, 4])
    one = spark.range(1).select(A.intervals(F.array(F.lit(1), *[F.lit(0)] * 11)).alias("i")).first()
    assert one["i"] == [12]


def test_gap_is_strict(spark):
    n = notes(spark, [(0, 1, 60), (1.5, 2, 60)])
    assert [r["phrase"] for r in P.gap_phrases(n, 0.5).collect()] == [0, 0]
    later = n.withColumn("start_us", F.when(F.col("note_id") == 1, F.col("start_us") + 1).otherwise(F.col("start_us")))
    assert sorted(r["phrase"] for r in P.gap_phrases(later, 0.5).collect()) == [0, 1]


def test_merge_compares_with_the_anchor(spark):
    got = P.merge_notes(notes(spark, [(0, 1, 60.0), (1, 2, 60.5), (2, 3, 61.0)])).orderBy("start").collect()
    assert [(r["start"], r["end"], r["midi"]) for r in got] == [(0, 2, 60.0), (2, 3, 61.0)]


def test_dropouts_heal_only_beside_a_short_note(spark):
    assert P.merge_notes(notes(spark, [(0, 0.1, 60), (0.25, 1, 60)])).count() == 1
    assert P.merge_notes(notes(spark, [(0, 0.5, 60), (0.65, 1, 60)])).count() == 2


def test_snapping_ties(spark):
    snap = lambda ms: [r["snapped"] for r in P.snap_to_scale(notes(spark, [(i, i + 1, m) for i, m in enumerate(ms)]), [0, 2], 60).orderBy("start").collect()]
    assert snap([60.05, 61.0]) == [60, 60]
    assert snap([61.0]) == [62]
    assert snap([66.0]) == [None]
    n = notes(spark, [(i, i + 1, m) for i, m in enumerate([66.0, 61.0, 60.0])])
    far = P.snap_to_scale(n, [0, 2], 60, keep_far=True).orderBy("start").collect()
    assert [(r["snapped"], r["action"]) for r in far] == [(66.0, "unchanged_far"), (62.0, "corrected"), (60.0, "unchanged")]
    assert [r["action"] for r in P.snap_to_scale(n, [], 60).collect()] == ["unchanged_far"] * 3


def test_folds_do_not_depend_on_where_they_are_cut(spark, monkeypatch):
    """The same notes, phrases and choices whether a recording is one group or many."""
    rng = np.random.default_rng(5)
    at, rows = 0.0, []
    for _ in range(400):
        at += rng.choice([0.0, 0.05, 0.15, 0.4, 1.0])
        end = at + rng.choice([0.05, 0.1, 0.3])
        rows.append((at, end, float(rng.choice([60, 60.4, 61, 62, 63, 66]))))
        at = end
    n = notes(spark, rows)
    phrased = P.gap_phrases(n, 0.3)

    def all_of():
        tables = (P.merge_notes(n), P.merge_small_phrases(phrased, 4, 0.5), P.snap_to_scale(n, [0, 2, 4], 60), P.snap_to_scale(n, [0, 2, 4], 60, keep_far=True))
        return [sorted(map(str, t.collect())) for t in tables]

    whole = all_of()
    monkeypatch.setattr(P, "CHUNK", 3)
    assert all_of() == whole


def test_small_phrases_cascade(spark):
    def sizes(groups):
        n = notes(spark, [(i, i + 0.5, 60) for i in range(sum(groups))]).withColumn("phrase", F.lit(0))
        at = [p for p, g in enumerate(groups) for _ in range(g)]
        n = n.withColumn("phrase", F.element_at(F.array(*[F.lit(x) for x in at]), (F.col("note_id") + 1).cast("int")))
        got = P.merge_small_phrases(n, 3).groupBy("phrase").count().orderBy("phrase").collect()
        return [r["count"] for r in got]

    assert sizes([1, 1, 4]) == [6]
    assert sizes([4, 1]) == [5]
    assert sizes([1, 1]) == []


def test_window_mass_edges(spark):
    at = lambda c: 440 * 2 ** ((c / 100 - 9) / 12)
    for cent, pc in [(34.5, 0), (35.5, None), (65.5, 1), (64.5, None), (1165.5, 0)]:
        f = frames(spark, [60.0]).withColumn("pitch_hz", F.lit(at(cent)))
        assert [r["pc"] for r in H.window_mass(f).where("mass > 0").collect()] == ([] if pc is None else [pc])


def test_histogram_weights_need_all_frames_voiced(spark):
    f = frames(spark, [60.0, 60.0]).withColumn("confidence", F.lit(0.25))
    assert H.folded(f, 33).agg(F.sum("count")).first()[0] == pytest.approx(0.5 * 0.1)  # times the median step
    assert H.folded(f.where("frame_id = 0"), 33).agg(F.sum("count")).first()[0] == 0.25
    assert H.folded(f, 33, weighted=False).agg(F.sum("count")).first()[0] == 2.0
    g = frames(spark, [60.0, 60.0, 0]).withColumn("confidence", F.lit(0.25))
    assert H.folded(g, 33).agg(F.sum("count")).first()[0] == 2.0


def brute_peaks(x, prominence):
    out = []
    for i in range(1, len(x) - 1):
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            left = next((k for k in range(i, -1, -1) if x[k] > x[i]), -1)
            right = next((k for k in range(j, len(x)) if x[k] > x[i]), len(x))
            if x[i] - max(min(x[left + 1 : i + 1]), min(x[i:right])) >= prominence:
                out.append((i + j) // 2)
    return out


def test_peaks_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(0, 6, rng.integers(3, 40)).astype(float)
        assert H.find_peaks(x, 2.0, 1).tolist() == brute_peaks(x.tolist(), 2.0)
    assert H.find_peaks(np.array([0, 3, 0, 5, 0, 0, 4, 0.0]), 1, 3).tolist() == [3, 6]


def test_circular_edge_peak(spark):
    v = spark.createDataFrame([(1, [9.0, 1.0, 2.0, 1.0, 3.0])], "recording_id long, h array<double>")
    assert H.peaks(v, "h", 0.5, 1).first()["peaks"] == [0]


def test_gradient_of_uneven_steps(spark):
    f = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 1, 1, 1.0, 1.0), (1, 2, 3, 3.0, 9.0)], "recording_id long, frame_id long, t_us long, t double, v double")
    assert [r["gradient"] for r in O.gradient(f, "v").orderBy("t").collect()] == [1.0, 2.0, 4.0]


def test_unvoiced_neighbours_make_steep_edges(spark):
    rows = O.gradient(O.midi_or_zero(frames(spark, [60.0, 0, 60.0, 60.0, 60.0])), "midi").orderBy("t").collect()
    assert abs(rows[0]["gradient"]) > 500 and abs(rows[3]["gradient"]) < 1


def test_run_ends_at_the_next_frame(spark):
    e = O.stationary_events(frames(spark, [60.0] * 4 + [0] * 3), 100.0, 0.0).collect()
    assert [(round(r["start"], 6), round(r["end"], 6)) for r in e] == [(0.0, 0.3)]


def test_asof_tie_goes_to_the_earlier_frame(spark):
    f = spark.createDataFrame([(1, 0, 1.0), (1, 10, 2.0)], "recording_id long, t_us long, energy double")
    p = spark.createDataFrame([(1, 7, 5), (1, 8, 6), (1, 9, -3), (1, 10, 99)], "recording_id long, point_id long, t_us long")
    assert {r["point_id"]: r["energy"] for r in O.asof_nearest(p, f, "energy").collect()} == {7: 1.0, 8: 2.0, 9: 1.0, 10: 2.0}


def test_interpolation_by_row(spark):
    f = frames(spark, [1.0] * 6).withColumn("v", F.element_at(F.array(F.lit(None).cast("double"), F.lit(2.0), F.lit(None), F.lit(None), F.lit(8.0), F.lit(None)), (F.col("frame_id") + 1).cast("int")))
    assert [r["filled"] for r in O.interpolate(f, "v").orderBy("t").collect()] == [2, 2, 4, 6, 8, 8]


def test_turning_note_belongs_to_both_runs(spark):
    n = notes(spark, [(i, i + 1, m) for i, m in enumerate([60, 62, 62, 64, 62, 60])])
    got = P.monotone_runs(n, E.half_even("midi")).orderBy("run").collect()
    assert [(r["direction"], r["first"], r["rest"]) for r in got] == [(1, 60, [62, 64]), (-1, 64, [62, 60])]


def test_two_means_is_optimal(spark):
    rng = np.random.default_rng(2)
    gaps = {k: rng.random(12) * 5 for k in range(20)} | {20: np.array([0.1, 0.1])}
    rows = []
    for k, x in gaps.items():
        t = 0.0
        for i, g in enumerate([0.0, *x]):
            t += float(g)
            rows.append((k, i, round(t * UNIT), round((t + 1) * UNIT), t, t + 1))
            t += 1
    n = spark.createDataFrame(rows, "recording_id long, note_id long, start_us long, end_us long, start double, end double")
    got = {r[0]: r[1] for r in P.gap_thresholds(n, 0.3).collect()}
    for k in range(20):
        x = np.sort(gaps[k])
        cost = lambda j, x=x: ((x[:j] - x[:j].mean()) ** 2).sum() + ((x[j:] - x[j:].mean()) ** 2).sum()
        j = min(range(1, 12), key=cost)
        assert got[k] == pytest.approx((x[:j].mean() + x[j:].mean()) / 2)
    assert got[20] == 0.3


def test_windowed_ngrams_are_those_of_the_arrays(spark):
    rows = [(g, i, f"t{(g * i) % 5}") for g in range(4) for i in range(g * 2 + 1)]
    t = spark.createDataFrame(rows, "g long, i long, token string")
    for start in (True, False):
        want = G.ngrams(G.token_arrays(t, ["g"], ["i"], start=start), 1, 3).select("g", "n", "pos", "ngram")
        got = G.windowed_ngrams(t, ["g"], ["i"], start=start).select("g", "n", "pos", "ngram")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert G.parse_lambdas("5,3,2") == [0.2, 0.3, 0.5]


def test_silence_split(spark):
    n = P.gap_phrases(notes(spark, [(0, 1, 60), (2, 3, 60), (4, 5, 60)]), 10.0)
    quiet = spark.createDataFrame([(1, 0, 1.4, 1.6, 1.5), (1, 1, 6.0, 7.0, 6.5)], "recording_id long, run long, start double, end double, mid double")
    assert [r["part"] for r in P.split_by_silence(n, quiet).orderBy("note_id").collect()] == [0, 1, 1]


def model(spark, own=False):
    a = spark.createDataFrame([(1, 0, 0, ["<BOS>", "x", "y"]), (2, 1, 0, ["<BOS>", "x"])], "recording_id long, class long, seq long, tokens array<string>")
    g = G.ngrams(a, 1, 3)
    counted = G.counts(g, ["class"])
    totals = counted.where("n = 1").groupBy("class").agg(F.sum("cnt").alias("tokens"))
    return G.score_sequences(G.score_positions(g, counted, totals, 3, 3, [0.2, 0.3, 0.5], 0.1, G.counts(g, ["recording_id", "class"]) if own else None)), counted


def test_short_context_is_one_over_the_vocabulary(spark):
    scores, _ = model(spark)
    got = {(r["recording_id"], r["class"]): r["logprob"] for r in scores.collect()}
    p1 = lambda c, t: 0.2 * (c + 0.1) / (t + 0.3)
    first = p1(1, 2) + 0.3 * 1.1 / 1.3 + 0.5 / 3
    assert got[2, 1] == pytest.approx(math.log(first))
    second = p1(0, 2) + 0.3 * 0.1 / 0.3 + 0.5 * 0.1 / 0.3  # the context has no counts in that class
    assert got[1, 1] == pytest.approx(math.log(first) + math.log(second))


def test_leaving_out_is_subtraction(spark):
    scores, _ = model(spark, own=True)
    got = {(r["recording_id"], r["class"]): r["logprob"] for r in scores.collect()}
    assert got[2, 1] == pytest.approx(math.log(1 / 3))  # nothing is left of its class


def test_entropy_weights(spark):
    c = spark.createDataFrame([(0, 1, "a", 5), (1, 1, "a", 5), (0, 1, "b", 5)], "class long, n int, ngram string, cnt long")
    assert {r["ngram"]: r["weight"] for r in G.entropy_weights(c).collect()} == {"a": 0.5, "b": 1.0}


def test_support_counts_recordings(spark):
    g = spark.createDataFrame([(0, 1, "m")] * 2 + [(0, 2, "m"), (1, 3, "m")], "class long, recording_id long, ngram string")
    r = {x["class"]: x for x in G.motif_stats(g).collect()}
    assert (r[0]["support"], r[0]["occurrences"], r[0]["specificity"]) == (2, 3, pytest.approx(2 / 3))


def test_ranks(spark):
    rows = spark.createDataFrame([(1, 5.0, True), (1, 5.0, False), (1, 3.0, False), (2, 1.0, False), (2, 2.0, False), (3, 1.0, True), (3, 2.0, False)], "song long, score double, ok boolean")
    assert {r["song"]: r["rank"] for r in K.correct_ranks(rows, "song", "score", "ok").collect()} == {1: 1, 2: 3, 3: 2}
    assert sorted(r["rank"] for r in K.competition_rank(rows.where("song = 1"), "song", "score").collect()) == [1, 1, 3]


def test_ambiguous_names_match_nothing(spark):
    f = spark.createDataFrame([(1, "a", "a.csv"), (2, "a", "a.txt"), (3, "b", "b.csv")], "id long, stem string, base string")
    w = spark.createDataFrame([("a", "a.csv"), ("b", "x"), ("c", "a.txt"), ("d", "d")], "stem string, base string")
    got = {r["stem"]: (r["id"], r["match"]) for r in J.unique_match(w, f, ["stem", "base"], "id").collect()}
    assert got == {"a": (None, "ambiguous"), "b": (3, "stem"), "c": (2, "base"), "d": (None, "missing")}


def test_skyline_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(a), int(b)) for g, a, b in rng.integers(0, 6, (150, 3))]
    got = sorted(tuple(r) for r in J.skyline(spark.createDataFrame(rows, "g long, a long, b long"), ["g"], "a", "b").collect())
    assert got == sorted(r for r in rows if not any(o[0] == r[0] and o[1] >= r[1] and o[2] >= r[2] and o != r for o in rows))


def test_edits(spark):
    n = C.normal_notes(spark.createDataFrame([(1, 7, 0, 2.0, 1.0), (1, 7, 1, 5.0, 6.0), (1, 8, 2, 3.0, 3.0)], "song long, note_id long, pos long, start double, end double"))
    assert sorted((r["note_id"], r["start"], r["end"]) for r in n.collect()) == [(7, 1.0, 2.0), (8, 3.0, 3.001)]
    p = spark.createDataFrame([(1, "p1", [8]), (1, "p0", [8])], "song long, phrase string, note_ids array<long>")
    assert {r["note_id"]: r["phrase"] for r in C.owned(n, p).collect()} == {7: "auto-7", 8: "p0"}


def test_segments_step_by_half(spark):
    s = spark.createDataFrame([(1, i, 3) for i in range(6)], "recording_id long, phrase long, tokens long")
    found = W.segments(s, 10).orderBy("segment").collect()  # as long as a phrase is left to begin at
    assert [(r["first"], r["stop"], r["tokens"]) for r in found] == [(0, 4, 12), (2, 6, 12), (4, 6, 6), (5, 6, 3)]


def test_pairwise_weights_order_pairs(spark):
    rng = np.random.default_rng(0)
    p = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal([1.0, 0.0], 0.5, (300, 2))], "d_a double, d_b double")
    w = K.pairwise_weights(p, ["d_a", "d_b"])
    assert w[0] > 1 and abs(w[1]) < w[0] / 2


def test_results_do_not_depend_on_partitions(spark):
    f = frames(spark, [60.0, 61.2, 0, 64.0, 64.1, 59.0] * 20)
    for make in (lambda x: O.stationary_events(x, 60, 0.0), O.inflections, lambda x: H.distribution(H.window_mass(x))):
        rows = lambda x, make=make: sorted(map(str, make(x).collect()))
        assert rows(f) == rows(f.repartition(7)) == rows(f.orderBy(F.col("t").desc()).coalesce(1))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,F0,Conf\n0.0,440,0.5\n0.1,x,nan\n")
    rows = files.read_pitch(spark, str(tmp_path / "a.csv")).orderBy("t").collect()
    assert [(r["t"], r["pitch_hz"], r["confidence"], r["voicing"], r["energy"]) for r in rows] == [(0.0, 440.0, 0.5, True, 1.0), (0.1, 0.0, 0.0, False, 1.0)]
    (tmp_path / "l.csv").write_text("File Name,Label,Key\n/x/A.wav,c1,D\n")
    assert files.resolve(["File Name", "filename"], ("filename",)) == "File Name"
    r = files.read_labels(spark, str(tmp_path / "l.csv")).first()
    assert (r["stem"], r["class"], r["tonic"], r["gender"]) == ("a", "c1", "D", None)
    (tmp_path / "s.csv").write_text(",".join([*map(str, range(12)), "names"]) + "\n1,0,0,0,1,0,0,1,0,0,0,0,\"['One', 'Two']\"\n1" + ",0" * 11 + ",Thin\n")
    s = files.read_scales(spark, str(tmp_path / "s.csv")).collect()
    assert [(r["name"], r["names"], sum(r["mask"])) for r in s] == [("One", ["One", "Two"], 3)]
    files.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "x long, k string"), str(tmp_path / "out"), "k")
    assert spark.read.parquet(str(tmp_path / "out")).where("k = 'a'").count() == 1
    log = spark.createDataFrame([("k", 1, "old"), ("j", 1, "only")], "key string, at long, v string")
    assert {r["key"]: r["v"] for r in files.upsert_log(log, log.where("key = 'k'").selectExpr("key", "2L at", "'new' v"), ["key"], "at").collect()} == {"k": "new", "j": "only"}


def test_peak_counts_against_brute_force(spark):
    """Ends need no height, low-resolution peaks match on the line only, notes within 35 cents count once, no histogram: 7."""

    def ends_and_tops(x, need):
        n, out = len(x), set()
        for i in range(1, n - 1):
            if x[i - 1] < x[i] > x[i + 1]:
                left = next((j for j in range(i - 1, -1, -1) if x[j] > x[i]), -1)
                right = next((j for j in range(i + 1, n) if x[j] > x[i]), n)
                if x[i] - max(min(x[left + 1 : i + 1]), min(x[i:right])) >= need:
                    out.add(i)
        return out | {i for i in (0, n - 1) if x[i] > x[i - 1] and x[i] > x[(i + 1) % n]}

    rng = np.random.default_rng(9)
    highs, lows = rng.random((12, 100)) * 50, rng.random((12, 33)) * 200
    want = {99: 7}
    for r, (h, g) in enumerate(zip(highs, lows, strict=True)):
        hi, lo = ends_and_tops(h, max(1.0, 0.5 * h.max())), ends_and_tops(g, 0.5 * g.max())
        near = [12 * i + 6 for i in hi if any(abs(12 * i + 6 - (j + 0.5) * 1200 / 33) <= 45 for j in lo)]
        want[r] = len({round(c / 100) % 12 for c in near if abs(c - 100 * round(c / 100)) <= 35})
    frame = lambda x: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "recording_id long, h array<double>")
    high, low = H.peaks(frame(highs), "h", 0.5, 2, 1.0, False), H.peaks(frame(lows), "h", 0.5, 1, 0.0, False)
    got = H.peak_counts(spark.createDataFrame([(r,) for r in want], "recording_id long"), high, low, 100, 33)
    assert {r[0]: r[1] for r in got.collect()} == want
