"""Edit logs, sweeps, stationary notes, listings, logs of broken runs and sidecars against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from melodex.functions.finite import sanitised, sidecar
from melodex.operators import edits as X
from melodex.operators import stationary as Y
from melodex.operators import sweeps as W
from melodex.sources import files as C
from melodex.sources import listing as D
from melodex.streaming import progress as P

LOG = "recording_id long, seq long, op string, note_id long, phrase string, other string, lo double, hi double, midi double"
NOTES = "recording_id long, note_id long, start double, end double, midi double, phrase string"


def edit(seq, op, note=None, phrase=None, other=None, lo=None, hi=None, midi=None, recording=1):
    return (recording, seq, op, note, phrase, other, lo, hi, midi)


def replayed(spark, log, notes=None):
    rows = notes or [(1, i, float(i), i + 0.5, 60.0 + i, "p0" if i < 3 else "p1") for i in range(6)]
    out = X.replay_session(spark.createDataFrame(rows, NOTES), spark.createDataFrame(log, LOG))
    return {r["note_id"]: (r["start"], r["end"], r["phrase"]) for r in out.collect()}


def test_undo_and_redo(spark):
    ops = ["a", "b", "undo", "redo", "undo", "c", "redo", "undo", "undo", "undo", "redo", "d", "undo", "redo", "redo", "open", "undo", "e"]
    log = spark.createDataFrame([edit(i, op) for i, op in enumerate(ops)], LOG)
    assert [r["op"] for r in X.effective(log).orderBy("seq").collect()] == ["a", "d", "e"]
    assert X.effective(log.limit(0)).collect() == []


def test_edits_of_notes_and_phrases(spark):
    first = replayed(spark, [edit(1, "delete", 2), edit(2, "bounds", 4, lo=9.0, hi=8.0), edit(3, "delete_range", lo=1.2, hi=1.3), edit(4, "bounds", 0, lo=0.3, hi=0.3)])
    assert first == {0: (0.3, 0.301, "p0"), 3: (3.0, 3.5, "p1"), 4: (8.0, 9.0, "p1"), 5: (5.0, 5.5, "p1")}
    merged = replayed(spark, [edit(1, "merge", phrase="p0", other="p1"), edit(2, "split", 3, "p0", "s3", 3.0, 3.5)])
    assert [merged[i][2] for i in range(6)] == ["p0"] * 4 + ["s3"] * 2
    bounds = replayed(spark, [edit(1, "phrase_bounds", phrase="p1", lo=1.1, hi=3.2)])
    assert [bounds[i][2] for i in range(6)] == ["p0", "p1", "p1", "p1", "auto-4", "auto-5"]


def test_what_is_gone_or_not_there_yet_is_left_alone(spark):
    log = [edit(1, "delete_range", lo=9.0, hi=10.0), edit(2, "add", 50, "p9", lo=9.5, hi=9.1, midi=70.0), edit(3, "bounds", 50, lo=7.0, hi=7.5), edit(4, "delete", 1), edit(5, "bounds", 1, lo=6.0, hi=6.1), edit(6, "undo"), edit(7, "undo"), edit(8, "redo"), edit(9, "add", 51, "p9", lo=1.0, hi=2.0)]
    got = replayed(spark, log)
    assert got[50] == (7.0, 7.5, "p9") and 1 not in got and got[51] == (1.0, 2.0, "p9")
    assert len(replayed(spark, [edit(1, "delete", 1, recording=2)])) == 6  # another recording's log
    p = X.phrase_table(spark.createDataFrame([(1, 1, 0.0, 1.0, 60.0, "a"), (1, 2, 3.0, 4.0, 60.0, "a")], NOTES)).collect()
    assert [tuple(r) for r in p] == [(1, "a", 0.0, 4.0, 2)]


def test_sweep_against_brute_force(spark):
    rng = random.Random(6)
    edges, gates = [50, 100, 150, 200, 250], {"low": 0.2, "high": 0.6}
    frames = [(r, rng.uniform(20, 300), rng.random()) for r in range(5) for _ in range(40)] + [(0, 50.0, 0.9), (0, 250.0, 0.9), (1, 100.0, 0.6)]
    people = [(r, rng.randrange(12), sorted(rng.sample(range(12), rng.choice([3, 12]))), [rng.choice([None, 1.0, 2.5, 3.0]) for _ in range(12)]) for r in range(6)]
    df = spark.createDataFrame(frames, "recording_id long, pitch_hz double, confidence double")
    prefixes = W.band_prefixes(df, edges, {g: F.col("confidence") >= v for g, v in gates.items()})
    settings = [(lo, hi, 2.0) for lo, hi in W.bands(50, 250, 50, 50)] + [(100, 200, w) for w in (0.0, 9.0)]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in W.sweep(spark.createDataFrame(people, "recording_id long, tonic int, allowed array<int>, fits array<double>"), prefixes, edges, list(gates), settings).collect()}
    assert len(got) == 2 * len(settings)

    def best(score, allowed):
        some = [i for i in allowed if score[i] is not None]
        return max(some, key=lambda i: (score[i], -i)) if some else -1

    for g, v in gates.items():
        for lo, hi, w in settings:
            want = [0] * 8
            for r, tonic, allowed, fits in people:
                h = [0] * 12
                for q, hz, c in frames:
                    if q == r and lo <= hz < hi and c >= v:
                        h[int(np.round(69 + 12 * np.log2(hz / 440))) % 12] += 1
                both = [(-1000.0 if f is None else f) + w * n / max(1, *h) for f, n in zip(fits, h, strict=True)]
                picks = [best(s, a) for s in ([n or None for n in h], fits, both) for a in (range(12), allowed)]
                want = [x + y for x, y in zip(want, [1, any(h), *[p == tonic for p in picks]], strict=True)]
            assert got[g, lo, hi, w] == tuple(want)
    w = W.best_weight(spark.createDataFrame([("a", 1, 2, 5.0, 3), ("a", 1, 2, 1.0, 3), ("a", 1, 2, 0.0, 2)], "gate string, lo int, hi int, weight double, combined_allowed long"))
    assert [r["weight"] for r in w.collect()] == [1.0]


def test_stationary_notes_whatever_the_cuts(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for rec in range(3):
        midi, t, pieces = 60.0, 0.0, []
        for k in range(30):
            midi += float(rng.choice([0.05, 0.2, -0.2, 0.29, 0.5, 3.0, -3.0]))
            n = int(rng.integers(1, 6))
            times = [round(t + 0.05 * i, 6) for i in range(n)]
            rows += [(rec, 1000 * k + i, int(x * 1e6), x, float(440 * 2 ** ((midi - 69) / 12)), 0.5 + k / 100, k / 50) for i, x in enumerate(times)]
            pieces.append((times, midi, k))
            t += 0.05 * n
        out = []
        for i, (times, m, k) in enumerate(pieces):
            still = times if i == 0 else times[1:]  # the step up to it is steep
            after = pieces[i + 1][0][0] if i + 1 < len(pieces) else times[-1]
            if not still or after - still[0] < 0.1 - 1e-9:
                continue
            if out and abs(m - out[-1][2]) < 0.3:
                a = out[-1]
                d0, d1 = a[1] - a[0], after - still[0]
                out[-1] = [a[0], after, (a[2] + m) / 2, 0.5 + k / 100, (a[4] * d0 + k / 50 * d1) / (d0 + d1), a[5] + 1]
            else:
                out.append([still[0], after, m, 0.5 + k / 100, k / 50, 1])
        want += [(rec, *x) for x in out]
    df = spark.createDataFrame(rows, "recording_id long, frame_id long, t_us long, t double, pitch_hz double, confidence double, energy double").repartition(3)
    got = Y.stationary_notes(df, least=0.1 - 1e-9).orderBy("recording_id", "note").collect()
    assert len(got) == len(want)
    assert any(r["parts"] > 1 for r in got)
    for r, w in zip(got, want, strict=True):
        assert (r["recording_id"], r["start"], r["end"], r["midi"], r["confidence"], r["energy"], r["parts"]) == pytest.approx(w, abs=1e-9)


def test_listing(spark, tmp_path):
    for x in ("a.wav", "one/b.MP3", "one/two/c.flac", "one/two/three/d.wav", ".hidden.wav", ".git/e.wav", "_x/f.wav", "one/notes.txt"):
        (tmp_path / x).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / x).write_text("x")
    found = D.listed(spark, str(tmp_path))
    below = sorted(r["path"].split(tmp_path.name + "/")[1] for r in found.collect())
    assert below == ["a.wav", "one/b.MP3", "one/notes.txt", "one/two/c.flac", "one/two/three/d.wav"]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    root = found.first()["path"].split(tmp_path.name)[0] + tmp_path.name
    assert [r["path"].rsplit("/", 1)[1] for r in C.audio_files(found, root).collect()] == ["a.wav", "b.MP3", "c.flac"]
    names = spark.createDataFrame([("file:/r/rec=a/table=t.csv/part-0-x.csv",), ("file:/r/k=b/t.csv",)], "p string").select(D.written_name(F.col("p")))
    assert [r[0] for r in names.collect()] == ["file:/r/a/t.csv", "file:/r/b/t.csv"]
    todo = D.resumable(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int"), "k")
    assert [r["k"] for r in todo.collect()] == [2]


def test_a_log_has_each_row_once_after_a_break(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"))
    rows.repartitionByRange(4, "n").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []

    def breaks(number):
        seen.append(number)
        if number == 2:
            raise RuntimeError("killed between writing and commit")

    with pytest.raises(Exception, match="killed"):
        P.logged(stream, f"{tmp_path}/out", after=breaks).awaitTermination()
    assert seen == [0, 1, 2]
    P.logged(stream, f"{tmp_path}/out", after=seen.append).awaitTermination()
    assert seen == [0, 1, 2, 2, 3]
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/out/log").collect()) == list(range(40))
    last = P.read_log(spark, f"{tmp_path}/out", ["k"], ["n"]).collect()
    assert {r["k"]: r["n"] for r in last} == {k: max(n for n in range(40) if n % 7 == k) for k in range(7)}


def test_sanitised_at_any_depth(spark):
    bad = [math.nan, math.inf, -math.inf]
    rows = [(1, (bad[0], [(1.5, {"a": [bad[1], 2.0, None]}), None]), bad[2], "x"), (2, None, 3.0, None)]
    df = spark.createDataFrame(rows, "id int, s struct<a: double, b: array<struct<c: double, d: map<string, array<double>>>>>, f float, t string")
    got = [r.asDict(recursive=True) for r in sanitised(df).orderBy("id").collect()]
    assert got == [{"id": 1, "s": {"a": None, "b": [{"c": 1.5, "d": {"a": [None, 2.0, None]}}, None]}, "f": None, "t": "x"}, {"id": 2, "s": None, "f": 3.0, "t": None}]
    assert sanitised(df).schema.simpleString() == df.schema.simpleString()
    made = sidecar(df, ["id"]).orderBy("id").collect()
    assert made[0]["json"] == '{"s":{"a":null,"b":[{"c":1.5,"d":{"a":[null,2.0,null]}},null]},"f":null,"t":"x"}'
    assert len({r["fingerprint"] for r in made}) == 2
