"""Segments, spellings, stored models and the leave-one-out learner against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from melodex import queries as Q
from melodex.operators import leave_one_out as L
from melodex.operators import model_store as M
from melodex.operators import names as N
from melodex.operators import ngrams as G
from melodex.operators import segments as W
from melodex.sources import files as C

DATA = "/root/testdata/sf0.001"


def walked(tokens, least):
    i, out = 0, []
    while i < len(tokens):
        j = total = 0
        j = i
        while j < len(tokens) and total < least:
            total += tokens[j]
            j += 1
        out.append((len(out), i, j, total))
        i += max(1, (j - i) // 2)
    return out


def test_segments_are_those_of_a_walk(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 7)
    rng = random.Random(4)
    songs = {r: [rng.choice([1, 2, 3, 9, 40]) for _ in range(n)] for r, n in enumerate([1, 2, 3, 30, 200])}
    df = spark.createDataFrame([(r, i, t) for r, ts in songs.items() for i, t in enumerate(ts)], "recording_id long, phrase long, tokens long")
    got = sorted(map(tuple, W.segments(df, 12).collect()))
    assert got == [(r, *w) for r, ts in songs.items() for w in walked(ts, 12)]
    assert W.segments(df.limit(0), 12).collect() == []
    sums = W.over_segments(W.segments(df, 12), df, [], ["tokens"])
    assert sorted(map(tuple, sums.collect())) == [(r, w[0], w[3]) for r, ts in songs.items() for w in walked(ts, 12)]


def test_segments_walk_no_recording_in_python(spark):
    plan = W.reaches(spark.createDataFrame([(1, 0, 3)], "recording_id long, phrase long, tokens long"), 12)._jdf.queryExecution().toString()
    assert not re.search("Pandas|Arrow|NestedLoop|Cartesian", plan)


def test_containment_is_that_of_every_pair(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    a, b = [None, "", *(text(rng.randrange(12)) for _ in range(80))], [None, "", *(text(rng.randrange(1, 7)) for _ in range(60))]
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    found = N.contained(left, right, "a", "b")
    assert sorted(map(tuple, found.collect())) == sorted({(x, y) for x in a for y in b if x and y and y in x})
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().toString())


def test_spelling_stages(spark):
    known = [(0, "Todi"), (1, "Shree"), (2, "Jhinjhoti"), (3, "darbari"), (4, "DARBARI"), (5, "Ahir"), (6, "Mal")]
    want = {
        "Todi": ("Todi", "exact"), "todi": ("Todi", "exact"), "TODI": ("Todi", "case"), "Shri": ("Shree", "i_to_ee"), "AhiR": ("Ahir", "case"), "Aheer": ("Ahir", "ee_to_i"), "Jhinjti": ("Jhinjhoti", "ti_to_hoti"),
        "Jhinjhti": (None, None), "Jhinjti Kafi": (None, None), "darbari Kafi": ("darbari", "suffix"), "Darbari Kafi": ("darbari", "suffix_case"), "Gurjari todI song": ("Todi", "contains"), "Mal x": (None, None),
    }
    want |= {"Ahee": (None, None), "Toti": (None, None), "SHRi": ("Shree", "variant_case"), "todee": ("Todi", "ee_to_i")}
    labels = spark.createDataFrame([(x,) for x in [*want, "", None, "Todi"]], "name string")
    got = {r["name"]: (r["found"], r["stage"]) for r in N.spelling_chain(labels, spark.createDataFrame(known, "place int, found string"), [" Kafi"]).collect()}
    assert got == want


def test_stored_model_versions(spark):
    tokens = [(1, "x", 0, i, t) for i, t in enumerate("abab")] + [(2, "x", 0, i, t) for i, t in enumerate("abc")] + [(3, "y", 0, i, t) for i, t in enumerate("cz")]
    rows = spark.createDataFrame(tokens, "recording_id long, class string, seq int, at int, token string")
    grams = G.windowed_ngrams(rows, ["recording_id", "class", "seq"], ["at"], most=2)
    path = C.shared_path(spark, "model-test")
    with pytest.raises(ValueError, match="no version"):
        M.load(spark, path)
    assert M.save(M.train(grams, 1, 1.0, [1.0]), path) == 1
    kept = M.train(grams, 2, 0.5, [0.25, 0.75], least_recordings=2)
    assert M.save(kept, path) == 2
    read = M.load(spark, path)
    assert (read.order, read.k, read.lambdas, read.vocabulary) == (2, 0.5, (0.25, 0.75), 5)  # z and c of the class left out count
    assert [tuple(r) for r in read.classes.collect()] == [("x", 9, 2)]
    assert M.load(spark, path, 1).classes.count() == 2
    score = lambda m: sorted((r["recording_id"], r["class"], round(r["logprob"], 12)) for r in G.score_sequences(M.score_positions(m, grams)).collect())
    assert score(read) == score(kept)
    p = 0.25 * (3 + 0.5) / (9 + 2.5) + 0.75 * (2 + 0.5) / (2 + 2.5)  # a after the beginning
    positions = {(r["recording_id"], r["pos"]): r["p"] for r in M.score_positions(read, grams).collect()}
    assert positions[1, 2] == pytest.approx(p)
    assert [r[0] for r in M.known_classes(spark.createDataFrame([("x",), ("y",), (None,)], "class string"), read).collect()] == ["x"]


def newton(x, y, l2):
    x, n, ones = np.column_stack([np.ones(len(x)), x]), len(y), y.sum()
    w, ridge, b = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones))), np.diag([0.0] + [l2] * x.shape[1]), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ b)
    return b


def test_left_out_weights_are_those_of_separate_fits(spark):
    rng = np.random.default_rng(3)
    rows = []
    for r in range(70):
        for _ in range(60 if r == 0 else 4):  # one recording holds a large share
            a, b = rng.normal() * 2, rng.normal() * 10
            rows.append((r, int(rng.random() < 1 / (1 + np.exp(-(a - 0.05 * b - 1)))), float(a), float(b)))
    df = spark.createDataFrame(rows, "recording_id long, label int, a double, b double")
    got = {x["recording_id"]: [x["intercept"], *x["weights"]] for x in L.left_out_weights(df, ["a", "b"]).collect()}
    table = np.array(rows)
    assert len(got) == 70
    for r in range(70):
        rest = table[table[:, 0] != r]
        assert got[r] == pytest.approx(newton(rest[:, 2:], rest[:, 1], 1.0), abs=2e-6)


def test_left_out_weights_of_odd_tables(spark):
    schema = "recording_id long, label int, a double"
    one = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.1), (2, 0, 0.3), (3, 0, 0.2)], schema)
    got = {x["recording_id"]: x["weights"] for x in L.left_out_weights(one, ["a"]).collect()}
    assert got[1] is None  # no row of label 1 is left
    assert got[2] is not None
    assert {x["weights"] for x in L.left_out_weights(one.where("label = 0"), ["a"]).collect()} == {None}
    assert L.left_out_weights(one.limit(0), ["a"]).collect() == []


def test_learner_query_is_right_about_each_recording(spark):
    from melodex.queries.models import candidate_features

    got = {r["recording_id"]: r for r in Q.QUERIES["leave_one_out_learner"](spark, DATA).collect()}
    rows = candidate_features(spark, DATA).orderBy("recording_id", "class").select("recording_id", "class", "hist", "lm", "residual", "label").toPandas()
    for r in sorted(got)[:5]:
        rest, own = rows[rows["recording_id"] != r], rows[rows["recording_id"] == r]
        w = newton(rest[["hist", "lm", "residual"]].to_numpy(), rest["label"].to_numpy(), 1.0)
        assert [got[r]["intercept"], *got[r]["weights"]] == pytest.approx(w, rel=1e-4, abs=1e-4)
        s = w[0] + own[["hist", "lm", "residual"]].to_numpy() @ w[1:]
        best = s[own["label"].to_numpy() == 1][0]
        assert got[r]["rank"] in range(1 + (s > best + 1e-6).sum(), 2 + (s > best - 1e-6).sum())
    assert rows.groupby("recording_id")["label"].sum().eq(1).all()
