"""Vocabulary, near words, forms and roots against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from melodex.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def without(w):
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def brute(docs):
    n = Counter()
    for id_, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    by = {}
    for w in n:  # partners share the word without one letter, or the word
        for v in without(w):
            by.setdefault(v, []).append(w)
    of = {w: sorted({x for v in without(w) for x in by[v] if near(w, x)}) for w in n}
    form = {w: f for w in n if of[w] and n[f := min(of[w], key=lambda x: (-n[x], x))] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(of[w]), n.get(form.get(w))) for w in n)


def rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_of_each_pair_within_one_edit_one_asks():
    rng = random.Random(1)
    words = [[rng.randrange(3) for _ in range(rng.randrange(0, 6))] for _ in range(60)]
    flat, lengths = np.array([x for w in words for x in w], np.int64), np.array([len(w) for w in words])
    made = spelling.Neighbourhoods(flat, lengths, 3)
    at, keys = made.asked()
    assert len(set(zip(at.tolist(), keys.tolist(), strict=True))) == len(at)
    whole = made.whole().tolist()
    have = {i: set(keys[at == i].tolist()) for i in range(len(words))}
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (whole[j] in have[i]) + (whole[i] in have[j]) == (2 if a == b else near(a, b))


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abceéßxyÿ") for _ in range(rng.randrange(5, 9))) for _ in range(25)]

    def word():
        w = list(bases[min(24, int(rng.paretovariate(0.7)) - 1)])
        while rng.random() < 0.3:
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = rng.choice(["", "q", "É", "×"])
        return "".join(w).upper() if rng.random() < 0.1 else "".join(w)

    docs = [(i, "".join(word() + rng.choice([" ", "\n", "1", "日", "_", "-", "\xbf"]) for _ in range(rng.randrange(1, 400)))) for i in range(60)]
    docs += [(None, docs[0][1]), (4, docs[4][1]), (4, docs[4][1]), (70, None), (71, ""), *((80 + i, "z" * 900) for i in range(5)), *((90 + i, "z" * 901) for i in range(5))]
    docs += [(200, "kitchen " * 400 + "kitchem " * 60 + "kitchxm " * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "'x' AS n", "2 AS key").repartition(3)
    got = rows(spelling.group_variants(df, change=spelling.thinned))
    assert got == brute(docs)
    assert len({r[2] for r in got}) < len({r[1] for r in got if r[1]} | {r[0] for r in got})
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain


def test_empty_and_plain(spark):
    df = spark.createDataFrame([(1, "house " * 5 + "houses " * 5 + "Houses"), (2, None)], "doc_id long, text string")
    assert rows(spelling.group_variants(df.limit(0))) == []
    assert rows(spelling.group_variants(df)) == [("houses", None, "houses", 6, 0, None)]


def test_very_long_words(spark):
    long = "ab" * 100_000
    docs = [(i, long + ("" if i % 2 else "é")) for i in range(12)]
    got = rows(spelling.group_variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert [(len(r[0]), r[1:3], *r[3:]) for r in got] == [(200_000, (None, long), 6, 1, None), (200_001, (None, long + "é"), 6, 1, None)]


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(spelling.op12_spelling_variants(spark, data)) == brute(docs)
