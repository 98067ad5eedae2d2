"""Suffix arrays, common prefixes and the spans that go, against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from melodex.llm import suffix_dedup, suffixes
from melodex.llm.suffixes import permuted_prefixes, suffix_array


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("short", [0, 1 << 18])
def test_suffix_array_and_prefixes(monkeypatch, seed, short):
    monkeypatch.setattr(suffixes, "SHORT", short)  # by recursion to the end, or by doubling
    rng = random.Random(seed)
    letters = rng.choice([1, 2, 3, 250])
    t = []
    for _ in range(rng.randrange(1, 12)):
        t += [rng.randrange(letters) + 2 for _ in range(rng.randrange(1, 60))] * rng.choice([1, 1, 3]) + [1]
    t.append(0)
    want = sorted(range(len(t)), key=lambda i: t[i:])
    until = [0] * len(t)
    for i in range(len(t) - 2, -1, -1):
        until[i] = 0 if t[i] < 2 else until[i + 1] + 1
    order = suffix_array(np.array(t), 258)
    assert order.tolist() == want
    shared = permuted_prefixes(np.array(t), order, np.array(until, np.int32))
    for a, b in zip(want, want[1:], strict=False):
        n = 0
        while n < until[b] and t[a + n] == t[b + n]:
            n += 1
        assert shared[b] == n


def brute(docs, width=50):
    first = {}
    raw = [(i, (x or "").encode()) for i, x in docs]
    for i, x in raw:
        if i is not None:
            for j in range(len(x) - width + 1):
                s = x[j : j + width]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, x in raw:
        gone = bytearray(len(x))
        for j in range(len(x) - width + 1):
            if i is not None and first[x[j : j + width]] < i:
                gone[j : j + width] = b"\1" * width
        spans = bytes(gone).split(b"\0")
        out.append((i, len(x), sum(gone), sum(map(bool, spans)), hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["bytes"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize(("hot", "block", "shard"), [(2_000, 4 << 20, 6 << 20), (3, 900, 300)])
def test_spans_against_brute_force(spark, hot, block, shard):
    rng = random.Random(11)
    text = lambda n, k=6: "".join(rng.choice("abcdéf \n"[:k] + "ü") for _ in range(n))
    shared = [text(rng.randrange(40, 140)) for _ in range(6)]
    docs = [(i, "".join(rng.choice([text(rng.randrange(30)), rng.choice(shared), "a" * rng.randrange(150), "xyz" * rng.randrange(50)]) for _ in range(rng.randrange(1, 7)))) for i in range(70)]
    docs += [(100, docs[3][1]), (101, docs[3][1]), (3, docs[3][1]), (5, shared[0] + "tail"), (None, shared[0] * 2), (102, None), (103, ""), (104, "x" * 49), (105, "x" * 50), (106, "x" * 51), (107, "y" * 30_000), (108, "y" * 30_000 + shared[1]), (-4, shared[1])]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    settings = suffix_dedup.Settings(hot=hot, block_bytes=block, shard_bytes=shard)
    assert digest(suffix_dedup.repeated_spans(df, settings)) == brute(docs)


def test_odd_tables(spark):
    """Integers of another kind, clashing columns, an empty table, nothing to find."""
    df = spark.createDataFrame([(2, "q" * 60, "x", 1), (1, "q" * 55, "y", 2)], "doc_id int, text string, block string, kept int")
    found = suffix_dedup.repeated_spans(df)
    assert found.schema["doc_id"].dataType.simpleString() == "int"
    assert digest(found) == brute([(2, "q" * 60), (1, "q" * 55)])
    assert suffix_dedup.repeated_spans(df.limit(0)).collect() == []
    assert digest(suffix_dedup.repeated_spans(df.where("doc_id = 1"))) == brute([(1, "q" * 55)])


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = suffix_dedup.op11_suffix_dedup(spark, data)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == brute(docs)
