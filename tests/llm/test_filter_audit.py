"""The audit of filters against brute force, on odd rows too."""

from __future__ import annotations

import random
import re
from itertools import permutations

from melodex.llm import filter_audit


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, x, _ in docs:
        if i is not None:
            least[x or ""] = min(i, least.get(x or "", i))
    rows = []
    for i, x, lang in docs:
        x = x or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 3 * len(x), "D": bool(re.search(r"[#$%&*|]", x)), "E": i is not None and least[x] < i}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine, made, share = [r for r in rows if r[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [r for r in mine if f in r[1] and not r[1] & before]
                share[f] += len(removed)
                made.append((part, order, k + 1, sum(not r[1] & (before | {f}) for r in mine), len(removed), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed)))
        out += [(*m, share[m[1][m[2] - 1]]) for m in made]
    return sorted(out)


COLUMNS = ("part", "filter_order", "step", *filter_audit.COUNTS, "shapley")


def test_audit_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "The", "A", "x\x85y", "né", "UP", "日本", "a\xa0b", "q"]) + str(rng.randrange(60))
    text = lambda: rng.choice(" \n\t\x0b").join(word() for _ in range(rng.choice([0, 3, 199, 200, 201, 400]))) + rng.choice(["", "", "#", "|", " ", "\x1c"])
    texts = [text() for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    docs += [(None, texts[0], "en"), (None, texts[0], "en"), (7, texts[1], "en"), (7, texts[1], "en"), (-3, None, "de"), (800, "", "de"), (801, "W" * 100_000, "de"), (802, "w " * 100_000, "de")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 120, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (9_999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS words", "'x' AS mask", "2 AS part", "3 AS good", "4 AS digest")
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == brute(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    got = sorted(map(tuple, filter_audit.audit(docs, labels).select(*COLUMNS).collect()))
    assert len(got) == 600
    assert got == brute([(1, "a b", "en")], [])
