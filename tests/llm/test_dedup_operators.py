"""Line, SimHash and embedding dedup against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions

from melodex.llm import common, embedding_dedup, line_dedup, simhash


def partition(pairs, nodes):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == partition([p for p in pairs if p[0] != p[1]], nodes)
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def copy_of(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) if text is not None else -1


def brute_gone(docs):
    order, seen, gone = [], {}, {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, copy_of(d[1]))):
        for at, line in enumerate(line_dedup.lines_of(text)):
            w = line_dedup.words_of(line)
            if not w:
                continue
            if tuple(w) in seen:
                gone[i, at] = seen[tuple(w)]
            else:
                seen[tuple(w)] = i, at
                order.append((w, (i, at)))
    for k, (w, where) in enumerate(order):
        first = next((p for v, p in order[:k] if len(w) >= 5 and len(v) >= 5 and line_dedup.within_one(v, w)), None)
        if first:
            gone[where] = first
    return gone


def line_docs():
    rng = random.Random(4)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 14))] for _ in range(40)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            w = list(rng.choice(base))
            k = rng.randrange(len(w))
            kind = rng.randrange(6)
            if kind == 1:
                w[k] = "changed"
            elif kind == 2:
                w.insert(k, w[k])
            elif kind == 3 and len(w) > 1:
                del w[k]
            elif kind == 4:
                w = [x.upper() for x in w]
            lines.append("  ".join(w))
        docs.append((i, "\n".join(lines)))
    return docs + [(100, None), (101, ""), (102, "\n\n \t"), (103, "x " * 20_000)]


def test_line_dedup_against_brute_force(spark):
    docs = line_docs()
    got = {(r[0], r[1]): (r[2], r[3]) for r in line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_gone(docs)


def test_line_dedup_texts(spark):
    rows = [(1, "alpha beta\n\nsame line of five words", "x", 35), (2, "same line of five words\nown", "y", 27), (3, "same line of six words", "z", 22), (4, "\n", "z", 1), (5, None, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.dedup(df).collect()}
    assert got == {1: (rows[0][1], 35), 2: ("own", 3), 4: ("\n", 1), 5: (None, None)}
    assert line_dedup.dedup(df.limit(0)).collect() == []


BIG = 2**53 + 1


def test_line_dedup_judges_each_text_of_an_id(spark):
    """Two texts under one id, an id beyond 2**53 beside a null one, names that the operator might use itself."""
    rows = [(1, "one two three four five\nx", 1), (2, "one two three four six\ny", 1), (2, "only here\nnor there", 1), (2, "only here\nnor there", 1), (BIG, "one two three four five six\nz", 1), (None, None, 1), (BIG - 1, "apart", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int").withColumns({x: functions.lit(x) for x in ("_id", "_gone", "_kept", "kept", "gone_id", "copy")})
    got = line_dedup.dedup(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect() if r["text"]) == [(1, rows[0][1]), (2, "only here\nnor there"), (2, "only here\nnor there"), (2, "y"), (BIG - 1, "apart"), (BIG, "z")]
    assert all(r["_gone"] == "_gone" and r["gone"] == 1 for r in got.collect())
    lines = {(r["doc_id"], r["line"]): (r["of_doc_id"], r["of_line"]) for r in line_dedup.duplicate_lines(df).collect()}
    assert lines == {(2, 0): (1, 0), (BIG, 0): (1, 0)}


def test_variants_of_a_very_long_line(spark):
    words = [f"w{i * 7919 % 50_000}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:150_000], "changed", *words[150_001:]])), (3, " ".join(words[1:])), (4, " ".join(words[:-2]))]
    got = {r["doc_id"]: r["of_doc_id"] for r in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: 1, 3: 1}


def test_rolling_hashes_agree_with_those_of_the_parts():
    made, words = line_dedup.Hashes(), [b"a", b"b", b"a", b"c", b"d", b"e", b"b"]
    one = made.sums([[b"z"] * 3, words])
    rest = one.without_each()[3:]
    assert [int(x) for x in rest] == [int(made.sums([words[:k] + words[k + 1 :]]).whole()[0]) for k in range(7)]
    assert line_dedup.halves(words)[0] == line_dedup.halves([*words, b"x"])[2]  # its front half as that of a line of one word less


@pytest.mark.parametrize("a,b,ok", [("a b c", "a b c", 1), ("a b c", "a x c", 1), ("a b c", "a b c d", 1), ("a b c", "b c", 1), ("a a b", "a b", 1), ("a b c d", "b a c d", 0), ("a b", "c d", 0), ("a", "b c d", 0), ("a b c", "b c d", 0)])
def test_within_one(a, b, ok):
    assert line_dedup.within_one(a.encode().split(), b.encode().split()) == bool(ok) == line_dedup.within_one(b.encode().split(), a.encode().split())


def slow_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rng = random.Random(6)
    docs = []
    for i in range(150):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 3, 400]))]
        docs.append((10 * i, " ".join(w)))
        for j in range(i % 3):
            w[rng.randrange(len(w))] = "Changed"
            docs.append((10 * i + j + 1, "\t".join(w)))
    docs += [(9001, None), (9002, ""), (9003, " \n"), (9003, " \n"), (None, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, fp int")
    got = simhash.group(df).collect()
    assert len(got) == len(docs)
    fps = {d: slow_fingerprint(x) for d, x in docs if d is not None}
    assert all(r["fp"] % 2**64 == fps[r["doc_id"]] for r in got if r["doc_id"] is not None)
    ids = sorted(fps)
    linked = [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == partition(linked, ids)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [partition(linked, ids)[9001]]
    kept = [r["doc_id"] for r in simhash.keep_one(df).collect()]
    assert sorted(kept) == sorted({partition(linked, ids)[i] for i in ids})
    assert simhash.group(df.limit(0)).collect() == []


def test_simhash_judges_each_text_of_an_id(spark):
    copied, own = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, copied), (2, copied), (2, own), (2, own), (BIG, copied), (None, own), (BIG - 1, "apart from all of them"), (None, None), (None, copied)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: functions.lit(x) for x in ("_gone", "gone_id", "gone_copy", "fp", "copy", "first")})
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [(0, ""), (1, copied), (2, own), (BIG - 1, "apart from all of them")]
    assert sorted(r["doc_id"] for r in simhash.group(df).collect() if r["doc_id"]) == [1, 2, 2, 2, BIG - 1, BIG]


def test_simhash_of_a_very_long_text(spark):
    text = " ".join(f"w{i % 70_001}" for i in range(400_000))
    got = simhash.group(spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1} and {r["fp"] % 2**64 for r in got if r["doc_id"] == 1} == {slow_fingerprint(text)}


@pytest.mark.parametrize("count", [100, 100_000, 50_000_000])
def test_simhash_plan_covers_the_radius(count):
    sample = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    chosen = simhash.plan(sample, count)
    assert sum(t + 1 for _, t in chosen) == 4
    bits = [b for p, _ in chosen for b in p]
    assert len(bits) == len(set(bits)) <= 64


def test_simhash_close_fingerprints_all_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, k, replace=False))) for b in base for k in (1, 2, 3, 4)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    got = {tuple(sorted((r[0] % 2**64, r[1] % 2**64))) for r in simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()}
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(int(a) ^ int(b)).count("1") <= 3}
    assert got == want


def test_lattice_decoding_is_nearest():
    x = np.random.default_rng(0).normal(0, 2, (300, 8))
    own = embedding_dedup.decode(x)
    roots = embedding_dedup.roots()
    assert len(roots) == 240 and np.allclose((roots**2).sum(axis=1), 2)
    assert (((x - own) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - own[:, None] - roots[None]) ** 2).sum(axis=2) + 1e-9).all()
    doubled = np.rint(2 * own)
    assert np.allclose(2 * own, doubled) and ((doubled % 2 == doubled[:, :1] % 2).all()) and (own.sum(axis=1) % 2 == 0).all()


def test_embedding_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (60, 64))
    rows, v = [], []
    for i, b in enumerate(base):
        for k in range(i % 4):
            v.append(b + rng.normal(0, 0.1, 64) * (k > 0))
    v += [base[0], base[0], base[0] * 3]
    rows = [(100 + i, [float(np.float32(y)) for y in x], "label") for i, x in enumerate(v)]
    odd = [(1, None, "l"), (2, [0.0] * 64, "l"), (3, [float("nan")] * 64, "l"), (4, [None] + [1.0] * 63, "l"), (5, [float("inf")] + [1.0] * 63, "l"), (6, [], "l"), (7, [1.0, 0.0], "l")]
    got = {r["vec_id"]: r for r in embedding_dedup.group(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, kept string")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    linked = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if cos[i, j] >= 0.9]
    part = partition(linked, [r[0] for r in rows])
    for i, (k, _, _) in enumerate(rows):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == ((cos[i] >= 0.9).sum() - 1, part[k], part[k] == k)
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k, _, _ in odd)
    assert embedding_dedup.group(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_embeddings_whose_ids_repeat(spark):
    """Each row is a vector of its own: equal ones, near ones and far ones under one id, and null ids."""
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, (6, 32))
    rows = [(rng.choice([1, 2, 3, 4, None, 9]), base[i % 6] + rng.normal(0, 0.12, 32) * (i % 5 > 1)) for i in range(60)]
    rows = [(None if k is None else int(k), [float(y) for y in x]) for k, x in rows] + [(7, [1.0] * 32), (7, [-1.0] * 32)]
    df = spark.createDataFrame([(k, x, i) for i, (k, x) in enumerate(rows)], "vec_id long, embedding array<double>, row int").repartition(3)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    part = partition([(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if near[i, j]], range(len(rows)))
    want = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        want.append((k, int(near[i].sum()) - 1, least, k is not None and k == least))
    assert sorted(map(tuple, embedding_dedup.group(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str) == sorted(want, key=str)
    three = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0]), (1, [1.0, 0.2])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"]) for r in embedding_dedup.group(three).collect()) == [(1, 2), (1, 2), (2, 2)]


def test_embeddings_of_extreme_sizes(spark):
    """Squares that underflow or overflow: neither a crash nor links of what is apart."""
    a, b = [1.0, 0.2, 0.1, 0.3], [-0.2, 1.0, 0.3, -0.1]
    rows = [(10 * k + i, [x * f for x in v]) for k, f in enumerate((1.0, 1e-200, 1e200)) for i, v in enumerate((a, b))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.group(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (2, i % 10) for i, _ in rows}


def test_embedding_recall_at_the_threshold():
    """Pairs at a cosine of just 0.9, the hardest: the share that meets in some cell."""
    rng, n, s = np.random.default_rng(1), 1500, embedding_dedup.Settings()
    a, o = rng.standard_normal((n, 64)), rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * o / np.linalg.norm(o, axis=1, keepdims=True)
    hit = np.zeros(n, bool)
    for (_, x), (_, y) in zip(embedding_dedup.cells(a, s), embedding_dedup.cells(b, s), strict=True):
        hit |= (x == y[:, :1]).any(axis=1) | (y == x[:, :1]).any(axis=1)
    assert hit.mean() >= 0.9
