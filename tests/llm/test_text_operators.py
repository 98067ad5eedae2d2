"""Scoring, counting, language ID and decontamination against brute force and on odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions

from melodex.llm import decontaminate, language_id, lm_score, token_counts

ODD = [(1, None, "en", 7), (2, "", None, 7), (None, "one two three", "en", 7), (4, "a b c d e f g", "en", 7), (4, "a b c d e f g", "en", 7), (6, "!!! 123", "fr", 7), (7, "word " * 30_000, "en", 7), (8, "Ünï 日本 x\ty\x0bz", "fr", 7)]
COLUMNS = "doc_id long, text string, lang string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def brute_scores(docs, held):
    """Base scores and the model's scores with the weights of the run left open: counts only."""
    tokens = [[*words(x), b""] for _, x in docs]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    return tokens, c, n, v, [sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) for t in tokens]


def test_lm_score_base_and_normalisation(spark):
    rng = random.Random(3)
    after = lambda w: w % 7 * 5 + rng.choice([1, 1, 1, 2, 3])  # noqa: E731  a word says much about the next
    docs = []
    for i in range(120):
        w = [rng.randrange(40)]
        for _ in range(rng.randrange(0, 60)):
            w.append(after(w[-1]))
        docs.append((i, " ".join(f"Word{x}" for x in w) if i % 20 else ""))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    from melodex.llm.common import fold

    got = {r["doc_id"]: r for r in lm_score.score(df, fold(F.col("doc_id"), 7) == 2).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    tokens, c, n, v, base = brute_scores(docs, held)
    for (i, _), t, h, b in zip(docs, tokens, held, base, strict=True):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(b)
        assert r["score"] < 0
    assert sum(got[i]["score"] for (i, _), h in zip(docs, held, strict=True) if h) > sum(b for b, h in zip(base, held, strict=True) if h)


def test_lm_score_is_the_stated_mixture(spark):
    """The score by brute force: estimates of all training documents, weights by expectation-maximisation over all tokens of
    the kept-out ones; and the chances of all words after a context sum to one."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = random.Random(8)
    docs = [(i, " ".join(f"v{int(rng.paretovariate(0.8)) % 60}" for _ in range(rng.randrange(0, 90)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    settings = lm_score.Settings(kept_out=4)
    dev = {r[0] for r in df.where(F.pmod(F.xxhash64(F.lit("kept out"), F.col("doc_id").cast("string")), F.lit(4)) == 0).collect()}
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = {i: [*words(x), b"$"] for i, x in docs}

    def counts(ids):
        one, two = Counter(w for i in ids for w in tokens[i]), Counter(p for i in ids for p in zip([b"^", *tokens[i]], tokens[i], strict=False))
        one[b"^"] = len(ids)
        return one, two, sum(len(tokens[i]) for i in ids)

    train = [i for i, _ in docs if i not in held]
    kept = [i for i in train if i not in dev]
    types = len({w for i in train for w in tokens[i]})
    bucket = lambda c: c.bit_length()

    def parts(v, w, made):
        one, two, n = made
        return np.array([1 / (types + 1), one[w] / n, two[v, w] / max(1, one[v])])

    made = counts(kept)
    asked = Counter(p for i in train if i in dev for p in zip([b"^", *tokens[i]], tokens[i], strict=False))
    weights = {b: np.array([0.2, 0.8, 0.0] if b == 0 else [0.1, 0.5, 0.4]) for b in range(40)}
    before = -np.inf
    for _ in range(lm_score.ROUNDS):
        total, gain = {}, 0.0
        for (v, w), times in asked.items():
            p = weights[bucket(made[0][v])] * parts(v, w, made)
            gain += times * np.log(p.sum())
            total[bucket(made[0][v])] = total.get(bucket(made[0][v]), 0) + times * p / p.sum()
        weights |= {b: np.maximum(x / x.sum(), 1e-9) for b, x in total.items()}
        if gain - before < 1e-5 * abs(gain):
            break
        before = gain
    weights[0][2] = 0.0
    weights = {b: x / x.sum() for b, x in weights.items()}
    made = counts(train)
    chance = lambda v, w: weights[bucket(made[0][v])] @ parts(v, w, made)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, F.col("doc_id").isin(list(held)), settings).collect()}
    for i, _ in docs:
        assert got[i] == pytest.approx(sum(math.log10(chance(v, w)) for v, w in zip([b"^", *tokens[i]], tokens[i], strict=False)), rel=1e-6)
    vocabulary = {w for i in train for w in tokens[i]}
    for v in [b"^", *sorted(vocabulary - {b"$"})]:
        assert sum(chance(v, w) for w in vocabulary) + weights[bucket(made[0][v])][0] / (types + 1) == pytest.approx(1)


def test_lm_weights_are_a_mixture_and_rise(spark):
    import numpy as np

    x = lambda v: lm_score.pack_counts(np.array(v))
    rows = spark.createDataFrame([([x([50, 5, 30]), x([40, 0, 0]), x([81, 11, 0]), x([90, 10, 1])],)], "values array<binary>")
    w = lm_score.mixture(rows, 1000, 100, 60)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all()
    assert w[lm_score.context(np.array([80]))[0], 2] > 0.9  # a bigram seen in half of its contexts
    assert w[0, 2] == 0


def test_lm_score_odd_rows(spark, odd, empty):
    from pyspark.sql import functions as F

    got = lm_score.score(odd, F.lit(False)).collect()
    assert len(got) == len(ODD)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert [r["n_tokens"] for r in got if r["doc_id"] == 7] == [30_001]
    assert len({(r["score"], r["base_score"]) for r in got if r["doc_id"] == 4}) == 1
    assert lm_score.score(empty, F.lit(False)).collect() == []
    assert all(r["train_tokens"] == 0 and r["score"] == 0 for r in lm_score.score(odd, F.lit(True)).collect())


def test_pack_round_trip():
    import numpy as np

    x = np.array([0, 1, 255, 256, 2**40, 2**63], np.uint64)
    assert (lm_score.unpack(lm_score.pack(x, 8), 8) == x).all()
    assert (lm_score.unpack_counts(lm_score.pack_counts(x[:5])) == x[:5].astype(np.int64)).all()


def brute_tokens(word, scores):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[j][0] + scores[word[j:end]], best[j][1] - 1) for j in range(end) if word[j:end] in scores))
    return -best[-1][1], best[-1][0]


def test_token_counts_against_brute_force(spark, odd, empty):
    scores = token_counts.read_vocabulary()
    trie = token_counts.Trie(scores)
    rng = random.Random(1)
    for w in [" the", "tion", "x" * 300, " Übung", "日本", *("".join(rng.choices("abcdetion ", k=rng.randrange(1, 14))) for _ in range(300))]:
        n, p = brute_tokens(w.encode(), scores)
        assert trie[w][0] == n and trie[w][1] == pytest.approx(p)
    got = {(r["doc_id"], r["n_pretokens"], r["n_tokens"], r["n_bytes"]) for r in token_counts.count_tokens(odd).collect()}
    assert {(1, 0, 0, 0), (2, 0, 0, 0)} <= got
    assert any(i == 7 and n == 30_001 for i, n, _, _ in got)
    assert token_counts.count_tokens(empty).collect() == []


def test_token_counts_of_whole_texts(spark):
    """Every column against a plain segmentation of each pre-token."""
    import regex

    scores = token_counts.read_vocabulary()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60] + [(2**53 + 1, "it's  ein Übung\n\n日本"), (None, "a b"), (2**53, None)]
    want = []
    for i, x in docs:
        words = regex.findall(token_counts.PATTERN, x or "")
        found = [brute_tokens(w.encode(), scores) for w in words]
        want.append((i, len(words), len((x or "").encode()), sum(n for n, _ in found), round(sum(p for _, p in found), 6)))
    got = token_counts.count_tokens(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((*tuple(r)[:4], round(r["log_prob"], 6)) for r in got), key=str) == sorted(want, key=str)


def test_ids_stay_whole_beside_null_ones(spark):
    """An id that no double holds, in one batch with a null id, through every operator that works on texts in Python."""
    from pyspark.sql import functions as F

    big = 2**53 + 1
    df = spark.createDataFrame([(big, "the test item of five words", "en"), (None, "the test item of five words", "en"), (big + 2, "other words", "en")], "doc_id long, text string, lang string").coalesce(1)
    want = [big, big + 2, None]
    ids = lambda x: sorted((r["doc_id"] for r in x.collect()), key=lambda v: (v is None, v))
    assert ids(lm_score.score(df, F.lit(False))) == want
    assert ids(token_counts.count_tokens(df)) == want
    assert ids(language_id.identify(df)) == want
    items = spark.createDataFrame([(big, "The test item of five words"), (None, "the test item of five")], "item_id long, text string").coalesce(1)
    assert sorted(tuple(r)[:2] for r in decontaminate.contained(df, items).collect() if None not in tuple(r)) == [(big, big)]
    assert ids(decontaminate.clean(df, items)) == [big + 2]


def test_trie_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_NODES", 10)
    scores = {bytes([b]): -1.0 for b in range(256)} | {b"ab": -0.5}
    trie = token_counts.Trie(scores)
    assert [trie[w] for w in ("abab", "xyzxyzxyzxyz", "abab", "abc")] == [(2, -1.0), (12, -12.0), (2, -1.0), (2, -1.5)]


def test_what_a_task_holds_is_bounded(monkeypatch):
    """Words that come again and again, and new ones between them: neither nodes nor what is carried along grows without end."""
    monkeypatch.setattr(token_counts, "MOST_NODES", 500)
    monkeypatch.setattr(token_counts, "MOST_HELD", 300)
    trie, rng = token_counts.Trie({bytes([b]): -1.0 for b in range(256)}), random.Random(1)
    fresh = {}
    for i in range(20_000):
        w = f"w{rng.randrange(250)}" if i % 2 else f"n{i}"
        assert trie[w] == (len(w), -float(len(w)))
        fresh[w] = 1
        assert len(trie) <= 300 and len(trie.before) <= 300 and len(trie.best) <= 520
    assert len(fresh) > 10_000


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r["held_out"] for r in got} == {zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got} == {True, False}
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_odd_rows(spark, odd, empty):
    got = language_id.identify(odd).collect()
    assert len(got) == len(ODD)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {1, 2, 6} and all(r["score"] == 0.0 for r in got if r["doc_id"] in und)
    assert language_id.identify(empty).collect() == []
    unlabelled = odd.withColumn("lang", functions.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_language_id_learns_rare_labels(spark):
    rng = random.Random(5)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(12))
    rows = [(i, text("abcdefgh"), "aa", 0) for i in range(4000)] + [(5000 + i, text("stuvwxyz"), "zz", 0) for i in range(4)] + [(6000, text("klmnop"), "mm", 0)]
    settings = language_id.Settings(sample_rows=60, label_rows=20)
    docs = spark.createDataFrame(rows, COLUMNS)
    model = language_id.train(docs, settings)
    assert model.langs == ["aa", "mm", "zz"]
    got = language_id.predict(docs, model, keep=("lang",)).collect()
    assert len(got) == len(rows) and all(r["lang"] == r["lang_pred"] for r in got)
    assert language_id.train(docs.limit(0), settings) is None


def test_only_texts_of_learned_languages_are_accepted(spark):
    """Other scripts and random letters are nearest to some learned language too, but few of their n-grams have a weight."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    rng = random.Random(4)
    junk = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(20))
    rows = [(10_000 + i, junk(a), None, None, 1) for i, a in enumerate(["абвгдежзиклмн", "αβγδεζηθικλμν", "qwxzjkvbgfpyh"] * 5)] + [(1, None, None, "s", 1), (2, "123 !", "en", "s", 1)]
    clean = docs.withColumn("lang", functions.when(functions.col("doc_id") % 2 == 0, functions.col("lang")))
    assert all(model.least > 0.7) and 1e-4 < model.temperature < 1e4
    got = language_id.accepted(clean.unionByName(spark.createDataFrame(rows, docs.schema)), model)
    assert got.columns == docs.columns
    got = {r["doc_id"]: r["lang"] for r in got.collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.where("text rlike '[a-zA-Z]'").collect()}
    assert got.keys() == want.keys()
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(want)


def test_documents_of_rare_labels_stay(spark):
    """Five documents of a script that nothing else is written in: too few to say how much of it should be known."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    greek = ["Η γλώσσα είναι ένα σύστημα επικοινωνίας μεταξύ ανθρώπων", "Ο καιρός σήμερα είναι καλός και ο ήλιος λάμπει", "Το βιβλίο βρίσκεται πάνω στο τραπέζι της κουζίνας", "Πότε φεύγει το επόμενο τρένο για τη Θεσσαλονίκη", "Χθες πήγαμε στη θάλασσα με τα παιδιά"]
    rare = spark.createDataFrame([(20_000 + i, x, "el", "s", len(x)) for i, x in enumerate(greek)], docs.schema)
    model = language_id.train(docs.unionByName(rare))
    assert dict(zip(model.langs, model.least.tolist(), strict=True))["el"] == -1.0
    assert language_id.accepted(rare, model).count() == 5
    short = spark.createDataFrame([(1, "Zyx", None, "s", 3), (2, "The", None, "s", 3)], docs.schema)
    assert language_id.accepted(short, model).count() == 2


def test_temperature_has_a_least_loss():
    """Rows that are all predicted right, or all alike, ask for no endless certainty; and the least is found."""
    import numpy as np

    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 300)
    for wrong, scale in ((0, 0.01), (0, 1.0), (40, 1.0), (40, 300.0)):
        z = rng.normal(0, 1, (300, 3)) * 0.5
        z[np.arange(300), y] += 6
        z[:wrong] = np.roll(z[:wrong], 1, axis=1)
        z *= scale
        found = language_id.temperature(z, y, np.zeros(3), np.full(3, 1 / 3))

        def loss(t, z=z):
            p = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            truth = np.full((300, 3), 1 / 302 / 3)
            truth[np.arange(300), y] += 301 / 302
            return -(truth * np.log(p)).sum(axis=1).mean()

        assert scale * 0.05 < found < scale * 20
        assert all(loss(found) <= loss(found * f) + 1e-9 for f in (0.9, 0.97, 1.03, 1.1))


def test_language_id_is_the_stated_classifier(spark):
    """Follow-the-regularised-leader and the logits by plain loops, one row for each of three labels."""
    import numpy as np

    s = language_id.Settings(bits=12, shards=1, l1=0.005)
    rows = [(1, "Anna und otto", "de", 0), (2, "the cat sat. ON the mat", "en", 0), (3, "le chat noir", "fr", 0)]
    model = language_id.train(spark.createDataFrame(rows, COLUMNS), s)

    def grams(text):
        c = [32] * 2 + [ord(x.lower()) if x.isalpha() else 32 for x in text] + [32] * 2
        mix = lambda v, m: (v * m & 0xFFFFFFFF) >> (32 - s.bits)
        out = [mix(a, 2654435761) for a in c if a != 32]
        out += [mix(a * 40503 + b & 0xFFFFFFFF, 2246822519) for a, b in zip(c, c[1:], strict=False) if (a, b) != (32, 32)]
        return out + [mix((a * 40503 + b & 0xFFFFFFFF) * 40503 + d & 0xFFFFFFFF, 3266489917) for a, b, d in zip(c, c[1:], c[2:], strict=False) if b != 32]

    size, labels = 1 << s.bits, ["de", "en", "fr"]
    df = Counter(f for _, x, _, _ in rows for f in set(grams(x)))
    idf = [math.log(4 / (1 + df[f])) + 0.1 for f in range(size)]
    z, q = np.zeros((size, 3)), np.zeros((size, 3))
    weight = lambda f, k: 0.0 if abs(z[f, k]) <= s.l1 else -(z[f, k] - math.copysign(s.l1, z[f, k])) / ((s.beta + math.sqrt(q[f, k])) / s.alpha + s.l2)
    import pandas as pd

    for i in pd.DataFrame(rows, columns=["key", "text", "lang", "x"]).sample(frac=1, random_state=7).index:
        n = Counter(grams(rows[i][1]))
        v = {f: c * idf[f] / math.sqrt(sum(n.values())) for f, c in n.items()}
        score = [sum(x * weight(f, k) for f, x in v.items()) for k in range(3)]
        p = [math.exp(x) / sum(map(math.exp, score)) for x in score]
        for k in range(3):
            error = p[k] - (labels[k] == rows[i][2])
            for f, x in v.items():
                g, w = x * error, weight(f, k)
                z[f, k] += g - (math.sqrt(q[f, k] + g * g) - math.sqrt(q[f, k])) / s.alpha * w
                q[f, k] += g * g
    texts = ["the otto", "Chat, noir", "x"]
    want = [[sum(idf[f] * weight(f, k) for f in grams(x)) / math.sqrt(len(grams(x))) for k in range(3)] for x in texts]
    got, _, _ = model.logits(texts, language_id.Features(s.bits))
    assert np.allclose(got, want, atol=1e-5)
    assert model.langs == labels and np.abs(np.array(want)).max() > 0.05


def test_language_id_beyond_the_basic_plane(spark, odd):
    emoji = spark.createDataFrame([(20, "\U0001f600\U0001f680 \U0001f44d", None, 7)], COLUMNS)
    got = {r["doc_id"]: r for r in language_id.identify(odd.unionByName(emoji)).collect()}
    assert (got[20]["lang_pred"], got[20]["score"]) == ("und", 0.0)
    made = language_id.Features(16)
    (one, two, three), _, has = made.of(["ab", "cd"])
    assert [(x < 1 << 16).tolist() for x in (one, two, three)] == [[False, True, True, False] * 2, [True, True, True, False] * 2, [True, True, False, False] * 2]
    alone, _, _ = made.of(["ab"])
    assert all(x[:4].tolist() == y.tolist() for x, y in zip((one, two, three), alone, strict=True))  # whatever comes after
    (one, _, _), _, has = made.of(["\U00010330", "\U00010331", "\U00010400", "\U00010428", "\U0001f600"])
    assert has.tolist() == [True] * 4 + [False]
    assert one[1] != one[4] and one[7] == one[10]  # two Gothic letters; a Deseret letter in upper and lower case


def brute_contained(docs, items, k=5, least=0.8):
    out = []
    for d, x in docs:
        w = decontaminate.words_of(x)
        for i, y in items:
            v = decontaminate.words_of(y)
            n = min(k, len(v))
            if n:
                s, t = decontaminate.shingle_set(v, n), decontaminate.shingle_set(w, n)
                if len(s & t) >= least * len(s) - 1e-9:
                    out.append((d, i, len(s & t), len(s)))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    draw = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [(i, draw(n)) for i, n in enumerate([4, 5, 6, 9, 20, 33, 60, 100, 300])] + [(50, None), (51, ""), (52, "--")]
    docs = [(100 + i, f"{draw(rng.randrange(0, 400))} {t.upper() if t and i % 2 else t}, {draw(rng.randrange(0, 400))}") for i, (_, t) in enumerate(items)]
    broken = items[6][1].split()
    broken[10] = "changed"
    docs += [(200, draw(3000) + " " + " ".join(broken) + " " + draw(3000)), (201, None), (202, ""), (203, draw(2)), (100, docs[0][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:4] for r in decontaminate.contained(d, b).collect()), key=str)
    assert got == brute_contained(docs, items)
    assert {r[0] for r in got} >= {100 + i for i in range(9)} | {200}
    kept = decontaminate.clean(d, b).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(x[0] for x in docs if x[0] not in {r[0] for r in got})


def test_decontamination_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(odd, none).collect() == []
    assert decontaminate.contained(empty, odd.selectExpr("doc_id item_id", "text")).collect() == []
    assert decontaminate.clean(odd, none).count() == len(ODD)
