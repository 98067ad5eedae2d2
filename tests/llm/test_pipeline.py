"""The pipeline's stages against brute force, each on its own input, and the registry."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from melodex.llm import decontaminate, line_dedup, registry, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def made(spark):
    """Input and output of each stage over the smallest tables with odd rows added."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    copied = docs.orderBy("doc_id").first()["text"]
    odd = [(9000, None, "en", "s", None), (9001, "", "en", "s", 0), (9002, "12 34", "en", "s", 5), (9003, copied, "fr", None, None), (9004, "Before it. " + leak.upper() + " And after.", None, "s", 1)]
    docs, steps = docs.unionByName(spark.createDataFrame(odd, docs.schema)), []
    for name, f in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(f(spark, docs, sf), name)
        steps.append((name, docs.collect(), out.collect(), out.columns))
        docs = out
    return {name: rest for name, *rest in steps}


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_columns(made):
    assert all(columns == COLUMNS for name, (_, _, columns) in made.items() if name != "mixing")
    assert made["mixing"][2] == [*COLUMNS, "pass"]


def test_language_stage(made):
    before, after, _ = made["language_id"]
    assert set(ids(before)) - set(ids(after)) == {9000, 9001, 9002}


def test_line_stage(made):
    before, after, _ = made["line_dedup"]
    order, want = [], {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        kept = []
        for line in line_dedup.lines_of(r["text"]):
            w = line_dedup.words_of(line)
            if not w or not any(w == v or len(w) >= 5 and len(v) >= 5 and line_dedup.within_one(v, w) for v in order):
                kept.append(line)
            if w:
                order.append(w)
        text = "\n".join(kept)
        if text == r["text"] or text.split():
            want[r["doc_id"]] = text
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert 9003 not in want


def test_simhash_stage(made):
    before, after, _ = made["simhash_dedup"]
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in before}
    least = {}
    for a in sorted(fps):
        near = [least[b] for b in least if (fps[a] ^ fps[b]).bit_count() <= 3]
        least[a] = min([a, *near])
        for b in least:
            least[b] = least[a] if least[b] in near else least[b]
    assert ids(after) == sorted(set(least.values()))


def test_decontamination_stage(spark, made):
    before, after, _ = made["decontamination"]
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    sets = [decontaminate.shingle_set(w, min(5, len(w))) for w in items]
    bad = {r["doc_id"] for r in before if any(s and len(s & decontaminate.shingle_set(decontaminate.words_of(r["text"]), 5)) >= 0.8 * len(s) for s in sets)}
    assert ids(after) == sorted(set(ids(before)) - bad)
    assert 9004 in bad or 9004 not in ids(before)


def test_mixing_stage_keeps_every_document(made):
    before, after, _ = made["mixing"]
    assert set(ids(after)) == set(ids(before))
    assert len({(r["doc_id"], r["pass"]) for r in after}) == len(after)


def through(spark, docs):
    for name, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(f(spark, docs, "/root/testdata/sf0.001"), name)
    return docs


def test_an_empty_table_goes_through(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = through(spark, docs.limit(0))
    assert (out.columns, out.count()) == ([*docs.columns, "pass"], 0)


def test_clashing_columns_and_a_long_text_go_through(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = ["pass", "_pass", "_src", "_block", "gone", "kept", "copy", "fp", "tokens", "passes", "shard", "n_tokens"]
    long = " ".join(f"the{i % 90_001}" for i in range(200_000))  # one line of 1.4 MB
    more = spark.createDataFrame([(2**53 + 1, long, "en", None, len(long)), (None, long + " end", "en", "s", 1)], docs.schema)
    docs = docs.limit(60).unionByName(more).withColumns({x: F.lit(x) for x in names})
    out = through(spark, docs)
    assert out.columns == [*docs.columns, "__pass"]
    rows = out.collect()
    assert all(r[x] == x for r in rows for x in names)
    assert [r["doc_id"] for r in rows if len(r["text"]) > 1_000_000] == [None]  # the first by id; the other repeats its line but for a word


def test_registry():
    found = __spark_entry__.queries()
    assert set(registry.QUERIES) | {"pipeline"} <= set(found)
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parent.parent.parent
    users = [p for p in (root / "melodex").rglob("*.py") if "llm" not in p.parts and "melodex.llm" in p.read_text()]
    assert users == []
