"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

The test items are the queries. A document's shingles form a stream that is cut into windows, so that a short item and
the part of a long document that holds it are of like size: items of up to c shingles are sought in windows of 2c that
start every c, and so lie whole in one of them. In each size partition the number of hash functions follows from the
least Jaccard similarity that a containment of ``threshold`` leaves, for a miss probability of at most ``miss``. Any equal
minimum makes a candidate; a candidate counts if the document holds enough of the item's shingles, compared as words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_texts, record, table, texts

WORD = re.compile(r"[^\W_]+")
#: Items are broadcast in blocks of about so many characters; every block is compared with all documents.
BLOCK_CHARS = 4_000_000
#: Shingles that are hashed at once.
STREAM = 32_768
SEED = 20_011


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    miss: float = 1e-4
    base: int = 16  # the smallest size partition


class Words(dict):
    """64-bit hashes of words, kept for those that come again."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: object) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingle_set(words: list[str], k: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@dataclass
class Part:
    """The items of one size partition: those of k-word shingles, more than half of ``size`` of them and at most ``size``."""

    k: int
    size: int
    ids: list = field(default_factory=list)
    sets: list = field(default_factory=list)
    hashes: list = field(default_factory=list)
    multipliers: np.ndarray | None = None
    minima: list = field(default_factory=list)  # of each hash function: the items' minima in order, and whose they are

    def finish(self, s: Settings) -> Part:
        least = min(map(len, self.hashes))
        j = s.threshold * least / (2 * self.size + (1 - s.threshold) * least)
        n = max(1, math.ceil(math.log(s.miss) / math.log1p(-j)))
        self.multipliers = np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        all_minima = np.array([[(h * m).min() for h in self.hashes] for m in self.multipliers])
        for row in all_minima:
            order = np.argsort(row, kind="stable")
            self.minima.append((row[order], order))
        return self


def index(items: list[tuple[object, str]], s: Settings) -> list[Part]:
    """Items with fewer than ``words`` words count as one shingle; those without a word match nothing."""
    made, parts = Words(), {}
    for item, text in items:
        words = words_of(text)
        if not words:
            continue
        k = min(s.words, len(words))
        shingles = shingle_set(words, k)
        size = max(s.base, 1 << (len(shingles) - 1).bit_length())
        p = parts.setdefault((k, size), Part(k, size))
        p.ids.append(item)
        p.sets.append(shingles)
        p.hashes.append(np.unique(shingle_hashes(made.of(words), k)))
    return [p.finish(s) for _, p in sorted(parts.items())]


def _minima(stream: np.ndarray, multipliers: np.ndarray, size: int) -> np.ndarray:
    """For each hash function the least value in each window of 2 ``size``, one every ``size``."""
    pad = -len(stream) % size
    out = []
    for m in multipliers:
        h = stream * m
        if pad:
            h = np.concatenate([h, np.full(pad, 2**64 - 1, np.uint64)])
        n = size
        while n > 1 and n % 2 == 0:
            h = np.minimum(h[::2], h[1::2])
            n //= 2
        out.append(np.minimum(h, np.append(h[1:], np.uint64(2**64 - 1))))
    return np.array(out)


def _search(docs: list[list[str]], made: Words, parts: list[Part], s: Settings) -> Iterator[tuple[int, object, int, int]]:
    """(place of the document, item, shared shingles, the item's shingles) of those at or over the threshold."""
    hashed = [made.of(w) for w in docs]
    for k in sorted({p.k for p in parts}):
        runs = [shingle_hashes(h, k) for h in hashed]
        ends = np.cumsum([len(r) for r in runs])
        stream = np.concatenate(runs) if runs else np.empty(0, np.uint64)
        if not len(stream):
            continue
        found: set[tuple[int, int, int]] = set()
        for at, p in enumerate(parts):
            if p.k != k:
                continue
            minima = _minima(stream, p.multipliers, p.size)
            for row, (values, whose) in zip(minima, p.minima, strict=True):
                lo = np.searchsorted(values, row)
                hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == row)
                for w in hit.tolist():
                    first = int(np.searchsorted(ends, w * p.size, side="right"))
                    last = int(np.searchsorted(ends, min((w + 2) * p.size, len(stream)) - 1, side="right"))
                    i = int(lo[w])
                    while i < len(values) and values[i] == row[w]:
                        found.update((d, at, int(whose[i])) for d in range(first, last + 1))
                        i += 1
        sets: dict[int, set] = {}
        for d, at, i in sorted(found):
            p = parts[at]
            if d not in sets:
                sets = {d: shingle_set(docs[d], k)}
            shared = len(p.sets[i] & sets[d])
            if shared >= s.threshold * len(p.sets[i]) - 1e-9:
                yield d, p.ids[i], shared, len(p.sets[i])


def _batches(texts: list, s: Settings) -> Iterator[tuple[int, list[list[str]]]]:
    """Groups of neighbouring texts as words, of about ``STREAM`` words each, with the place of the first."""
    first, group, n = 0, [], 0
    for i, x in enumerate(texts):
        group.append(words_of(x))
        n += len(group[-1])
        if n >= STREAM:
            yield first, group
            first, group, n = i + 1, [], 0
    if group:
        yield first, group


def _blocks(benchmark: DataFrame, item: str, text: str, s: Settings) -> Iterator[list[Part]]:
    """The items in blocks of bounded size, indexed."""
    b = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null")
    chars = b.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = math.ceil(chars / BLOCK_CHARS)
    for i in range(n):
        mine = b if n == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield index(sorted(((r[0], r[1]) for r in mine.collect()), key=str), s)


def contained(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): pairs where the document holds enough of the item.

    Words are runs of letters and digits in lower case; shingles of five words (all words of a shorter item); a pair
    counts from a share of 0.8 of the item's distinct shingles. Null or empty texts on either side match nothing; an
    empty table gives no rows; repeated rows each give their pairs; other columns are ignored. Whole texts are read.
    """
    s, spark = settings, docs.sparkSession
    id_type, item_type = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_arrow = to_arrow_type(benchmark.schema[item].dataType)
    schema = f"doc_id {id_type}, item_id {item_type}, shared int, item_shingles int, containment double"
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    out = spark.createDataFrame([], schema)
    for parts in _blocks(benchmark, item, item_text, s):
        shared = spark.sparkContext.broadcast(parts)

        def run(batch: pa.RecordBatch, made: Words, shared=shared) -> Iterator[pa.RecordBatch]:
            got = [(first + d, i, n, of, n / of) for first, group in _batches(texts(batch), s) for d, i, n, of in _search(group, made, shared.value, s)]
            if got:
                at, items, n, of, share = zip(*got, strict=True)
                yield record(doc_id=batch.column("doc_id").take(pa.array(at)), item_id=pa.array(items, item_arrow), shared=pa.array(n, pa.int32()), item_shingles=pa.array(of, pa.int32()), containment=share)

        out = out.unionAll(map_texts(rows, run, schema, Words))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark (as ``contained`` decides)."""
    s, spark = settings, docs.sparkSession
    for parts in _blocks(benchmark, item, item_text, s):
        shared = spark.sparkContext.broadcast(parts)

        def run(batch: pa.RecordBatch, made: Words, shared=shared) -> Iterator[pa.RecordBatch]:
            bad = {first + d for first, group in _batches(texts(batch, text), s) for d, *_ in _search(group, made, shared.value, s)}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)])) if bad else batch

        docs = map_texts(docs, run, docs.schema, Words)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE = {
    "op9_decontamination": """
    WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w, row_number() OVER () AS item FROM benchmark),
    items AS (SELECT *, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
    wanted AS (SELECT DISTINCT item, item_id, k, w[n:n + k - 1] AS shingle FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS n FROM items)),
    sizes AS (SELECT item, count(*)::INT AS item_shingles FROM wanted GROUP BY item),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w, row_number() OVER () AS doc FROM documents),
    held AS (
        SELECT DISTINCT doc, doc_id, k, w[n:n + k - 1] AS shingle
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS n FROM d, (SELECT DISTINCT k FROM items))),
    met AS (SELECT doc, doc_id, item, item_id, count(*)::INT AS shared FROM held JOIN wanted USING (k, shingle) GROUP BY ALL)
    SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
    FROM met JOIN sizes USING (item) WHERE shared >= 0.8 * item_shingles - 1e-9"""
}
