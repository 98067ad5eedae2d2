"""Grouping of spelling variants by reduced alphabets.

Letters are hashed to a few symbols. A word's reduced form and everything within one edit of that (each symbol left out, replaced
by each other, one put in at each place) are its neighbourhood. Neighbourhoods are joined with the reduced vocabulary: two
words one edit apart have reduced forms at most one edit apart, so they always meet; who meets is verified on the words
themselves. The keys are as many as eight symbols make, not as the letters of the script would. Neighbourhoods are mutual, so
of each pair one word asks and the other is found: a word emits the two sevenths of its neighbourhood that it asks for.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, record, remove, table, written

LEAST_LETTERS, LEAST_COUNT = 6, 5
SYMBOLS = 8
#: A form is so many times as frequent as the word.
TIMES = 5
BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2**64
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 200_000


def as_it_is(id_: str, word: str) -> str:
    return word


def _runs(text: str, least: int) -> list[bytes]:
    """Maximal runs of at least so many of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, as Latin-1."""
    return re.findall(rb"[a-z\xc0-\xff]{%d,}" % least, text.encode("latin-1", "replace").lower())


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, change: Callable[[str, str], str] = as_it_is) -> DataFrame:
    """(word, n): the words of at least so many letters that occur at least so often in all texts.

    ``change`` makes of a document's id, as text, and a word the word that counts, never a longer one; one of fewer letters
    does not count. A null text has no words, a null id is the empty text.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            return record(word=pa.array(total.keys(), pa.string()), n=pa.array(total.values(), pa.int64()))

        for batch in batches:
            for id_, x in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w, n in Counter(_runs(x, letters)).items():
                    word = change(id_, w.decode("latin-1"))
                    if len(word) >= letters:
                        total[word] += n
                if len(total) > HELD_WORDS:
                    yield made()
                    total.clear()
        yield made()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def reduced(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The letters' symbols of all words, and how many each word has."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    return ((points.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(16)) % np.uint64(symbols)).astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


class Neighbourhoods:
    """Keys of words of symbols and of all that is within one edit of them: polynomials, each in constant time from prefix sums."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, count: int):
        self.value = np.random.default_rng(12).integers(1, 1 << 63, count, dtype=np.uint64)
        self.symbols, self.lengths = symbols, lengths
        size = int(lengths.max(initial=0)) + 1
        self.power, inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (BASE, pow(BASE, -1, 1 << 64)))
        self.back = inverse[1]
        ends = np.cumsum(lengths)
        self.starts = ends - lengths
        self.place = np.arange(len(symbols)) - np.repeat(self.starts, lengths)
        self.through = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[symbols] * self.power[self.place], dtype=np.uint64)])

    @staticmethod
    def key(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = (x ^ (n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    def whole(self) -> np.ndarray:
        return self.key(self.through[self.starts + self.lengths] - self.through[self.starts], self.lengths)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """(word's place, key), each key of a word once: of a neighbourhood what this word asks for, so that of any two words
        one edit apart just one asks for the other, and two of one form each for the other: the longer leaves a symbol out (of a
        run of one symbol any makes the same, so only the first is), the one of the smaller symbol replaces it by each larger."""
        n, words = self.lengths, np.arange(len(self.lengths))
        word = np.repeat(words, n)
        at = np.arange(len(self.symbols))
        front = self.through[at] - self.through[self.starts[word]]
        tail = self.through[(self.starts + n)[word]] - self.through[at + 1]
        new = (self.place == 0) | (self.symbols != np.concatenate([[-1], self.symbols[:-1]]))
        out = [(words, self.whole()), (word[new], self.key(front + tail * self.back, n[word] - 1)[new])]
        for s, v in enumerate(self.value):
            less = self.symbols < s
            out.append((word[less], self.key((front + v * self.power[self.place] + tail)[less], n[word[less]])))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of some 20,000 letters each, or one word."""
    lengths = np.fromiter(map(len, batch.column("word").to_pylist()), np.int64, batch.num_rows)
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // 20_000, prepend=0))
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if j > i:
            yield batch.slice(i, j - i)


def one_edit(a: str, b: str) -> bool:
    """Whether just one code point put in, left out or replaced makes one of the other."""
    more = len(a) - len(b)
    if a == b or abs(more) > 1:
        return False
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    return a[i + (more >= 0) :] == b[i + (more <= 0) :]


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): all pairs, both ways, of the distinct ``words`` (id, word, n) that differ by just one code point put
    in, left out or replaced. Each pair is asked for from one side; its ids then meet the words again to be verified."""

    def made(batch: pa.RecordBatch) -> Neighbourhoods:
        return Neighbourhoods(*reduced(batch.column("word").to_pylist(), symbols), symbols)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                at, keys = made(some).asked()
                yield record(key=keys, a=some.column("id").take(pa.array(at)), equal=pa.array(np.arange(len(at)) < some.num_rows))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                yield record(key=made(some).whole(), b=some.column("id"))

    some = words.select("id", "word")
    pairs = some.mapInArrow(asked, "key long, a long, equal boolean").join(some.mapInArrow(whole, "key long, b long"), "key").where("a < b or a > b and not equal").select("a", "b")
    side = lambda id_, word, n: words.select(F.col("id").alias(id_), F.col("word").alias(word), F.col("n").alias(n))
    met = pairs.join(side("a", "word", "n"), "a").join(side("b", "near", "near_n"), "b").select("word", "n", "near", "near_n")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.filter(pa.array(list(map(one_edit, batch.column("word").to_pylist(), batch.column("near").to_pylist())), pa.bool_()))
            yield good
            yield record(word=good.column("near"), n=good.column("near_n"), near=good.column("word"), near_n=good.column("n"))

    return met.mapInArrow(verified, met.schema)


def grouped(words: DataFrame, times: int = TIMES, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each of the distinct ``words`` (word, n).

    form: of the near words the most frequent (ties: the smallest in code-point order) if it is ``times`` as frequent, else
    null. root: where the forms lead to. A form's count is a multiple of its word's, so chains are short and never
    close: places are doubled until no root moves. An empty table gives no rows. The result is written.
    """
    spark = words.sparkSession
    paths = [new_path(spark, "vocabulary")]
    words = written(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary", paths[0])
    best = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    paths.append(new_path(spark, "forms"))
    found = written(found, "forms", paths[-1])
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        paths.append(new_path(spark, "roots"))
        links = written(links, "roots", paths[-1])
        if links.where("moved").isEmpty():
            break
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
    out = written(found.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word")), "variants")
    remove(spark, paths)
    return out


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Callable[[str, str], str] = as_it_is) -> DataFrame:
    """``grouped`` of the ``vocabulary`` of whole texts. Repeated rows count each; other columns are ignored; a table without
    words gives no rows."""
    return grouped(vocabulary(docs, key, text, change=change))


def thinned(id_: str, word: str) -> str:
    """The query's planted misspellings: without one letter where 199 divides the crc32 of id and word."""
    h = zlib.crc32(f"{id_}:{word}".encode())
    i = h % len(word)
    return word if h % 199 else word[:i] + word[i + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"), change=thinned).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLE: dict[str, str] = {}
