"""Line dedup by a deletion-neighbourhood join.

Lines are sequences of words. Lines of at least ``least_words`` words are near copies at an edit distance of one word (one put
in, left out or replaced), others only if equal: with the least of five words one edit leaves a similarity of 0.8. Each line
emits the hashes of itself and of itself without each word; lines with equal hashes are joined and verified by edit distance,
and the earliest stays. All lines without one and the same place are a word apart from each other, so they are joined with the
earliest of them only, never among themselves. The variants' hashes are polynomials over the hashes of the words, so that all
of a line take time in proportion to its length.

Before that, a filter keeps lines that can have a near copy at all: of two lines a word apart the longest common front or
the longest common end has at least half the words of the shorter, so both emit that half's hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, copy_of, fresh, map_texts, record, table, texts, written

#: Lines of fewer words repeat only their equals.
LEAST_WORDS = 5
#: A set of up to so many line hashes is broadcast; beyond, lines meet it in a shuffle.
BROADCAST_HASHES = 400_000
BASE = 0x9E3779B97F4A7C13  # odd: it has an inverse modulo 2**64


def lines_of(text: object) -> list[str]:
    return text.split("\n") if isinstance(text, str) else []


def words_of(line: str) -> list[bytes]:
    """Words between white space (\\x20 and \\x09-\\x0D), A-Z in lower case."""
    return line.encode("utf-8", "replace").lower().split()


def line_hash(words: bytes, salt: int = 0) -> int:
    """Of the words of a line, joined by a space, as a signed long."""
    x = xxhash.xxh3_64_intdigest(words, salt)
    return x - (1 << 64) if x >> 63 else x


def halves(words: list[bytes]) -> list[int]:
    """Hashes of front and end halves, for a partner of like length or longer, and for a shorter one."""
    out = []
    for n in (len(words), len(words) - 1):
        h = n // 2
        out += [line_hash(b" ".join(words[:h]), 2 * n + 1), line_hash(b" ".join(words[-h:]), 2 * n + 2)]
    return out


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance in words is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


class Hashes(dict):
    """Hashes of words, kept for those that come again, and powers of the base; made once in each task."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most, self.powers = most, np.ones((2, 1), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def upto(self, n: int) -> np.ndarray:
        """The powers 0 to n of the base and of its inverse."""
        if n >= self.powers.shape[1]:
            size = max(1024, 2 * n)
            self.powers = np.ones((2, size + 1), np.uint64)
            for row, base in zip(self.powers, (BASE, pow(BASE, -1, 1 << 64)), strict=True):
                row[1:] = np.multiply.accumulate(np.full(size, base, np.uint64))
        return self.powers

    def sums(self, lines: list[list[bytes]]) -> Sums:
        if len(self) > self.most:
            self.clear()
        n = np.fromiter(map(len, lines), np.int64, len(lines))
        return Sums(self, np.fromiter(map(self.__getitem__, chain.from_iterable(lines)), np.uint64, int(n.sum())), n)


class Sums:
    """Prefix sums of hash times power over each of several lines; each variant hashes in constant time."""

    def __init__(self, made: Hashes, hashes: np.ndarray, n: np.ndarray):
        self.n, self.starts = n, np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        power, self.inverse = made.upto(int(n.max(initial=0)))
        self.place = np.arange(len(hashes)) - np.repeat(self.starts, n)
        self.through = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[self.place], dtype=np.uint64)])

    @staticmethod
    def mixed(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of polynomials of n words the hashes, as signed longs."""
        h = (x ^ (n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    def whole(self) -> np.ndarray:
        return self.mixed(self.through[self.starts + self.n] - self.through[self.starts], self.n)

    def without_each(self) -> np.ndarray:
        """Of each word the hash of its line without it: the later words move a place to the front."""
        start, end, at = np.repeat(self.starts, self.n), np.repeat(self.starts + self.n, self.n), np.arange(len(self.place))
        rest = self.through[at] - self.through[start] + (self.through[end] - self.through[at + 1]) * self.inverse[1]
        return self.mixed(rest, np.repeat(self.n, self.n) - 1)


def _lines(batch: pa.RecordBatch, least: int) -> tuple[list[int], list[int], list[list[bytes]]]:
    """Of each line of at least so many words: its row, its place in the text, its words."""
    rows, places, words = [], [], []
    for i, text in enumerate(texts(batch)):
        for at, line in enumerate(lines_of(text)):
            w = words_of(line)
            if len(w) >= least:
                rows.append(i)
                places.append(at)
                words.append(w)
    return rows, places, words


def _keys(batch: pa.RecordBatch, rows: list[int], places: list[int]) -> dict:
    at = pa.array(rows, pa.int32())
    return {"doc_id": batch.column("doc_id").take(at), "copy": batch.column("copy").take(at), "line": pa.array(places, pa.int32())}


def _occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, copy, line, h, halves) of each line with words; halves only where near copies are sought."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, places, words = _lines(batch, 1)
        if rows:
            h = [line_hash(b" ".join(w)) for w in words]
            yield record(**_keys(batch, rows, places), h=pa.array(h), halves=pa.array([halves(w) if len(w) >= least else None for w in words], pa.list_(pa.int64())))

    return map_texts(docs, run, f"doc_id {kind}, copy long, line int, h long, halves array<long>")


def _texts(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, copy, line, h, words) of each line that can have near copies; words joined by a space."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, places, words = _lines(batch, least)
        if rows:
            joined = [b" ".join(w) for w in words]
            yield record(**_keys(batch, rows, places), h=pa.array(map(line_hash, joined), pa.int64()), words=pa.array(joined, pa.binary()))

    return map_texts(docs, run, f"doc_id {kind}, copy long, line int, h long, words binary")


def _variants(lines: DataFrame) -> DataFrame:
    """(key, place, h): of each line the hash without the word at each place, and at place -1 that of the whole line."""

    def run(batch: pa.RecordBatch, made: Hashes) -> Iterator[pa.RecordBatch]:
        sums = made.sums([x.split(b" ") for x in batch.column("words").to_pylist()])
        h = batch.column("h").to_numpy()
        yield record(key=sums.without_each(), place=sums.place.astype(np.int32), h=np.repeat(h, sums.n))
        yield record(key=sums.whole(), place=np.full(len(h), -1, np.int32), h=h)

    return map_texts(lines.select("h", "words"), run, "key long, place int, h long", Hashes)


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those of (later, earlier) whose words are within the bound."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True)
        yield batch.filter(pa.array([within_one(a.split(b" "), b.split(b" ")) for a, b in words], pa.bool_())).select(["later", "earlier"])

    met = pairs.join(lines.select(F.col("h").alias("later"), F.col("words").alias("wa")), "later").join(lines.select(F.col("h").alias("earlier"), F.col("words").alias("wb")), "earlier")
    return map_texts(met.select("later", "earlier", "wa", "wb"), run, "later long, earlier long")


def _where() -> Column:
    return F.struct("doc_id", "copy", "line")


def _duplicates(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, copy, line, of) of ``docs`` (doc_id, copy, text): of has the same three fields."""
    seen = written(_occurrences(docs, least), "lines")
    classes = written(seen.groupBy("h").agg(F.min(_where()).alias("first"), F.first("halves", ignorenulls=True).alias("halves")), "classes")
    half = classes.where("halves is not null").select("h", F.explode(F.array_distinct("halves")).alias("half"))
    met = half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    can = written(half.join(met, "half", "left_semi").select("h").distinct().join(classes.select("h", "first"), "h"), "can")
    few = can.count() <= BROADCAST_HASHES
    lines = _texts(docs, least).join(F.broadcast(can) if few else can, "h").where(F.col("first").eqNullSafe(_where()))
    lines = written(lines.groupBy("h", "first").agg(F.min("words").alias("words")), "candidates")
    variants = written(_variants(lines).join(F.broadcast(can) if few else can, "h"), "variants")
    wholes, variants = variants.where("place = -1"), variants.where("place >= 0")
    groups = variants.groupBy("key", "place").agg(F.min(F.struct("first", "h")).alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "place", F.col("least.h").alias("earlier"))
    replaced = variants.join(groups, ["key", "place"]).where("h != earlier").select(F.col("h").alias("later"), "earlier")
    whole = wholes.select("key", F.col("h").alias("whole_h"), F.col("first").alias("whole_first"))
    after = F.col("first") > F.col("whole_first")
    both = variants.join(whole, "key").where("h != whole_h")
    added = both.select(F.when(after, F.col("h")).otherwise(F.col("whole_h")).alias("later"), F.when(after, F.col("whole_h")).otherwise(F.col("h")).alias("earlier"))
    near = _verified(replaced.union(added).distinct(), lines)
    near = near.join(can.select(F.col("h").alias("earlier"), "first"), "earlier").groupBy(F.col("later").alias("h")).agg(F.min("first").alias("near"))
    decided = written(classes.select("h", "first").join(near, "h", "left"), "decided")
    of = F.when(~F.col("first").eqNullSafe(_where()), F.col("first")).otherwise(F.col("near"))
    return seen.select("doc_id", "copy", "line", "h").join(decided, "h").withColumn("of", of).where("of is not null").select("doc_id", "copy", "line", "of")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), copy_of(F.col(text)).alias("copy"), F.col(text).alias("text"))


def duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, line, of_doc_id, of_line): each line that goes (counted from 0), and the earlier line that it repeats.

    Earlier is by (document id, text's hash, line): a null id comes first, texts that share an id follow each other by their
    hashes. Equal lines repeat the earliest of them; a line whose equals all have an earlier near copy goes too, whether or
    not that one stays, so the earliest line of every chain stays. Lines without words stay. A null or empty text has no
    lines; rows that share an id and a text are one document, each with its rows here; an empty table gives no rows; other
    columns are ignored. Whole texts are read.
    """
    return _duplicates(_keyed(docs, key, text), least).select("doc_id", "line", F.col("of.doc_id").alias("of_doc_id"), F.col("of.line").alias("of_line"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", least: int = LEAST_WORDS) -> DataFrame:
    """``docs``, all columns whatever their names, without the lines of ``duplicate_lines``; documents left without a word by
    that go. Each row loses the lines of its own text only; rows that share an id and a text stay or go together."""
    id_, copy, gone, kept = fresh(docs, "gone_id", "gone_copy", "gone", "kept")
    lines = _duplicates(_keyed(docs, key, text), least).groupBy(F.col("doc_id").alias(id_), F.col("copy").alias(copy)).agg(F.collect_set("line").alias(gone))
    met = docs.join(lines, F.col(key).eqNullSafe(F.col(id_)) & copy_of(F.col(text)).eqNullSafe(F.col(copy)), "left")
    met = met.select(*docs.columns, gone, F.lit(None).cast("string").alias(kept))
    names = met.columns

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rest = []
        for x, out in zip(texts(batch, text), batch.column(gone).to_pylist(), strict=True):
            if out is None:
                rest.append(None)
            else:
                out = set(out)
                rest.append("\n".join(line for i, line in enumerate(x.split("\n")) if i not in out))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rest, pa.string())], names=names)

    out = map_texts(met, run, met.schema).where(F.col(gone).isNull() | F.col(kept).rlike(r"[^\x20\x09-\x0D]"))
    new = {text: F.coalesce(kept, text)}
    if n_chars and n_chars in docs.columns:
        new[n_chars] = F.when(F.col(gone).isNull(), F.col(n_chars)).otherwise(F.length(kept)).cast(docs.schema[n_chars].dataType)
    return out.select(*[new[x].alias(x) if x in new else x for x in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(table(spark, sf_dir, "documents"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE = {
    "op2_line_dedup": f"""
    WITH texts AS (
        SELECT doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS copy, string_split(text, chr(10)) AS parts
        FROM documents WHERE text IS NOT NULL),
    raw AS (SELECT doc_id, copy, unnest(parts) AS part, (generate_subscripts(parts, 1) - 1)::INT AS line FROM texts),
    lines AS (
        SELECT doc_id, copy, line, regexp_extract_all(translate(part, '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS words FROM raw),
    classes AS (SELECT words, min({{'doc_id': doc_id, 'copy': copy, 'line': line}}) AS first FROM lines WHERE len(words) > 0 GROUP BY words),
    variants AS (
        SELECT words, first, place, list_concat(words[1:place - 1], words[place + 1:]) AS variant
        FROM (SELECT *, unnest(range(1, len(words) + 1)) AS place FROM classes WHERE len(words) >= 5)),
    groups AS (SELECT variant, place, min(first) AS first FROM variants GROUP BY ALL HAVING count(*) > 1),
    near AS (
        SELECT v.words, g.first FROM variants v JOIN groups g USING (variant, place) WHERE g.first < v.first
        UNION ALL
        SELECT CASE WHEN v.first > c.first THEN v.words ELSE c.words END, least(v.first, c.first)
        FROM variants v JOIN classes c ON v.variant = c.words WHERE len(c.words) >= 5),
    nearest AS (SELECT words, min(first) AS near FROM near GROUP BY words),
    decided AS (
        SELECT l.doc_id, l.line, CASE WHEN c.first <> {{'doc_id': l.doc_id, 'copy': l.copy, 'line': l.line}} THEN c.first ELSE n.near END AS of
        FROM lines l JOIN classes c USING (words) LEFT JOIN nearest n USING (words))
    SELECT doc_id, line, of.doc_id AS of_doc_id, of.line AS of_line FROM decided WHERE of IS NOT NULL"""
}
