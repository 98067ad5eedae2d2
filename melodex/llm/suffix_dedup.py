"""Suffix-array dedup: of each document the bytes that lie in a string of ``width`` bytes found in a smaller document too.

No task can sort the suffixes of a whole corpus, so they are dealt into shards in which all equal strings of ``width`` bytes
meet. Of the hashes of the strings of ``GRAM`` bytes in it, a string's least is its anchor. Neighbouring strings share their
anchor, and make a passage. Only passages whose anchor is found in two documents travel, to the shard of their anchor: what is
found once has no equal. An anchor of very many documents sends its strings one by one, each to a shard by its own hash, so that
no shard grows with a frequent passage. Passages that are equal as a whole are one text, with the least of their documents.

A shard joins its texts, but those that are alone with their anchor and so differ from no other, and builds their suffix array
by induced sorting and the permuted common prefixes (``suffixes``). Neighbours in the array that share ``width`` bytes hold
equal strings; a string goes where its document is not the least of theirs.

As in the language model, documents are worked through in blocks, which exchange packed rows with buckets of anchors and with
shards. What decides is bytes; hashes only say which passages meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, parts, record, remove, table, written
from .lm_score import pack, pack_counts, unpack, unpack_counts
from .suffixes import SEPARATOR, permuted_prefixes, suffix_array

WIDTH = 50
#: Bytes of the strings whose hashes are compared for the anchor.
GRAM = 25
#: A block ends beyond so many bytes; a bucket is meant for so many anchors, a shard for so many bytes.
BLOCK_BYTES, BUCKET_ENTRIES, SHARD_BYTES = 4 << 20, 1_500_000, 3 << 20
#: Anchors of more documents send their strings one by one.
HOT = 2_000
MOST_FILES = 50_000  # of the table of blocks
MOST_WINDOWS = 64  # of a passage: one bit each in the answer
CHUNK = 1 << 14  # bytes whose hashes are made at once, for the processor's cache
BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Settings:
    width: int = WIDTH
    hot: int = HOT
    block_bytes: int = BLOCK_BYTES
    shard_bytes: int = SHARD_BYTES

    @property
    def gram(self) -> int:
        return min(GRAM, self.width)


def anchors(text: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Of each place the least hash of the grams in the string of ``width`` bytes that begins there; 0 where the text ends before."""
    n, span = len(text), width - gram + 1
    out = np.zeros(n, np.uint64)
    symbols = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    size = CHUNK + width
    powers, inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (BASE, pow(BASE, -1, 1 << 64)))
    through, one, two = np.zeros(size + 1, np.uint64), np.empty(size, np.uint64), np.empty(size, np.uint64)
    for i in range(0, n - width + 1, CHUNK):
        some = text[i : i + CHUNK + width - 1]
        m = len(some)
        np.take(symbols, some, out=one[:m])
        np.multiply(one[:m], powers[:m], out=one[:m])
        np.cumsum(one[:m], out=through[1 : m + 1])
        m += 1 - gram
        h, spare = one, two
        np.subtract(through[gram : gram + m], through[:m], out=h[:m])
        np.multiply(h[:m], inverse[:m], out=h[:m])
        np.right_shift(h[:m], np.uint64(32), out=spare[:m])
        np.bitwise_xor(h[:m], spare[:m], out=h[:m])
        np.multiply(h[:m], np.uint64(0xD6E8FEB86659FD93), out=h[:m])
        have = 1
        while have < span:
            more = min(have, span - have)
            m -= more
            np.minimum(h[:m], h[more : m + more], out=spare[:m])
            h, spare = spare, h
            have += more
        out[i : i + m] = h[:m]
    return out


class Block:
    """Documents of one row of ``_blocks``."""

    def __init__(self, row: dict, settings: Settings):
        self.block, self.settings = row["block"], settings
        self.ids, self.none = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["none"], bool)
        self.raw = row["text"]
        self.text = np.frombuffer(self.raw, np.uint8)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    @cached_property
    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each passage: where it begins, its strings, its anchor, its document's place. Documents without an id have none."""
        width, n = self.settings.width, len(self.text)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found, valid = anchors(self.text, width, self.settings.gram), np.ones(n, bool)
        for start, end, none in zip(self.starts.tolist(), self.ends.tolist(), self.none.tolist(), strict=True):
            valid[start if none else max(start, end - width + 1) : end] = False
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (found[1:] != found[:-1])
        starts = np.flatnonzero(new)
        through = np.cumsum(valid, dtype=np.int32)
        windows = np.diff(through[starts], append=through[-1] + 1).astype(np.int64)
        pieces = -(-windows // MOST_WINDOWS)
        if (pieces > 1).any():
            nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            windows = np.minimum(np.repeat(windows, pieces) - nth * MOST_WINDOWS, MOST_WINDOWS)
            starts = np.repeat(starts, pieces) + nth * MOST_WINDOWS
        return starts, windows, found[starts], np.searchsorted(self.ends, starts, side="right")

    def entries(self, states: dict[int, bytes], buckets: int) -> Entries:
        """The distinct texts that travel, where each comes from and to which shard it goes."""
        starts, windows, anchor, doc = self.passages
        distinct, at = np.unique(anchor, return_inverse=True)
        state = np.zeros(len(distinct), np.uint8)
        cuts = _cuts(distinct, buckets)
        for b, x in states.items():
            state[cuts[b] : cuts[b + 1]] = np.frombuffer(x, np.uint8)
        state = state[at]
        some, hot = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        each = np.arange(int(windows[hot].sum())) - np.repeat(np.cumsum(windows[hot]) - windows[hot], windows[hot])
        start = np.concatenate([starts[some], np.repeat(starts[hot], windows[hot]) + each])
        n = np.concatenate([windows[some], np.ones(len(each), np.int64)])
        doc = np.concatenate([doc[some], np.repeat(doc[hot], windows[hot])])
        seen: dict[bytes, int] = {}
        raw, put = self.raw, seen.setdefault
        length = n + self.settings.width - 1
        of = np.fromiter((put(raw[s : s + k], len(seen)) for s, k in zip(start.tolist(), length.tolist(), strict=True)), np.int64, len(start))
        key = np.zeros(len(seen), np.uint64)
        key[of[: len(some)]] = anchor[some]
        if len(each):
            key[of[len(some) :]] = np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + self.settings.width]) for s in start[len(some) :].tolist()), np.uint64, len(each))
        ids = self.ids[doc]
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, of, ids)
        return Entries(start, n, of, ids, list(seen), key, least)


@dataclass
class Entries:
    start: np.ndarray  # of each place where a text stands
    windows: np.ndarray
    of: np.ndarray  # its text
    ids: np.ndarray  # its document
    texts: list[bytes]
    key: np.ndarray  # of each text
    least: np.ndarray

    def packed(self, order: np.ndarray) -> bytes:
        """Of each place its start, its strings, which of the texts in ``order`` it is, and whether its document is not the text's least."""
        nth = np.empty(len(order), np.int64)
        nth[order] = np.arange(len(order))
        step = np.diff(self.start, prepend=0)
        return _squeeze(b"".join(x.tobytes() for x in (step, self.windows.astype(np.uint8), nth[self.of].astype(np.uint32), self.ids > self.least[self.of])))

    @staticmethod
    def unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = _stretch(x)
        n = len(x) // 14
        step, windows, text, later = (np.frombuffer(x, kind, n, at * n) for kind, at in ((np.int64, 0), (np.uint8, 8), (np.uint32, 9), (bool, 13)))
        return np.cumsum(step), windows.astype(np.int64), text, later

    def dealt(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The texts by ascending key, and where each shard's begin among them."""
        order = np.argsort(self.key, kind="stable")
        return order, _cuts(self.key[order], shards)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the ascending keys begins, and the end."""
    edges = np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // max(2, buckets))
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


BLOCKS = "block long, ids binary, none binary, lengths binary, text binary"
SENT = "bucket int, block long, keys binary, docs binary, lengths binary, texts binary"
ANSWER = "block long, kind int, bucket int, value binary"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def _squeeze(x: bytes) -> bytes:
    return zstandard.compress(x, 1)


_stretch = zstandard.decompress


def _blocks(docs: DataFrame, key: str, text: str, settings: Settings, path: str) -> str:
    """A table of blocks, in buckets by block: later passes meet them in place."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0

        def block() -> pa.RecordBatch:
            return record(
                block=[uuid.uuid4().int >> 65], ids=[np.array([x or 0 for x in ids], np.int64).tobytes()], none=[bytes(x is None for x in ids)],
                lengths=[np.fromiter(map(len, held), np.int64, len(held)).tobytes()], text=[b"".join(held)],
            )

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                for id_, x in zip(some.column("id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids.append(id_)
                    held.append(x)
                    n += len(x)
                    if n >= settings.block_bytes or len(ids) >= settings.block_bytes // 8:
                        yield block()
                        ids, held, n = [], [], 0
        if ids:
            yield block()

    made = rows.mapInArrow(run, BLOCKS)
    name, n = f"suffix_blocks_{uuid.uuid4().hex}", min(MOST_FILES, max(8, 2 * rows.rdd.getNumPartitions()))
    made.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "block").saveAsTable(name)
    return name


def _found_twice(blocks: DataFrame, buckets: int, width: int, settings: Settings, path: str) -> DataFrame:
    """To each block of each of its distinct anchors 0 (found once), 1 (found again), 2 (found very often): kind 1. Kind 0: passages found again.

    Anchors are told apart by their first ``width`` bytes: a mistake lets a passage travel in vain, no more.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                _, _, anchor, doc = Block(row, settings).passages
                order = np.argsort(anchor, kind="stable")
                anchor, doc = anchor[order], doc[order]
                new = np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(anchor)]
                other = new.copy()
                other[1:] |= doc[1:] != doc[:-1]
                first = np.flatnonzero(new)
                count, keys = np.add.reduceat(other, first, dtype=np.int64) if len(first) else first, anchor[first]
                cuts = _cuts(keys, buckets)
                out = [(b, row["block"], pack(keys[i:j] >> np.uint64(64 - 8 * width), width), pack_counts(count[i:j]), None, None) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                yield _frame(out, SENT)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(x, width) for x in rows["keys"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([unpack_counts(x) for x in rows["docs"]]), minlength=len(every)).astype(np.int64)
        state = ((total > 1).astype(np.uint8) + (total > settings.hot))[at]
        cuts = np.cumsum([0, *map(len, keys)])
        bucket = rows["bucket"].iloc[0]
        out = [(block, 1, bucket, state[i:j].tobytes()) for block, i, j in zip(rows["block"], cuts[:-1], cuts[1:], strict=True)]
        return _frame([*out, (0, 0, bucket, int(total[total > 1].sum()).to_bytes(8, "big"))], ANSWER)

    sent = blocks.mapInPandas(send, SENT)
    return written(sent.groupBy("bucket").applyInPandas(add, ANSWER), "anchors", path, compression="zstd")


def judged(texts: list[bytes], key: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Of each of a shard's distinct texts: a bit for each of its strings that a smaller document has too."""
    marks = np.zeros(len(texts), np.uint64)
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[at] > 1)
    if not len(some):
        return marks
    lengths = np.fromiter((len(texts[i]) for i in some.tolist()), np.int64, len(some)) + 1
    ends = np.cumsum(lengths)
    joined = np.frombuffer(b"\0".join([*(texts[i] for i in some.tolist()), b""]), np.uint8).astype(np.int32) + 2
    joined[ends - 1] = SEPARATOR
    of = np.repeat(np.arange(len(some), dtype=np.int32), lengths)
    until = (np.repeat(ends - 1, lengths) - np.arange(len(joined))).astype(np.int32)
    order = suffix_array(np.append(joined, 0), 258)
    prefix = permuted_prefixes(np.append(joined, 0), order, np.append(until, 0).astype(np.int32))
    order = order[1:]  # the end's own
    order = order[until[order] >= width]
    first = np.flatnonzero(prefix[order] < width)  # no shorter suffix stands between strings that are equal
    docs = least[some][of[order]]
    lowest = np.repeat(np.minimum.reduceat(docs, first), np.diff(np.append(first, len(order))))
    gone = order[docs > lowest]
    text = of[gone]
    np.bitwise_or.at(marks, some[text], np.uint64(1) << (gone - (ends - lengths)[text]).astype(np.uint64))
    return marks


def _judge(blocks: DataFrame, found: DataFrame, buckets: int, shards: int, settings: Settings, path: str) -> DataFrame:
    """To each block of each of its texts, by shard, the strings that a document smaller than the block's least has: kind 2. And
    where its texts stand, handed through: kind 3."""

    def send(mine: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return _frame([], SENT)
        b = Block(mine.iloc[0].to_dict(), settings)
        e = b.entries(dict(zip(got["bucket"], got["value"], strict=True)), buckets)
        order, cuts = e.dealt(shards)
        out = [(-1 - b.block % shards, b.block, b"", b"", b"", e.packed(order))]
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            some = order[cuts[s] : cuts[s + 1]]
            texts = [e.texts[i] for i in some.tolist()]
            out.append((s, b.block, e.key[some].tobytes(), _squeeze(e.least[some].tobytes()), bytes(len(x) for x in texts) if settings.width + MOST_WINDOWS <= 256 else np.fromiter(map(len, texts), np.uint32).tobytes(), _squeeze(b"".join(texts))))
        return _frame(out, SENT)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] < 0:
            return _frame([(block, 3, 0, x) for block, x in zip(rows["block"], rows["texts"], strict=True)], ANSWER)
        seen: dict[bytes, int] = {}
        of, keys, docs = [], [], []
        for row in rows.itertuples(index=False):
            length = np.frombuffer(row.lengths, np.uint8 if settings.width + MOST_WINDOWS <= 256 else np.uint32).astype(np.int64)
            ends, joined = np.cumsum(length), _stretch(row.texts)
            of.append(np.fromiter((seen.setdefault(joined[i:j], len(seen)) for i, j in zip((ends - length).tolist(), ends.tolist(), strict=True)), np.int64, len(ends)))
            keys.append(np.frombuffer(row.keys, np.uint64))
            docs.append(np.frombuffer(_stretch(row.docs), np.int64))
        at, doc = np.concatenate(of), np.concatenate(docs)
        least, key = np.full(len(seen), np.iinfo(np.int64).max), np.zeros(len(seen), np.uint64)
        np.minimum.at(least, at, doc)
        key[at] = np.concatenate(keys)
        marks = judged(list(seen), key, least, settings.width)
        answer = np.where(doc > least[at], np.uint64((1 << 64) - 1), marks[at])
        cuts = np.cumsum([0, *map(len, of)])
        return _frame([(block, 2, shard, _squeeze(answer[i:j].tobytes())) for block, shard, i, j in zip(rows["block"], rows["bucket"], cuts[:-1], cuts[1:], strict=True)], ANSWER)

    sent = blocks.groupBy("block").cogroup(found.where("kind = 1").groupBy("block")).applyInPandas(send, SENT)
    return written(sent.groupBy("bucket").applyInPandas(add, ANSWER), "judged", path, compression="zstd")


def repeated_spans(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, bytes>>, kept binary) for every row of ``docs``.

    spans: the maximal runs of bytes that go, in UTF-8, counted from 0; kept: the rest, joined. A null text is empty; one of
    fewer than ``width`` bytes has no string and stays whole. Of rows that share an id none is smaller than another. A row
    without an id stays whole, and takes nothing from others. ``key`` is an integer column. Whole texts are read, however long: a
    very long one is a block of its own. Empty table: no rows. Other columns are ignored. The result is made from tables in
    the shared folder whenever it is asked for.
    """
    spark = docs.sparkSession
    paths = [new_path(spark, x) for x in ("blocks", "anchors", "judged")]
    kind = docs.schema[key].dataType
    name = _blocks(docs, key, text, settings, paths[0])
    try:
        blocks = spark.table(name)
        size = int(blocks.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0)
        likely = 2 * size // (settings.width - settings.gram + 2) + 1
        buckets, width = max(parts(docs), likely // BUCKET_ENTRIES), min(8, (likely.bit_length() + 14) // 8)
        found = _found_twice(blocks, buckets, width, settings, paths[1])
        again = found.where("kind = 0").agg(F.sum(F.conv(F.hex("value"), 16, 10).cast("long"))).first()[0] or 0
        shards = max(parts(docs), int(again) * (settings.width + 13) // settings.shard_bytes)
        answers = _judge(blocks, found, buckets, shards, settings, paths[2])
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))), ("kept", pa.binary())])

        def run(mine: pa.Table, got: pa.Table) -> pa.Table:
            if not mine.num_rows:
                return schema.empty_table()
            b = Block(mine.to_pylist()[0], settings)
            rows = sorted(got.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
            marks = np.frombuffer(b"".join(_stretch(r["value"]) for r in rows if r["kind"] == 2), np.uint64)
            start, windows, text, later = Entries.unpacked(next(r["value"] for r in rows if r["kind"] == 3))
            mine_ = np.where(later, np.uint64((1 << 64) - 1), marks[text])
            nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            start = (np.repeat(start, windows) + nth)[(np.repeat(mine_, windows) >> nth.astype(np.uint64)) & np.uint64(1) == 1]
            n = len(b.text)
            change = np.bincount(start, minlength=n + 1) - np.bincount(start + settings.width, minlength=n + 1)
            gone = np.cumsum(change)[:n] > 0
            return _rest(b, gone, schema)

        made = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, bytes: long>>, kept binary")
        remove(spark, paths[1:2])
        return made.withColumn("doc_id", F.col("doc_id").cast(kind))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay: the result is made from them


def _rest(b: Block, gone: np.ndarray, schema: pa.Schema) -> pa.Table:
    """The rows of a block's documents, from the bytes that go."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[b.starts] = True
    before = np.concatenate([[False], gone[:-1]])[: len(gone)]
    first = np.flatnonzero(gone & (~before | edge[:-1]))
    after = np.append(gone[1:], False)[: len(gone)]
    last = np.flatnonzero(gone & (~after | edge[1:]))
    doc = np.searchsorted(b.ends, first, side="right")
    spans = pa.StructArray.from_arrays([pa.array(first - b.starts[doc]), pa.array(last - first + 1)], names=["start", "bytes"])
    offsets = np.searchsorted(first, np.append(b.starts, len(gone)))
    rest = b.text[~gone]
    through = np.concatenate([[0], np.cumsum(~gone)])[np.append(b.starts, len(gone))]
    raw = rest.tobytes()
    kept = [raw[i:j] for i, j in zip(through[:-1].tolist(), through[1:].tolist(), strict=True)]
    return pa.Table.from_arrays([pa.array(b.ids, mask=b.none), pa.array(b.lengths), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans), pa.array(kept, pa.binary())], schema=schema)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["bytes"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op11_suffix_dedup": op11_suffix_dedup}
ORACLE: dict[str, str] = {}
