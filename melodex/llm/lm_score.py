"""LM scoring by deleted interpolation.

A token's probability after its predecessor is a mixture of the maximum-likelihood bigram and unigram estimates and a
uniform one. The weights depend on how often the predecessor was seen (buckets of powers of two) and are learned by
expectation-maximisation on counts of training documents kept out of the estimates that they weigh; the final estimates
are those of all training documents.

Documents are worked through in blocks. A block holds its distinct words once and its tokens as places in that list. All
counts are exchanged in packed form: a block sends its distinct n-grams and their counts, dealt into buckets by hash;
a bucket adds up what all blocks sent and returns the totals in the same order. So a frequent n-gram is one entry of each
block, and no task sees more than its block or bucket. There are as many buckets as the entries ask for; a block sends only to
those that it has entries for, so the messages are never more than the entries. N-grams are told apart by 64-bit hashes of
words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, new_path, parts, record, remove, table, written

#: A block ends beyond so many tokens; a bucket is meant for so many entries.
BLOCK_TOKENS, BUCKET_ENTRIES = 2_500_000, 1_500_000
MOST_FILES = 50_000  # of the table of blocks; a task takes a file's blocks one by one
END, START = 0x5BD1E995_27D4EB2F, 0x165667B1_9E3779F9  # stand for the hashes of the end and of what precedes the first word
CONTEXTS = 40  # buckets of the predecessor's frequency
ROUNDS = 20


@dataclass(frozen=True)
class Settings:
    """One in ``kept_out`` training documents is kept out for the mixture weights."""

    kept_out: int = 10


# Packed integers: byte planes, so that the shuffle's compression takes out what is alike.


def pack(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(b: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64)[:, 0].copy()


def count_width(x: np.ndarray) -> int:
    return max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)


def pack_counts(x: np.ndarray) -> bytes:
    w = count_width(x)
    return bytes([w]) + pack(x, w)


def unpack_counts(b: bytes) -> np.ndarray:
    return unpack(b[1:], b[0]).astype(np.int64)


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(docs: DataFrame, key: Column, text: str, held: Column, dev: Column, path: str) -> str:
    """A table of (block, ids, held, dev, lengths, tokens, words) rows, in buckets by block: later passes meet them in place.
    Ids are carried as text, so that null ones among them change no other.

    tokens: places in words; a document ends with the place of the end, 0.
    """
    spark = docs.sparkSession
    rows = docs.select(key.cast("string").alias("id"), held.alias("held"), dev.alias("dev"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start() -> None:
            nonlocal places, ids, flags, lengths, tokens, n
            places, ids, flags, lengths, tokens, n = _Places({b"": 0}), [], [], [], [], 0  # no word is empty

        def block() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in places), np.uint64, len(places))
            words[0] = END
            f = np.array(flags, np.uint8)
            return record(
                block=[uuid.uuid4().int >> 65], ids=pa.array([ids], pa.list_(pa.string())), held=[f[:, 0].tobytes()], dev=[f[:, 1].tobytes()],
                lengths=[np.array(lengths, np.uint32).tobytes()], tokens=[np.concatenate(tokens).tobytes()], words=[words.tobytes()],
            )

        places = ids = flags = lengths = tokens = n = None
        start()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for id_, h, d, x in zip(*(some.column(c).to_pylist() for c in ("id", "held", "dev", "text")), strict=True):
                    w = x.encode("utf-8", "replace").lower().split() if x else []
                    w.append(b"")
                    ids.append(id_)
                    flags.append((h, d))
                    lengths.append(len(w))
                    tokens.append(np.fromiter(map(places.__getitem__, w), np.uint32, len(w)))
                    n += len(w)
                    if n >= BLOCK_TOKENS:
                        yield block()
                        start()
        if ids:
            yield block()

    made = rows.mapInArrow(run, "block long, ids array<string>, held binary, dev binary, lengths binary, tokens binary, words binary")
    name, n = f"lm_blocks_{uuid.uuid4().hex}", min(MOST_FILES, max(8, 2 * rows.rdd.getNumPartitions()))
    made.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "block").saveAsTable(name)
    return name


class Block:
    """One row of ``_blocks``, unpacked."""

    def __init__(self, row: pd.Series):
        self.block, self.ids = int(row["block"]), row["ids"]
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = np.frombuffer(row["tokens"], np.uint32).astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.held, self.dev = np.frombuffer(row["held"], np.uint8).astype(bool), np.frombuffer(row["dev"], np.uint8).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def per_token(self, flags: np.ndarray) -> np.ndarray:
        return np.repeat(flags, self.lengths)

    def before(self) -> np.ndarray:
        """Each token's predecessor: a place in words, -1 for the start."""
        out = np.roll(self.tokens, 1)
        out[self.starts] = -1
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct bigrams' hashes, ascending, and each token's place among them."""
        v = np.append(self.words, np.uint64(START))[self.before()]
        h = (v * np.uint64(0x9E3779B97F4A7C15)) ^ self.words[self.tokens]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return np.unique(h, return_inverse=True)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the ascending keys begins, and the end."""
    edges = np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // max(2, buckets))
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _send(keys: np.ndarray, counts: list[np.ndarray], block: int, kind: int, buckets: int, width: int) -> Iterator[tuple]:
    cuts = _cuts(keys, buckets)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        i, j = cuts[b], cuts[b + 1]
        yield b, block, kind, pack(keys[i:j], width), [pack_counts(c[i:j]) for c in counts]


SENT = "bucket int, block long, kind int, keys binary, counts array<binary>"
RETURNED = "block long, bucket int, kind int, values array<binary>"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def _sums(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The distinct keys of all, the sums of their counts, and each sent key's place among them."""
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, [np.bincount(at, weights=np.concatenate(c), minlength=len(every)).astype(np.int64) for c in counts], at


def unigrams(blocks: DataFrame, buckets: int, path: str) -> DataFrame:
    """To each block its words' counts: kind 0, [all training, training but kept out]; kind 9: [tokens, types, kept-in tokens]."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                b = Block(row)
                train, kept = b.per_token(~b.held), b.per_token(~b.held & ~b.dev)
                n = len(b.words)
                order = np.argsort(b.words)
                counts = [np.bincount(b.tokens[m], minlength=n)[order] for m in (train, kept)]
                yield _frame(list(_send(b.words[order], counts, b.block, 0, buckets, 8)), SENT)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(k, 8) for k in rows["keys"]]
        _, (train, kept), at = _sums(keys, [[unpack_counts(c[i]) for c in rows["counts"]] for i in (0, 1)])
        cuts = np.cumsum([0, *map(len, keys)])
        out = [(block, bucket, 0, [pack_counts(train[at[i:j]]), pack_counts(kept[at[i:j]])]) for block, bucket, i, j in zip(rows["block"], rows["bucket"], cuts[:-1], cuts[1:], strict=True)]
        out.append((0, rows["bucket"].iloc[0], 9, [int(x).to_bytes(8, "little") for x in (train.sum(), (train > 0).sum(), kept.sum())]))
        return _frame(out, RETURNED)

    sent = blocks.select("block", "held", "dev", "lengths", "tokens", "words", F.lit(None).alias("ids")).mapInPandas(send, SENT)
    return written(sent.groupBy("bucket").applyInPandas(add, RETURNED), "unigrams", path, compression="zstd")


def _word_counts(b: Block, rows: pd.DataFrame) -> list[np.ndarray]:
    """A block's words' counts, in the order of its words."""
    rows = rows[rows["kind"] == 0].sort_values("bucket")
    order = np.argsort(b.words)
    out = []
    for i in (0, 1):
        c = np.empty(len(b.words), np.int64)
        c[order] = np.concatenate([unpack_counts(v[i]) for v in rows["values"]])
        out.append(c)
    return out


def bigrams(blocks: DataFrame, words: DataFrame, buckets: int, path: str) -> DataFrame:
    """To each block its bigrams' training counts: kind 1, [count]. And what the kept-out documents hold: kind 2, entries of
    [times, bigram, predecessor, token counts without the kept-out documents]."""

    def send(mine: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return _frame([], SENT)
        b = Block(mine.iloc[0])
        keys, at = b.pairs()
        train, kept, dev = b.per_token(~b.held), b.per_token(~b.held & ~b.dev), b.per_token(~b.held & b.dev)
        counts = [np.bincount(at[m], minlength=len(keys)) for m in (train, kept)]
        out = list(_send(keys, counts, b.block, 1, buckets, 8))
        times = np.bincount(at[dev], minlength=len(keys))
        asked = np.flatnonzero(times)
        if len(asked):
            _, c = _word_counts(b, got)
            one = np.zeros(len(keys), np.int64)
            one[at[dev]] = np.flatnonzero(dev)  # a token of each
            token = one[asked]
            v = b.before()[token]
            c_v = np.append(c, 0)[v]
            c_v[v < 0] = -1  # the start: as often as documents
            out += _send(keys[asked], [times[asked], c_v + 1, c[b.tokens[token]]], b.block, 2, buckets, 8)
        return _frame(out, SENT)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        sent, asked = rows[rows["kind"] == 1], rows[rows["kind"] == 2]
        keys = [unpack(k, 8) for k in sent["keys"]]
        every, (train, kept), at = _sums(keys, [[unpack_counts(c[i]) for c in sent["counts"]] for i in (0, 1)])
        cuts = np.cumsum([0, *map(len, keys)])
        bucket = rows["bucket"].iloc[0]
        out = [(block, bucket, 1, [pack_counts(train[at[i:j]])]) for block, i, j in zip(sent["block"], cuts[:-1], cuts[1:], strict=True)]
        if len(asked):
            k = np.concatenate([unpack(x, 8) for x in asked["keys"]])
            times, c_v, c_w = (np.concatenate([unpack_counts(c[i]) for c in asked["counts"]]) for i in (0, 1, 2))
            c_vw = kept[np.searchsorted(every, k)]
            like, n = np.unique(np.stack([c_vw, c_v, c_w]), axis=1, return_inverse=True)
            out.append((0, bucket, 2, [pack_counts(np.bincount(n.ravel(), weights=times).astype(np.int64)), *(pack_counts(x) for x in like)]))
        return _frame(out, RETURNED)

    sent = blocks.groupBy("block").cogroup(words.where("kind = 0").groupBy("block")).applyInPandas(send, SENT)
    return written(sent.groupBy("bucket").applyInPandas(add, RETURNED), "bigrams", path, compression="zstd")


def context(count: np.ndarray) -> np.ndarray:
    """The bucket of a predecessor's frequency: 0 for none, else 1 + the whole part of its logarithm to base 2."""
    return np.minimum(CONTEXTS - 1, np.frexp(count.astype(np.float64))[1] * (count > 0))


def mixture(entries: DataFrame, tokens: int, types: int, documents: int) -> np.ndarray:
    """Weights of (uniform, unigram, bigram) for each bucket of contexts, by expectation-maximisation. Buckets that the
    kept-out documents don't reach keep the first guess; without a predecessor's count the bigram has no weight."""
    weights = np.tile([0.1, 0.5, 0.4], (CONTEXTS, 1))
    weights[0] = [0.2, 0.8, 0.0]
    before = -np.inf
    for _ in range(ROUNDS):
        now = weights.copy()

        def step(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            total, gain = np.zeros((CONTEXTS, 3)), 0.0
            for batch in batches:
                for v in batch["values"]:
                    times, c_vw, c_v, c_w = map(unpack_counts, v)
                    c_v = np.where(c_v == 0, documents, c_v - 1)  # as sent: one more, 0 for the start
                    at = context(c_v)
                    p = now[at] * np.stack([np.full(len(times), 1 / (types + 1)), c_w / max(1, tokens), c_vw / np.maximum(1, c_v)], axis=1)
                    whole = p.sum(axis=1)
                    gain += (times * np.log(whole)).sum()
                    p *= (times / whole)[:, None]
                    for j in range(3):
                        total[:, j] += np.bincount(at, weights=p[:, j], minlength=CONTEXTS)
            rows = [(i, j, total[i, j]) for i in range(CONTEXTS) for j in range(3) if total[i, j] > 0]
            yield pd.DataFrame([*rows, (-1, 0, gain)], columns=["i", "j", "n"])

        got = {(r["i"], r["j"]): r["n"] for r in entries.select("values").mapInPandas(step, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()}
        gain = got.pop((-1, 0), 0.0)
        total = np.array([[got.get((i, j), 0.0) for j in range(3)] for i in range(CONTEXTS)])
        seen = total.sum(axis=1) > 0
        weights[seen] = np.maximum(total[seen] / total[seen].sum(axis=1, keepdims=True), 1e-9)
        if not seen.any() or gain - before < 1e-5 * abs(gain):
            break
        before = gain
    weights[0, 2] = 0.0
    return weights / weights.sum(axis=1, keepdims=True)


def score(docs: DataFrame, held: Column, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Learns from documents that are not ``held``. Tokens: words between white space, A-Z in lower case, then one end. A null
    text is empty; a null id stays; repeated rows are documents of their own. Without training documents every token is
    unknown and the scores are 0 (one type, the unknown one). Empty table: no rows. Other columns are ignored. The result
    is written and what led to it removed.
    """
    spark = docs.sparkSession
    dev = F.pmod(F.xxhash64(F.lit("kept out"), F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(settings.kept_out)) == 0
    paths = [new_path(spark, x) for x in ("blocks", "unigrams", "bigrams")]
    name = _blocks(docs, F.col(key), text, held, dev, paths[0])
    blocks = spark.table(name)
    kind = docs.schema[key].dataType
    n = blocks.agg(F.sum(F.length("words") / 8), F.sum(F.length("tokens") / 4), F.count("*")).first()
    documents = np.array([int(x or 0) for x in docs.select((~held).alias("t"), (~held & ~dev).alias("k")).agg(F.sum(F.col("t").cast("long")), F.sum(F.col("k").cast("long"))).first()])
    of = lambda entries: max(parts(docs), int((entries or 0) // BUCKET_ENTRIES))
    words = unigrams(blocks, of(n[0]), paths[1])
    total, types, kept = (int(x or 0) for x in _stats(words))
    pairs = bigrams(blocks, words, of(n[1]), paths[2])
    weights = mixture(pairs.where("kind = 2"), kept, types, int(documents[1]))

    def run(mine: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(mine):
            return pd.DataFrame(columns=columns)
        b = Block(mine.iloc[0])
        c = _word_counts(b, got)[0]
        _, at = b.pairs()
        c_vw = np.concatenate([unpack_counts(v[0]) for v in got[got["kind"] == 1].sort_values("bucket")["values"]])[at]
        before, c_w = b.before(), c[b.tokens]
        c_v = np.append(c, 0)[before]
        c_v[before < 0] = documents[0]
        w = weights[context(c_v)]
        p = w[:, 0] / (types + 1) + w[:, 1] * c_w / max(1, total) + w[:, 2] * c_vw / np.maximum(1, c_v)
        p = p if total else np.ones(len(c_w))
        sums = lambda x: np.add.reduceat(x, b.starts)
        return pd.DataFrame({"doc_id": b.ids, "held_out": b.held, "n_tokens": b.lengths, "n_known": sums((c_w > 0).astype(np.int64)), "train_tokens": total, "base_score": sums(np.log10((c_w + 1) / (total + types + 1))), "score": sums(np.log10(p))})[columns]

    answers = words.where("kind = 0").unionByName(pairs.where("kind = 1"))
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = written(scored.withColumn("doc_id", F.col("doc_id").cast(kind)), "scores")
    spark.sql(f"DROP TABLE {name}")
    remove(spark, paths)
    return out


def _stats(words: DataFrame) -> tuple:
    """Sums over the buckets of what kind 9 tells."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([[int.from_bytes(x, "little") for x in v] for v in batch["values"]], columns=["a", "b", "c"])

    return tuple(words.where("kind = 9").select("values").mapInPandas(read, "a long, b long, c long").agg(F.sum("a"), F.sum("b"), F.sum("c")).first())


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


QUERIES = {"op1_lm_score": op1_lm_score}
ORACLE: dict[str, str] = {}
