"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits. The bits are dealt into partitions that group
correlated bits, and each partition gets its own threshold: with thresholds whose sum of (threshold + 1) is radius + 1,
two linked fingerprints are within the threshold in one partition at least. A dynamic programme picks the thresholds of
the least estimated cost, which also picks the number of partitions. All links are found; every candidate is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, copy_of, fresh, map_texts, record, table, texts, written

#: Distinct fingerprints in the sample that correlations and candidate counts are estimated on.
SAMPLE = 2000
#: An emitted key costs as much as so many candidates.
KEY_COST = 0.5
MOST_THRESHOLD = 2
#: A set of up to so many ids is broadcast; beyond, documents meet it in a shuffle.
BROADCAST_IDS = 300_000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the shingles, repeats included; 0 for a text without words."""
    w = text.encode().lower().split() if isinstance(text, str) else []  # of bytes: A-Z, and \x20 and \x09-\x0D
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) < words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        of = xxhash.xxh64_intdigest
        hashes = [of(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)]
    total, at = np.zeros(64, np.int64), np.array(hashes, dtype=">u8")
    for i in range(0, len(at), 65_536):
        total += np.unpackbits(at[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, copy, fp): fp the fingerprint as a signed long; copy tells the texts of one id apart."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = np.fromiter((fingerprint(x, words) for x in texts(batch)), np.uint64, batch.num_rows)
        yield record(doc_id=batch.column("doc_id"), copy=batch.column("copy"), fp=made.view(np.int64))

    rows = docs.select(F.col(key).alias("doc_id"), copy_of(F.col(text)).alias("copy"), F.col(text).alias("text"))
    return map_texts(rows, run, f"doc_id {kind}, copy long, fp long")


def _grouped(bits: np.ndarray, n: int) -> list[list[int]]:
    """The 64 columns dealt into n partitions of like size, each grown from a seed by its most correlated free columns."""
    x = bits - bits.mean(axis=0)
    sd = np.sqrt((x * x).mean(axis=0)) + 1e-9
    near = np.abs((x.T @ x) / len(x) / np.outer(sd, sd))
    free, out = set(range(64)), []
    for i in range(n):
        size = len(free) // (n - i)
        left = sorted(free)
        part = [max(left, key=lambda b: near[b, left].sum())]
        while len(part) < size:
            rest = sorted(free - set(part))
            part.append(rest[int(np.argmax(near[np.ix_(rest, part)].sum(axis=1)))])
        out.append(sorted(part))
        free -= set(part)
    return out


def _costs(bits: np.ndarray, part: list[int], count: int) -> list[float]:
    """For thresholds -1, 0, 1, ...: the estimated candidates and emitted keys of a partition.

    The chance that two fingerprints are within t is the larger of its share among the sample's pairs and of that for
    independent bits.
    """
    cols = bits[:, part]
    ones = cols.sum(axis=1)
    apart = ones[:, None] + ones[None, :] - 2 * cols @ cols.T
    seen = np.bincount(apart[np.triu_indices(len(cols), 1)].astype(int), minlength=len(part) + 1)[: len(part) + 1] if len(cols) > 1 else np.zeros(len(part) + 1)
    seen = seen.cumsum() / max(1, seen.sum())
    odd = 2 * cols.mean(axis=0) * (1 - cols.mean(axis=0))
    alone = reduce(lambda d, q: np.append(d, 0) * (1 - q) + np.append(0, d) * q, odd, np.ones(1)).cumsum()
    out = [0.0]
    for t in range(MOST_THRESHOLD + 1):
        keys = sum(comb(len(part), i) / 2**i for i in range(t + 1)) + sum(comb(len(part), i) / 2**i for i in range(t // 2 + 1))
        out.append(max(seen[t], alone[t]) * count * count / 2 + KEY_COST * keys * count)
    return out


def plan(sample: np.ndarray, count: int, radius: int = 3) -> list[tuple[list[int], int]]:
    """Partitions (bits counted from the highest) and their thresholds of 0 or more, of the least estimated cost for ``count``."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float) if len(sample) else np.zeros((1, 64))
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for n in range(2, radius + 2):
        groups = _grouped(bits, n)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # units of threshold + 1 spent: cost, thresholds
        for part in groups:
            costs = _costs(bits, part, count)
            after: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in states.items():
                for units, more in enumerate(costs):
                    if spent + units <= radius + 1 and cost + more < after.get(spent + units, (np.inf,))[0]:
                        after[spent + units] = (cost + more, [*chosen, units - 1])
            states = after
        if radius + 1 in states and states[radius + 1][0] < best[0]:
            best = states[radius + 1][0], [(g, t) for g, t in zip(groups, states[radius + 1][1], strict=True) if t >= 0]
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(rows: DataFrame, chosen: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    """(fp, part, key, flips, most): the bits of a partition, with up to a number of its zeros made ones.

    Two values at a distance of d meet where each has the other's ones, after d flips in all.
    """
    entries = []
    for i, (part, t) in enumerate(chosen):
        masks = [1 << (63 - b) for b in part]
        for n in range((t if probe else t // 2) + 1):
            entries += [(i, sum(masks), sum(c), n, t) for c in combinations(masks, n)]
    listed = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(_signed(m)).alias("mask"), F.lit(_signed(c)).alias("add"), F.lit(n).alias("flips"), F.lit(t).alias("most")) for i, m, c, n, t in entries])
    return rows.select("fp", F.explode(listed).alias("e")).where("(fp & e.add) = 0").select("fp", "e.part", F.expr("(fp & e.mask) | e.add").alias("key"), "e.flips", "e.most")


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``fp`` that differ in 1 to ``radius`` bits."""
    count = distinct.count()
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, count)) * (1 << 30))).select("fp").limit(2 * SAMPLE).collect()
    chosen = plan(np.array([r[0] for r in sample], np.int64).view(np.uint64), count, radius)
    probe = _keys(distinct, chosen, True).alias("x")
    base = _keys(distinct, chosen, False).alias("y")
    met = F.expr("x.part = y.part and x.key = y.key and x.fp != y.fp and x.flips + y.flips <= x.most and bit_count(x.fp ^ y.fp) <= " + str(radius))
    return probe.join(base, met).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, copy, fp, component_id, first) for every document: component_id the least id of all that links reach, first
    whether the document is the first of its component, by id and then by copy.

    Documents with equal fingerprints are one class, so copies are never paired. A null text has no words and so the
    fingerprint zero, like an empty one. A null id takes part but is never a component's least id (null if no other
    is there). Rows that share an id are judged each by its own text; rows that share both are first together. Empty table:
    no rows. Other columns are ignored; whole texts are read.
    """
    made = written(fingerprints(docs, key, text, words), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("copy").isNull().alias("no_text"), F.col("copy").alias("copy"))
    classes = written(made.groupBy("fp").agg(F.min(order).alias("rep")), "classes")
    joined = components(links(classes, radius))
    parts = classes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = parts.groupBy("component").agg(F.min("rep").alias("least"))
    named = parts.join(least, "component").select("fp", "least")
    return made.join(named, "fp").select("doc_id", "copy", "fp", F.col("least.doc_id").alias("component_id"), F.col("least").eqNullSafe(order).alias("first"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names: of each group the first document (as in ``group``). Of rows
    that share an id and a text one stays; of rows that share only an id each stays or goes by its own text."""
    found = written(group(docs, key, text, words, radius), "groups")
    id_, copy = fresh(docs, "gone_id", "gone_copy")
    gone = written(found.where("not first").select(F.col("doc_id").alias(id_), F.col("copy").alias(copy)).distinct(), "gone")
    repeated = not found.groupBy("doc_id", "copy").count().where("count > 1").isEmpty()
    met = F.col(key).eqNullSafe(F.col(id_)) & copy_of(F.col(text)).eqNullSafe(F.col(copy))
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, met, "left_anti")
    return out.dropDuplicates([key, text]) if repeated else out


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLE: dict[str, str] = {}
