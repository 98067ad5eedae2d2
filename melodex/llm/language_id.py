"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights come from follow-the-regularised-leader with elastic-net penalties, run on several shards of a bounded sample
of the labelled rows and averaged; document frequencies cover all labelled rows; a temperature fitted on rows kept out
of the training shards calibrates the scores. The sample is bounded for each label, so none is lost as the table grows, and
the languages get their true shares back as priors. Every text is predicted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, fold, map_texts, record, table, texts, written

#: Texts are worked through in pieces of about so many characters at once.
CHUNK = 1_000_000


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that the classifier is fitted on, an equal part for each label, but a label
    may always give ``label_rows``; labels with fewer rows give all. ``bits``: the feature space."""

    bits: int = 16
    sample_rows: int = 6000
    label_rows: int = 200
    shards: int = 6
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """All code points: letters to themselves in lower case, others to a space. Made once in each process, 4 MB."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if chr(i).isalpha():
            low = chr(i).lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


class Features:
    """Hashed character 1- to 3-grams of texts; made once in each task."""

    def __init__(self, bits: int):
        self.map, self.shift = _letters(), np.uint32(32 - bits)

    def of(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per order the feature of each position (2**bits where there is none), the starts of the texts, and which have a letter."""
        joined = "".join([f" {x} " for x in texts])  # no n-gram reaches from one text into another: one around two spaces is none
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        c = self.map[points]
        blank = c == 32
        has = np.add.reduceat(~blank, starts) > 0
        none = np.uint32(1 << (32 - int(self.shift)))
        one = (c * np.uint32(2654435761)) >> self.shift
        two = (c[:-1] * np.uint32(40503) + c[1:]) * np.uint32(2246822519)
        three = ((c[:-2] * np.uint32(40503) + c[1:-1]) * np.uint32(40503) + c[2:]) * np.uint32(3266489917)
        two, three = two >> self.shift, three >> self.shift
        one[blank] = none
        two[blank[:-1] & blank[1:]] = none
        three[blank[1:-1]] = none
        return [one, np.append(two, none), np.append(three, np.repeat(none, 2))], starts, has


def _chunks(texts: list[str]) -> Iterator[slice]:
    at = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= CHUNK:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _vector(orders: list[np.ndarray], a: int, b: int, none: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f = np.concatenate([x[a:b] for x in orders])
    ids, n = np.unique(f[f != none], return_counts=True)
    return ids, n * idf[ids] / np.sqrt(max(1, n.sum()))


def document_frequency(rows: DataFrame, text: str, bits: int) -> np.ndarray:
    """How many of ``rows`` hold each feature; 2**bits sums come to the driver, whatever the input."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, df, mark = Features(bits), np.zeros(size, np.int64), np.zeros(size + 1, bool)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                some = texts(batch.slice(i, SLICE), text)
                for part in _chunks(some):
                    orders, starts, _ = made.of(some[part])
                    for a, b in zip(starts, [*starts[1:], len(orders[0])], strict=True):
                        for x in orders:
                            mark[x[a:b]] = True
                        mark[size] = False
                        ids = np.flatnonzero(mark)
                        df[ids] += 1
                        mark[ids] = False
        ids = np.flatnonzero(df)
        yield record(feature=ids, n=df[ids])

    out = np.zeros(size)
    for r in rows.select(text).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r[0]] = r[1]
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (2**bits + 1) x languages, times the inverse document frequency; the last row is zero
    temperature: float
    bits: int
    prior: np.ndarray  # log of each language's share of the labelled rows over its share of the sample
    least: np.ndarray  # of each language the share of known n-grams below which a text is in none; -1 where that is not known

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        return _softmax(z.astype(np.float64) / self.temperature + self.prior)

    def logits(self, texts: list[str], made: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the languages' logits, whether it has a letter, and the share of its n-grams that have a weight, ``DOUBT``
        more counted as such."""
        orders, starts, has = made.of(texts)
        weighed = self.weights.any(axis=1)
        total, n, known = 0, 0, DOUBT
        for x in orders:
            total = total + np.add.reduceat(self.weights[x], starts, axis=0)
            n = n + np.add.reduceat(x != (1 << self.bits), starts)
            known = known + np.add.reduceat(weighed[x].astype(np.int64), starts)
        return total / np.sqrt(np.maximum(1, n))[:, None], has, known / (n + DOUBT)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on labelled ``rows``; None if none of them has both a text and a label."""
    spark, s = rows.sparkSession, settings
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    u = F.pmod(F.xxhash64(F.lit("sample"), "key", "text"), F.lit(1 << 60))
    labels = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(u).alias("least")).collect()}  # a row for each language
    if not labels:
        return None
    n, langs = sum(r["n"] for r in labels.values()), sorted(labels)
    df = document_frequency(rows, "text", s.bits)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    bound = max(s.label_rows, -(-s.sample_rows // len(langs)))
    cuts = [(x, r["least"], int(min(1.0, bound / r["n"]) * (1 << 60))) for x, r in labels.items()]
    cuts = spark.createDataFrame(cuts, f"lang {rows.schema['lang'].dataType.simpleString()}, least long, cut long")
    # Equal rows fall into the sample together, so they count once; the first row of each label always trains.
    shard = F.when(u == F.col("least"), 0).otherwise(F.pmod(F.xxhash64(F.lit("shard"), "key", "text"), F.lit(s.shards + 1)).cast("int"))
    sample = rows.join(F.broadcast(cuts), "lang").where((u < F.col("cut")) | (u == F.col("least"))).select("key", "text", "lang", shard.alias("shard"))
    sample = written(sample.dropDuplicates(["key", "text", "lang"]), "sample")
    taken = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}
    prior = np.log([labels[x]["n"] / n * sum(taken.values()) / taken[x] for x in langs])
    shared_idf, size, k = spark.sparkContext.broadcast(idf), 1 << s.bits, len(langs)
    at = {x: i for i, x in enumerate(langs)}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        """FTRL-proximal, one pass in the order of a hash; squares of gradients set the rate of each weight."""
        idf, made = shared_idf.value, Features(s.bits)
        z, q = np.zeros((size, k)), np.zeros((size, k))
        rows = rows.sort_values(["key", "text"], ignore_index=True).sample(frac=1, random_state=7)
        for x, y in zip(rows["text"], rows["lang"], strict=True):
            orders, _, _ = made.of([x])
            ids, v = _vector(orders, 0, len(orders[0]), size, idf)
            if not len(ids):
                continue
            zi, qi = z[ids], q[ids]
            w = np.where(np.abs(zi) <= s.l1, 0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(qi)) / s.alpha + s.l2))
            p = _softmax((v @ w)[None])[0]
            p[at[y]] -= 1
            g = v[:, None] * p[None]
            z[ids] = zi + g - (np.sqrt(qi + g * g) - np.sqrt(qi)) / s.alpha * w
            q[ids] = qi + g * g
        w = np.where(np.abs(z) <= s.l1, 0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(q)) / s.alpha + s.l2))
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()]})

    made = [np.frombuffer(r[0], np.float32).reshape(size, k) for r in sample.where(F.col("shard") < s.shards).groupBy("shard").applyInPandas(fit, "w binary").collect()]
    mean = np.mean(made, axis=0) if made else np.zeros((size, k), np.float32)
    model = Model(langs, np.vstack([mean * idf[:, None], np.zeros((1, k))]).astype(np.float32), 1.0, s.bits, prior, np.full(k, -1.0))
    model.temperature, model.least = _calibrate(model, sample.where(F.col("shard") == s.shards), np.array([labels[x]["n"] / n for x in langs]))
    return model


#: A text's share of known n-grams is taken as if it had so many more, all known: short texts are hard to tell.
DOUBT = 64
#: Languages with fewer kept-out rows reject nothing; with more, never what is less than so far below their mean.
LEAST_ROWS, MARGIN = 8, 0.1


def _calibrate(model: Model, rows: DataFrame, share: np.ndarray) -> tuple[float, np.ndarray]:
    """From the kept-out share of the bounded sample: the temperature, and of each language the bound on known n-grams.

    The temperature is that of least log loss, each row weighed by its language's prior. Rows that are all predicted right would
    ask for ever more certainty; so much as in Platt's scaling, of n rows the label is taken as true by (n + 1) / (n + 2), and the
    rest is spread over all languages by their share. The bound lies as far below the least share of a language's own rows as
    that lies below their mean, and ``MARGIN`` below the mean at least; a language of few kept-out rows has none.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def logits(batch: pa.RecordBatch, made: Features) -> Iterator[pa.RecordBatch]:
        model, some = shared.value, texts(batch)
        at = {x: i for i, x in enumerate(model.langs)}
        y = [at[x] for x in batch.column("lang").to_pylist()]
        for part in _chunks(some):
            z, has, known = model.logits(some[part], made)
            yield record(z=[x.astype(np.float64).tobytes() for x in z], y=pa.array(y[part], pa.int32()), known=pa.array(np.where(has, known, np.nan)))

    got = map_texts(rows.select("text", "lang"), logits, "z binary, y int, known double", lambda: Features(shared.value.bits)).collect()
    least, k = np.full(len(model.langs), -1.0), len(model.langs)
    if not got:
        return 1.0, least
    z, y, known = np.array([np.frombuffer(r[0]) for r in got]), np.array([r[1] for r in got]), np.array([r[2] for r in got])
    for i in range(k):
        own = known[(y == i) & ~np.isnan(known)]
        if len(own) >= LEAST_ROWS:
            least[i] = own.mean() - max(MARGIN, 2 * (own.mean() - own.min()))
    if k == 1:
        return 1.0, least
    return temperature(z, y, model.prior, share), least


def temperature(z: np.ndarray, y: np.ndarray, prior: np.ndarray, share: np.ndarray) -> float:
    """Of least smoothed loss for the logits z of rows of the languages y: the least on a grid, and on ever finer ones around it."""
    n, k = z.shape
    truth = np.tile(share / (n + 2), (n, 1))
    truth[np.arange(n), y] += (n + 1) / (n + 2)
    weights = np.exp(prior[y])

    def loss(log_t: float) -> float:
        x = z * np.exp(-log_t) + prior
        x = x - x.max(axis=1, keepdims=True)
        return -float(np.average((truth * (x - np.log(np.exp(x).sum(axis=1, keepdims=True)))).sum(axis=1), weights=weights))

    at, width = 0.0, 12.0
    while width > 1e-3:
        at = min(np.linspace(at - width, at + width, 33), key=loss)
        width /= 8
    return float(np.exp(at))


def _judged(model: Model | None, made: Features, some: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language, the score and the share of known n-grams of each text."""
    some = [x or "" for x in some]
    if model is None:
        return ["und"] * len(some), np.zeros(len(some)), np.zeros(len(some))
    names, scores, known = [], [], []
    for part in _chunks(some):
        z, has, share = model.logits(some[part], made)
        p = model.probabilities(z)
        best = p.argmax(axis=1)
        names += [model.langs[i] if ok else "und" for i, ok in zip(best, has, strict=True)]
        scores.append(np.where(has, p[np.arange(len(best)), best], 0.0))
        known.append(np.where(has, share, 0.0))
    return names, np.concatenate(scores), np.concatenate(known)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, lang_pred, score, known) for every row; known: the share of the text's n-grams, and of ``DOUBT`` more that
    count as such, that have a weight in the sparse model. A null text, one without a letter, or no model: ``und``, 0.0 and 0.0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(key, *keep, text)
    schema = ", ".join(f"`{n}` {t}" for n, t in picked.dtypes[:-1]) + ", lang_pred string, score double, known double"

    def run(batch: pa.RecordBatch, made: Features) -> Iterator[pa.RecordBatch]:
        n = batch.num_columns - 1
        names, *numbers = _judged(shared.value, made, batch.column(n).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(names, pa.string()), *map(pa.array, numbers)], names=[*batch.schema.names[:n], "lang_pred", "score", "known"])

    return map_texts(picked, run, schema, lambda: Features(shared.value.bits if shared.value else 16))


def accepted(docs: DataFrame, model: Model | None, least_known: float | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that are in a learned language: predicted as one, and with a share of known n-grams that
    is not below that language's bound, which its kept-out rows gave (``least_known``: one bound for all instead). The score
    alone can't tell, as it says which of the learned languages a text is nearest to. Texts in a language of which too few
    rows were kept out all stay, as do short texts with a letter: there is no telling. Null texts and texts without a letter
    go, however long; without a model all go. A null ``lang`` of these rows becomes the prediction; rows that repeat stay or
    go together; columns of any name pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(lang)

    def run(batch: pa.RecordBatch, made: Features) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names, _, known = _judged(model, made, texts(batch, text))
        bounds = dict(zip(model.langs, model.least.tolist(), strict=True)) if model and least_known is None else {}
        filled = pc.coalesce(batch.column(at), pa.array(names, batch.column(at).type))
        columns = [filled if i == at else x for i, x in enumerate(batch.columns)]
        batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        yield batch.filter(pa.array([x != "und" and k >= bounds.get(x, least_known or -1.0) for x, k in zip(names, known.tolist(), strict=True)], pa.bool_()))

    return map_texts(docs, run, docs.schema, lambda: Features(shared.value.bits if shared.value else 16))


def identify(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, known) for every document.

    Learns from rows with a text and a label whose crc32(id as text) mod 4 is not 2; the label of no other row is read.
    Nulls: a null label is not learned from, a null text is ``und``; a null id counts as the empty text. Empty table: no
    rows. Repeated ids: each row is judged by itself. Ties between languages: the first in alphabetical order. Other
    columns are ignored.
    """
    model = train(docs.where(fold(F.col(key), 4) != 2), settings, key, text, lang)
    held = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), (fold(F.col(key), 4) == 2).alias("held_out"))
    return predict(held, model, "doc_id", "text", ("held_out",))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLE: dict[str, str] = {}
