"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to 8 dimensions, scaled and decoded to the nearest point of the E8 lattice; each of
several tables has its own projection and shift. A vector is filed under its own cell and looks into the cells of the
nearest lattice points around it as well. Vectors that meet are compared by 64 signs of further projections, which drop
most that are far apart, then verified by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, table, written


@dataclass(frozen=True)
class Settings:
    """``scale``: lattice units per unit of distance; ``probes``: neighbouring cells looked into; ``signs``: most signs
    in which a pair may differ. Pairs at a cosine of just 0.9 are met with a chance of about 0.93, of 0.95 or more with
    one of over 0.99 (simulated, 64 dimensions)."""

    threshold: float = 0.9
    tables: int = 14
    scale: float = 1.2
    probes: int = 12
    signs: int = 20
    seed: int = 8


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) / 2 for v in product((1, -1), repeat=8) if np.prod(v) > 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates of an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of its two cosets of even integer points, the closer."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _key(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of lattice points."""
    h = np.full(points.shape[:-1], salt, np.uint64)
    for i in range(8):
        h = (h ^ np.rint(2 * points[..., i]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def cells(vectors: np.ndarray, s: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """For each table the keys of each unit vector's cells, its own first, then the neighbouring ones by distance."""
    steps, dim = roots(), vectors.shape[1]
    for t in range(s.tables):
        rng = np.random.default_rng([s.seed, t, dim])
        x = vectors @ (rng.standard_normal((dim, 8)) * s.scale) + rng.random(8)
        own = decode(x)
        nearest = np.argpartition(-(x - own) @ steps.T, s.probes, axis=1)[:, : s.probes]
        points = np.concatenate([own[:, None], own[:, None] + steps[nearest]], axis=1)
        yield t, _key(points, 1000 * dim + t)


def _filed(classes: DataFrame, s: Settings, looked_into: bool) -> DataFrame:
    """(rep, signs, cell): the cell that each vector is filed under, or all that it looks into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["vector"].map(len).to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                v = np.stack(batch["vector"].iloc[at].to_list()).astype(np.float64)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                ids = batch["rep"].to_numpy()[at]
                signs = np.packbits(v @ np.random.default_rng([s.seed, dim]).standard_normal((dim, 64)) > 0, axis=1).view(np.int64)[:, 0]
                for i in range(0, len(v), 4096):
                    for _, keys in cells(v[i : i + 4096], s):
                        keys = keys if looked_into else keys[:, :1]
                        yield pd.DataFrame({"rep": np.repeat(ids[i : i + 4096], keys.shape[1]), "signs": np.repeat(signs[i : i + 4096], keys.shape[1]), "cell": keys.ravel()})

    return classes.select("rep", "vector").mapInPandas(run, "rep long, signs long, cell long")


def _dot(a: str, b: str, ta: Column, tb: Column) -> Column:
    """The dot product of two vectors, each over its largest component."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") / ta * (y.cast("double") / tb)), F.lit(0.0), lambda x, y: x + y)


def usable(vector: Column) -> Column:
    """No null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _scaled(vector: Column) -> tuple[Column, Column]:
    """The largest component without its sign, and the norm of the vector over it: neither under- nor overflows."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return top, F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") / top, F.lit(2.0))))


def candidate_pairs(classes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(a, b), a < b: classes (rep, vector) that meet in a cell."""
    x, y = _filed(classes, s, True).alias("x"), _filed(classes, s, False).alias("y")
    met = x.join(y, F.expr(f"x.cell = y.cell and x.rep != y.rep and bit_count(x.signs ^ y.signs) <= {s.signs}"))
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def links(classes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(a, b), a < b: the pairs that meet and have a cosine of at least the threshold."""
    left = classes.select(F.col("rep").alias("a"), F.col("vector").alias("va"), F.col("top").alias("ta"), F.col("norm").alias("na"))
    right = classes.select(F.col("rep").alias("b"), F.col("vector").alias("vb"), F.col("top").alias("tb"), F.col("norm").alias("nb"))
    met = candidate_pairs(classes, s).join(left, "a").join(right, "b").where(F.size("va") == F.size("vb"))
    return met.where(_dot("va", "vb", F.col("ta"), F.col("tb")) / (F.col("na") * F.col("nb")) >= s.threshold).select("a", "b")


def group(rows: DataFrame, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Equal vectors form a class that takes part once, with its size: copies are counted, not paired. Each row is a vector of its
    own, whatever its id: rows that share an id count each as links of others, of each other too if they are alike. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do those of different lengths; those of
    very small or very large components do. Null ids are linked like others, but are never a component's least id (null if no
    other is there) and not kept. Empty table: no rows. Other columns are ignored.
    """
    s = settings
    all_rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).withColumn("usable", usable(F.col("vector")))
    classes = all_rows.where("usable").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("members"))
    top, norm = _scaled(F.col("vector"))
    classes = written(classes.select("*", F.monotonically_increasing_id().alias("rep"), top.alias("top"), norm.alias("norm")), "classes")
    found = written(links(classes, s), "links")
    both = found.select("a", F.col("b").alias("rep")).union(found.select(F.col("b").alias("a"), F.col("a").alias("rep")))
    others = both.join(classes.select("rep", "members"), "rep").groupBy("a").agg(F.sum("members").alias("others"))
    joined = components(found)
    nodes = classes.select("vector", "rep", "least", "members").join(others, F.col("rep") == F.col("a"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    nodes = nodes.select("vector", "least", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    nodes = written(nodes, "nodes")
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(names, "component").select("vector", "n_links", "component_id")
    placed = all_rows.where("usable").join(nodes, "vector").select("vec_id", "n_links", "component_id")
    alone = all_rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
ORACLE = {
    "op6_embedding_dedup": """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    usable AS (
        SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
        WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
        WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
    reached AS (SELECT a AS vec_id, a AS root FROM links UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.vec_id WHERE r.root < l.b),
    counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
    least_ AS (SELECT vec_id, min(root) AS component FROM reached GROUP BY vec_id)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
    FROM v LEFT JOIN counted USING (vec_id) LEFT JOIN least_ USING (vec_id)"""
}
