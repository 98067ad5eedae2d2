"""Logistic regression with each recording left out of its own fit, all fits in one job.

The fit of all rows is found by Newton's method, one pass over the data for each step. A recording's own part of the loss is kept
as its derivatives up to the fourth there, for each label: 69 sums a recording and label. What a fold lacks is taken off the
total, its labels are weighed anew, and the fold's weights follow from that polynomial without the data. A recording with a
large share of all rows moves its fold too far for that: such folds, of which there can be but few, are fitted in the same
passes as the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Recordings with more than this share of all rows, or of those of a label, are fitted with the whole.
LARGE = 0.02
STEPS = 60


def _places(d: int) -> list[tuple[int, ...]]:
    """The distinct products of one to four of d values."""
    return [c for n in range(1, 5) for c in combinations_with_replacement(range(d), n)]


def _passes(rows: DataFrame, features: list[str], betas: np.ndarray, without: list, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of each model over the rows but those of the recording that it goes without."""
    d, m = betas.shape[1], len(betas)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((m, 1 + d + d * d))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), batch[features].to_numpy(float)])
            y = batch["label"].to_numpy(float)
            z = x @ betas.T
            p = 0.5 * (1 + np.tanh(z / 2))
            w = np.where(y[:, None] == 1, weights[:, 1], weights[:, 0])
            for j, out in enumerate(without):
                if out is not None:
                    w[batch["recording_id"].to_numpy() == out, j] = 0
            total[:, 0] += (w * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
            total[:, 1 : 1 + d] += (w * (p - y[:, None])).T @ x
            curve = w * p * (1 - p)
            total[:, 1 + d :] += np.einsum("nm,ni,nj->mij", curve, x, x).reshape(m, -1)
        yield pd.DataFrame({"model": np.repeat(np.arange(m), total.shape[1]), "at": np.tile(np.arange(total.shape[1]), m), "v": total.ravel()})

    got = rows.select("recording_id", "label", *features).mapInPandas(part, "model int, at int, v double").groupBy("model", "at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((m, 1 + d + d * d))
    out[got["model"], got["at"]] = got["v"]
    return out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(m, d, d)


def _fitted(rows: DataFrame, features: list[str], without: list, weights: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """The weights of each model, the intercept first: Newton's steps, halved where the loss does not fall."""
    d, m = len(features) + 1, len(without)
    at, step, best = np.zeros((m, d)), np.zeros((m, d)), np.full(m, np.inf)
    scale = np.ones(m)
    for _ in range(STEPS):
        tried = at + scale[:, None] * step
        loss, gradient, curve = _passes(rows, features, tried, without, weights)
        loss = loss + 0.5 * (ridge * tried**2).sum(axis=1)
        good = loss <= best + 1e-9 * np.abs(best)
        at, best = np.where(good[:, None], tried, at), np.where(good, loss, best)
        for j in np.flatnonzero(good):
            step[j] = -np.linalg.solve(curve[j] + np.diag(ridge) + 1e-12 * np.eye(d), gradient[j] + ridge * tried[j])
        scale = np.where(good, 1.0, scale / 2)
        if (np.abs(scale[:, None] * step).max(axis=1) < 1e-9 * (1 + np.abs(at).max(axis=1))).all():
            break
    return at


def _derivatives(rows: DataFrame, features: list[str], beta: np.ndarray) -> DataFrame:
    """(recording_id, label, n, t0, t1, ...): of each recording and label the sums of the loss's derivatives at ``beta``."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    z = sum((F.lit(float(b)) * v for b, v in zip(beta, x, strict=True)), F.lit(0.0))
    p = 1 / (1 + F.exp(-z))
    rows = rows.withColumn("_p", p)
    q = F.col("_p")
    order = [q - F.col("label"), q * (1 - q), q * (1 - q) * (1 - 2 * q), q * (1 - q) * (1 - 6 * q + 6 * q * q)]
    rows = rows.withColumns({f"_d{i + 1}": v for i, v in enumerate(order)})
    terms = []
    for i, c in enumerate(_places(len(x))):
        v = F.col(f"_d{len(c)}")
        for j in c:
            v = v * x[j]
        terms.append(F.sum(v).alias(f"t{i}"))
    return rows.groupBy("recording_id", "label").agg(F.count("*").alias("n"), *terms)


class _Polynomial:
    """A loss of ``d`` weights around a point, from the sums of its derivatives, as dense arrays."""

    def __init__(self, d: int):
        self.d, self.at = d, _places(d)
        self.many = np.array([factorial(len(c)) / np.prod([factorial(c.count(i)) for i in set(c)]) for c in self.at])
        self.size = np.array([len(c) for c in self.at])
        self.powers = np.array([[c.count(i) for i in range(d)] for c in self.at])

    def solve(self, sums: np.ndarray, start: np.ndarray, ridge: np.ndarray) -> np.ndarray:
        """The weights where the gradient, with that of the ridge, is zero."""
        weight = sums * self.many / np.array([factorial(n) for n in self.size])
        shift = np.zeros(self.d)
        for _ in range(STEPS):
            each = shift[None, :] ** self.powers
            gradient, curve = ridge * (start + shift), np.diag(ridge).astype(float)
            for i in range(self.d):
                k = self.powers[:, i]
                less = np.where(k > 0, k * shift[i] ** np.maximum(k - 1, 0), 0.0)
                rest = np.prod(np.delete(each, i, axis=1), axis=1)
                gradient[i] += (weight * less * rest).sum()
                for j in range(self.d):
                    kj = self.powers[:, j]
                    if i == j:
                        term = np.where(k > 1, k * (k - 1) * shift[i] ** np.maximum(k - 2, 0), 0.0) * rest
                    else:
                        lj = np.where(kj > 0, kj * shift[j] ** np.maximum(kj - 1, 0), 0.0)
                        term = less * lj * np.prod(np.delete(each, [i, j], axis=1), axis=1)
                    curve[i, j] += (weight * term).sum()
            step = -np.linalg.solve(curve + 1e-12 * np.eye(self.d), gradient)
            shift = shift + step
            if np.abs(step).max() < 1e-12 * (1 + np.abs(start).max()):
                break
        return start + shift


def left_out_weights(rows: DataFrame, features: list[str], l2: float = 1.0, large: float = LARGE) -> DataFrame:
    """(recording_id, intercept, weights): of each recording the logistic regression of all other recordings' rows.

    rows: (recording_id, label 0 or 1, features...), none null. In each fit both labels have the same weight in all; ``l2`` is the
    penalty of the weights (half their square), the intercept has none. A fold that is left with one label, or none, has null
    weights.
    """
    d = len(features) + 1
    ridge = np.array([0.0, *[l2] * len(features)])
    sizes = rows.groupBy("recording_id").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("ones"))
    whole = sizes.agg(F.sum("n"), F.sum("ones")).first()
    n, ones = int(whole[0] or 0), int(whole[1] or 0)
    schema = f"recording_id {rows.schema['recording_id'].dataType.simpleString()}, intercept double, weights array<double>"
    if not 0 < ones < n:
        return sizes.select("recording_id", F.lit(None).cast("double").alias("intercept"), F.lit(None).cast("array<double>").alias("weights"))
    over = (F.col("n") > large * n) | (F.col("ones") > large * ones) | (F.col("n") - F.col("ones") > large * (n - ones))
    big = [(r[0], int(r[1]), int(r[2])) for r in sizes.where(over).collect()]  # 3 / large at most
    balance = lambda a, b: (a / (2 * (a - b)), a / (2 * b)) if 0 < b < a else (0.0, 0.0)
    without = [None, *[r[0] for r in big]]
    weights = np.array([balance(n, ones), *[balance(n - a, ones - b) for _, a, b in big]])
    fits = _fitted(rows, features, without, weights, ridge)
    exact = {out: fit if w.any() else None for out, fit, w in zip(without, fits, weights, strict=True)}
    sums = _derivatives(rows, features, fits[0])
    places = [f"t{i}" for i in range(len(_places(d)))]
    got = sums.groupBy("label").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in places]).toPandas().set_index("label")
    total = {int(y): (int(r["n"]), r[places].to_numpy(float)) for y, r in got.iterrows()}
    both = sums.groupBy("recording_id").pivot("label", [0, 1]).agg(F.first("n").alias("n"), F.first(F.array(*places)).alias("t"))
    start, poly = fits[0], _Polynomial(d)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, n0, t0, n1, t1 in batch[["recording_id", "0_n", "0_t", "1_n", "1_t"]].itertuples(index=False, name=None):
                fit = exact.get(id_, 0)
                if isinstance(fit, int):
                    own = {0: (int(n0) if n0 == n0 else 0, t0), 1: (int(n1) if n1 == n1 else 0, t1)}
                    left = {y: total[y][0] - own[y][0] for y in (0, 1)}
                    fit = None
                    if min(left.values()) > 0:
                        w = {y: (left[0] + left[1]) / (2 * left[y]) for y in (0, 1)}
                        rest = sum(w[y] * (total[y][1] - (np.asarray(own[y][1], float) if own[y][0] else 0)) for y in (0, 1))
                        fit = poly.solve(rest, start, ridge)
                out.append((id_, None, None) if fit is None else (id_, float(fit[0]), [float(v) for v in fit[1:]]))
            yield pd.DataFrame(out, columns=["recording_id", "intercept", "weights"])

    return both.mapInPandas(solve, schema)


def left_out_ranks(rows: DataFrame, features: list[str], order: str, l2: float = 1.0) -> DataFrame:
    """(recording_id, intercept, weights, rank, n): each recording's rows ranked by the fit that went without it (ties by ``order``),
    and the rank of its first row of label 1; n + 1 where none is."""
    from pyspark.sql import Window

    fits = left_out_weights(rows, features, l2)
    score = F.col("intercept")
    for i, f in enumerate(features):
        score = score + F.col("weights")[i] * F.col(f)
    judged = rows.join(fits, "recording_id").withColumn("_score", F.round(score, 9))
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.col("_score").desc(), order))
    judged = judged.withColumn("_place", place)
    out = judged.groupBy("recording_id").agg(F.first("intercept").alias("intercept"), F.first("weights").alias("weights"), F.min(F.when(F.col("label") == 1, F.col("_place"))).alias("rank"), F.count("*").alias("n"))
    return out.withColumn("rank", F.coalesce("rank", F.col("n") + 1))
