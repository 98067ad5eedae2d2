"""Fixed-length arrays: rotation, circular kernels, masks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import ColumnOrName, col


def roll(x: ColumnOrName, by: ColumnOrName, n: int = 12) -> Column:
    """Element i of the result is element (i + by) mod n."""
    x, by = col(x), col(by)
    return F.concat(F.slice(x, by + 1, F.lit(n) - by), F.slice(x, F.lit(1), by))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth_circular(x: ColumnOrName, n: int, sigma: float) -> Column:
    """Gaussian smoothing of a circular array of n elements."""
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    weights = F.array(*[F.lit(w) for w in kernel])
    wrapped = F.concat(F.slice(x, n - r + 1, r), col(x), F.slice(x, 1, r))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: dot(F.slice(wrapped, i, 2 * r + 1), weights))


def intervals(mask: ColumnOrName) -> Column:
    """Steps between the set places of a mask, around the octave."""
    at = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: F.element_at(mask, i + 1) == 1)
    return F.transform(at, lambda p, i: F.pmod(F.coalesce(F.try_element_at(at, i + 2), F.element_at(at, 1)) - p + 11, F.lit(12)) + 1)


def canonical(x: ColumnOrName) -> Column:
    """The least of an array's rotations."""
    n = F.size(x)
    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.slice(x, k + 1, n - k), F.slice(x, F.lit(1), k))))
