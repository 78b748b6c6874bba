"""Column functions on dense vectors (array columns); sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null if an array is null or the lengths differ."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def linear(x: Column | str, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """W x + b as an array, one element for each row of W. W is a literal: use the Arrow embedder for wide layers."""
    rows = F.lit([[float(v) for v in row] for row in weights])
    out = F.transform(rows, lambda row: dot(row, x))
    return out if bias is None else F.zip_with(out, F.lit([float(v) for v in bias]), lambda s, b: s + b)


def relu(x: Column | str) -> Column:
    return F.transform(_c(x), lambda v: F.greatest(v, F.lit(0.0)))


def tanh(x: Column | str) -> Column:
    return F.transform(_c(x), lambda v: F.tanh(v))


def fuse_add(high: Column | str, low: Column | str, weight: float = 0.25) -> Column:
    """high + weight * low, element by element."""
    return F.zip_with(_c(high), _c(low), lambda h, lo: h.cast("double") + F.lit(weight) * lo.cast("double"))


def fuse_cat(high: Column | str, low: Column | str) -> Column:
    """High part first."""
    return F.concat(_c(high), _c(low))


FUSIONS = {"add": fuse_add, "fusion": fuse_add, "cat": fuse_cat}


def fused(high: Column | str, low: Column | str, mode: str) -> Column:
    """Fusion by name; an unknown mode is refused here and not at the first row."""
    if mode not in FUSIONS:
        raise ValueError(f"unknown fusion {mode!r}: use one of {sorted(FUSIONS)}")
    return FUSIONS[mode](high, low)


def printed(x: Column | str, digits: int = 4) -> Column:
    """The value that a decimal rendering of so many digits has: half goes to even, as in C's printf."""
    return F.bround(_c(x).cast("double"), digits)


def wide(features: Column | str, width: int) -> list[Column]:
    """width columns named 0, 1, ...; for export only."""
    return [_c(features)[i].alias(str(i)) for i in range(width)]


def tokens(features: Column | str, width: int) -> Column:
    """A flat output of several tokens as an array of vectors of the given width."""
    n = F.floor(F.size(_c(features)) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(_c(features), i * width + 1, width))).otherwise(F.array().cast("array<array<double>>"))
