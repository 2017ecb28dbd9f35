"""Distances between array columns, as Catalyst expressions and as numpy kernels.

The expressions are for SQL-like use on any two columns; ``kernel`` is what the search operators use on whole
Arrow batches. Both compute with 64-bit floats; ``real=True`` casts to a 32-bit result.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(str, Enum):
    L2SQ = "l2sq"
    COS = "cos"
    HAMMING = "hamming"

    @classmethod
    def of(cls, name: str | Metric) -> Metric:
        """By any of its names: l2sq, cos, cosine, hamming, ``dist_*_ops``, ``*_dist`` or the infix operator."""
        if isinstance(name, cls):
            return name
        key = _ALIASES.get(name.lower())
        if key is None:
            raise ValueError(f"unknown metric: {name}")
        return key

    @property
    def operator(self) -> str:
        return {Metric.L2SQ: "<->", Metric.COS: "<=>", Metric.HAMMING: "<+>"}[self]


_ALIASES = {
    alias: m
    for m, names in ((Metric.L2SQ, ("l2sq", "l2", "<->")), (Metric.COS, ("cos", "cosine", "<=>")), (Metric.HAMMING, ("hamming", "ham", "<+>")))
    for n in names
    for alias in ((n,) if n.startswith("<") else (n, f"dist_{n}_ops", f"dist_vec_{n}_ops", f"{n}_dist"))
}


def _checked(a: Column, b: Column, value: Column, kind: str) -> Column:
    message = F.concat(F.lit("expected equally sized arrays but got arrays with dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast(kind)).when(F.size(a) != F.size(b), F.raise_error(message).cast(kind)).otherwise(value)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _double(a: Column) -> Column:
    return a.cast("array<double>")


def l2sq_dist(a: Column, b: Column, real: bool = False) -> Column:
    """Squared Euclidean distance; integers are widened, null gives null, unequal lengths an error."""
    a, b = _double(a), _double(b)
    out = _checked(a, b, _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))), "double")
    return out.cast("float") if real else out


def cos_dist(a: Column, b: Column, real: bool = False) -> Column:
    """1 - cosine. A zero vector is at 1 from any other and at 0 from another zero vector."""
    a, b = _double(a), _double(b)
    norm = lambda v: _total(F.transform(v, lambda x: x * x))
    product = F.sqrt(norm(a)) * F.sqrt(norm(b))
    apart = F.greatest(F.lit(0.0), 1 - _total(F.zip_with(a, b, lambda x, y: x * y)) / product)
    out = _checked(a, b, F.when(product > 0, apart).when((norm(a) == 0) & (norm(b) == 0), 0.0).otherwise(1.0), "double")
    return out.cast("float") if real else out


def hamming_dist(a: Column, b: Column) -> Column:
    """Bits that differ between arrays of 32-bit words."""
    bits = F.zip_with(a.cast("array<int>"), b.cast("array<int>"), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))))
    return _checked(a, b, F.aggregate(bits, F.lit(0), lambda s, x: s + x), "int")


def generic_dist(*_: Column) -> Column:
    """The untyped operator has no meaning outside an index: always an error."""
    return F.raise_error(F.lit("operator can only be used inside of an index")).cast("double")


def distance(metric: str | Metric, a: Column, b: Column) -> Column:
    return {Metric.L2SQ: l2sq_dist, Metric.COS: cos_dist, Metric.HAMMING: hamming_dist}[Metric.of(metric)](a, b)


def literal(values) -> Column:
    """An array column of a Python sequence."""
    return F.array(*[F.lit(v) for v in values])


def _words(x: np.ndarray) -> np.ndarray:
    """Pairs of 32-bit words as one of 64 bits."""
    x = x.astype(np.int64).astype(np.uint32)
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, x.shape[1] % 2)))).view(np.uint64).reshape(len(x), (x.shape[1] + 1) // 2)


def kernel(metric: str | Metric) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of every row of a matrix from every row of another."""
    metric = Metric.of(metric)

    def l2sq(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        if len(q) <= 8:
            return np.stack([((x - v) ** 2).sum(1) for v in q], 1) if len(q) else np.zeros((len(x), 0))
        return np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (x @ q.T), 0)

    def cos(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        nx, nq = np.sqrt((x * x).sum(1))[:, None], np.sqrt((q * q).sum(1))[None, :]
        product = nx * nq
        out = np.maximum(1 - (x @ q.T) / np.where(product > 0, product, 1), 0)
        return np.where(product > 0, out, np.where((nx == 0) & (nq == 0), 0.0, 1.0))

    def hamming(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        x, q = _words(x), _words(q)
        out = np.zeros((len(x), len(q)), np.int32)
        for k in range(x.shape[1]):
            out += np.bitwise_count(x[:, k][:, None] ^ q[:, k][None, :])
        return out.astype(np.float64)

    return {Metric.L2SQ: l2sq, Metric.COS: cos, Metric.HAMMING: hamming}[metric]
