"""Scalar functions on vectors: columns in, columns out, all on the JVM.

Vectors are ARRAY<FLOAT> or ARRAY<DOUBLE>; arithmetic is in double precision whatever they are stored as. Projections, signs and
hyperplanes are made on the driver by NumPy's seeded generator and enter plans as literals; their size depends on the configuration, never
on the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_float(v: Column | str) -> Column:
    """Storage form."""
    return F.col(v).cast("array<float>") if isinstance(v, str) else v.cast("array<float>")


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def literal(m: np.ndarray) -> Column:
    """A vector or matrix as a constant array."""
    return F.array(*[literal(r) if isinstance(r, np.ndarray) else F.lit(float(r)) for r in m])


def project(v: Column | str, matrix: np.ndarray) -> Column:
    """v @ matrix, for a matrix of (dimension, n)."""
    return F.array(*[dot(v, literal(c)) for c in np.ascontiguousarray(matrix.T)])


def hyperplanes(dimension: int, n: int, seed: int) -> np.ndarray:
    """Normal deviates of a seeded generator in single precision, (dimension, n)."""
    return np.random.default_rng(seed).normal(0.0, 1.0, (dimension, n)).astype(np.float32).astype(np.float64)


def sign_bits(v: Column | str, planes: np.ndarray) -> Column:
    """1 where a projection is greater than zero; a projection of zero is bit 0."""
    return F.transform(project(v, planes), lambda x: (x > 0).cast("int"))


def gray_append(bits: Column) -> Column:
    """Partition index of sign bits, the first the most significant: each output bit is the exclusive or of all bits up to it."""
    return F.aggregate(bits, F.lit(0), lambda g, b: g * 2 + b.bitwiseXOR(g.bitwiseAND(F.lit(1))))


def partition_index(v: Column | str, planes: np.ndarray) -> Column:
    if planes.shape[1] > 31:
        raise ValueError("31 hyperplanes at most")
    return gray_append(sign_bits(v, planes))


def prefix_xor(x: Column, width: int) -> Column:
    out = x
    for s in range(1, width):
        out = out.bitwiseXOR(F.shiftright(x, s))
    return out


def partition_bits(partition: Column, width: int, gray_decode: str = "reference") -> Column:
    """The sign bits that a partition index is taken to stand for.

    ``inverse`` undoes ``gray_append``; ``reference`` takes the prefix exclusive or once more, as published results do. The two agree up to
    two hyperplanes.
    """
    if gray_decode == "inverse":
        return partition.bitwiseXOR(F.shiftright(partition, 1))
    if gray_decode == "reference":
        return prefix_xor(partition, width)
    raise ValueError("gray_decode is 'reference' or 'inverse'")


def code_of(bits: Column) -> Column:
    """Sign bits as one number, the first the most significant."""
    return F.aggregate(bits, F.lit(0), lambda g, b: g * 2 + b)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sketch_draws(dimension: int, columns: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of each input place: two draws of one generator, in that order."""
    rng, signs = np.random.default_rng(seed), np.array([-1.0, 1.0])
    columns_of = rng.integers(columns, size=dimension)
    return columns_of, rng.choice(signs, dimension)


def signed_sums(v: Column | str, columns: int, draws: tuple[np.ndarray, np.ndarray]) -> Column:
    """out[index[i]] += sign[i] * v[i]: the AMS projection and the count sketch."""
    index, sign = draws
    v, out = doubles(v), []
    for c in range(columns):
        mine = np.flatnonzero(index == c)
        terms = [F.element_at(v, int(i) + 1) * F.lit(float(sign[i])) for i in mine]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return F.array(*out)


def ams(v: Column | str, dimension: int, columns: int, seed: int) -> Column:
    if columns <= 0:
        raise ValueError("the AMS projection needs a positive dimension")
    return signed_sums(v, columns, sketch_draws(dimension, columns, seed))


def count_sketch(v: Column | str, dimension: int, columns: int, seed: int) -> Column:
    return signed_sums(v, columns, sketch_draws(dimension, columns, seed))


def lsh_bits(v: Column | str, planes: np.ndarray) -> Column:
    """Bucket as a string of bits; here a projection of zero is bit 1."""
    return F.array_join(F.transform(project(v, planes), lambda x: F.when(x >= 0, "1").otherwise("0")), "")


def chamfer(query: Column | str, document: Column | str) -> Column:
    """Sum over query tokens of the greatest product with a document token; -1e9 for a document without tokens.

    Both are ARRAY<ARRAY<...>>.
    """
    q, d = (F.col(x) if isinstance(x, str) else x for x in (query, document))
    best = F.aggregate(q, F.lit(0.0), lambda a, t: a + F.array_max(F.transform(d, lambda u: dot(t, u))))
    return F.when(F.size(d) == 0, F.lit(-1e9)).otherwise(best)
