"""Vector expressions. Arithmetic is in double whatever the element type."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_matrix(vectors: pa.Array) -> np.ndarray:
    """Arrow list column to a dense double matrix; all rows must have one length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return np.zeros((0, 0))
    if vectors.null_count:
        raise ValueError("NULL vector: drop such rows before scoring")
    sizes = pc.min_max(pc.list_value_length(vectors)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError(f"vectors differ in length: {sizes['min']} and {sizes['max']}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return flat.reshape(len(vectors), sizes["min"])


@F.arrow_udf(T.DoubleType())
def _dot(a: pa.Array, b: pa.Array) -> pa.Array:
    known = pc.and_(a.is_valid(), b.is_valid())
    left, right = to_matrix(a.filter(known)), to_matrix(b.filter(known))
    if left.shape != right.shape:
        raise ValueError(f"vectors differ in length: {left.shape[1]} and {right.shape[1]}")
    if known.false_count == 0:
        return pa.array(np.einsum("ij,ij->i", left, right))
    out = np.full(len(a), np.nan)
    out[known.to_numpy(zero_copy_only=False)] = np.einsum("ij,ij->i", left, right)
    return pa.array(out, mask=~known.to_numpy(zero_copy_only=False))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Inner product by Arrow batches: one NumPy call per batch, which wide vectors need."""
    return _dot(_col(a), _col(b))


def dot_native(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Inner product without a Python worker, for short vectors."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: ColumnOrName) -> Column:
    squares = F.aggregate(
        _col(v), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def l2_normalize(v: ColumnOrName, eps: float | None = None) -> Column:
    """Unit vector. Without ``eps`` a zero vector stays as it is; with it, divide by norm + eps."""
    vec, length = _col(v), norm(v)
    divisor = F.when(length == 0, 1.0).otherwise(length) if eps is None else length + eps
    return F.transform(vec, lambda x: (x.cast("double") / divisor).cast("float"))


def prob_yes(no_logit: ColumnOrName, yes_logit: ColumnOrName) -> Column:
    """Two-class softmax, probability of yes."""
    return 1.0 / (1.0 + F.exp(_col(no_logit) - _col(yes_logit)))


def log_sum_exp(logits: ColumnOrName) -> Column:
    """log(sum(exp(x))) of an array, shifted by its maximum."""
    values = _col(logits)
    top = F.array_max(values).cast("double")
    total = F.aggregate(
        values, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top)
    )
    return top + F.log(total)
