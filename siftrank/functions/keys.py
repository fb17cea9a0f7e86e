"""Pair keys in the format of other tools' caches and outputs."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.functions import fixed_values as fv

ColumnOrName = Column | str


def blake_key(question: ColumnOrName, chunk: ColumnOrName) -> Column:
    """The pair's digest as other tools keep it in caches and outputs: BLAKE2b of 96 bits over the same bytes as ``content_key``,
    24 hex digits. Spark has no such function, so it is worked out on Arrow batches; NULL if either is NULL."""
    return _blake(question, chunk)


@F.arrow_udf(T.StringType())
def _blake(questions: pa.Array, chunks: pa.Array) -> pa.Array:
    def key(pair):
        question, chunk = pair
        if question is None or chunk is None:
            return None
        return hashlib.blake2b((question + fv.PAIR_SEPARATOR + chunk).encode("utf-8"), digest_size=fv.BLAKE_BYTES).hexdigest()

    return pa.array(map(key, zip(questions.to_pylist(), chunks.to_pylist())), pa.string())
