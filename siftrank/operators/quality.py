"""Checks of tables, runs and vectors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.functions.text import is_finite


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def pick_score_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """First candidate the table has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"missing score column (one of {tuple(candidates)})")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def run_quality(run: DataFrame, qid: str = "qid", did: str = "did",
                score: str = "score") -> DataFrame:
    """Per query: scored documents, distinct documents, repeated documents, unusable scores."""
    per_pair = run.groupBy(qid, did).agg(
        F.count(F.lit(1)).alias("copies"), F.count_if(~is_finite(score)).alias("bad")
    )
    return per_pair.groupBy(qid).agg(
        F.sum("copies").alias("num_scores"),
        F.count(F.lit(1)).alias("num_docs"),
        F.count_if(F.col("copies") > 1).alias("repeated_docs"),
        F.sum("bad").alias("bad_scores"),
    )


def require_sound_run(run: DataFrame, qid: str = "qid", did: str = "did",
                      score: str = "score") -> DataFrame:
    bad = run_quality(run, qid, did, score).where("repeated_docs > 0 or bad_scores > 0").first()
    if bad:
        raise ValueError(f"run has repeated documents or unusable scores, e.g. {bad.asDict()}")
    return run


def vector_dims(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Lengths that occur in a vector column and how often; one row when all agree."""
    return df.groupBy(F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias("num_vectors"))


def mismatched_vectors(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is missing or has another length than the store."""
    return df.where(F.col(vector).isNull() | (F.size(vector) != dim))


def unclean_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is missing, or has a number that is missing, NaN or infinite; ``problem`` says which."""
    odd = F.filter(vector, lambda x: ~is_finite(x.cast("double")))
    problem = F.when(F.col(vector).isNull(), "missing").when(F.size(odd) > 0, "not finite")
    return df.withColumn("problem", problem).where("problem is not null")
