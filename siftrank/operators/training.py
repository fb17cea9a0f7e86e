"""Training pairs: usable rows, prompts, class weights, seeded sample and split."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.functions import fixed_values as fv
from siftrank.functions.text import clip01, prompted_query, query_with_instruction, seeded_order, to_number
from siftrank.operators.prefix import positions
from siftrank.operators.quality import require_rows
from siftrank.session import broadcast_if_small, cut_lineage


def training_pairs(rows: DataFrame, question: str = "Question", chunk: str = "chunk_text",
                   label: str = "label", model_name: str | None = None,
                   prompt: str = fv.BGE_QUERY_PROMPT) -> DataFrame:
    """``(sentence1, sentence2, label)`` of the rows with a question, a chunk and a numeric label."""
    value = to_number(label)
    usable = value.isNotNull() & ~F.isnan(value) & (F.col(question) != "") & (F.col(chunk) != "")
    return rows.where(usable).select(
        prompted_query(question, model_name, prompt).alias("sentence1"),
        F.col(chunk).alias("sentence2"), value.alias("label"))


def require_training_pairs(pairs: DataFrame) -> DataFrame:
    return require_rows(pairs, "no usable training pair: check column names and labels")


def positives_only(pairs: DataFrame) -> DataFrame:
    return pairs.where("label > 0")


def require_positives(pairs: DataFrame) -> DataFrame:
    return require_rows(positives_only(pairs), "no positive pair left")


def instruct_pairs(rows: DataFrame, question: str = "Question", chunk: str = "chunk_text",
                   label: str = "label", instruction: str = "") -> DataFrame:
    """Pairs with the instruct template and the label cut to 0..1; rows whose label is not a whole
    number are left out (see ``unreadable_labels``)."""
    number = F.trim(F.col(label).cast("string")).try_cast("int")
    return rows.dropna(subset=[question, chunk, label]).select(
        query_with_instruction(question, instruction).alias("sentence1"),
        F.col(chunk).alias("sentence2"), clip01(number).cast("double").alias("label"),
        number.alias("_number")).where("_number is not null").drop("_number")


def unreadable_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """Labels that ``instruct_pairs`` cannot use, with their number of rows."""
    number = F.trim(F.col(label).cast("string")).try_cast("int")
    return rows.where(F.col(label).isNotNull() & number.isNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("num_rows"))


def class_weights(pairs: DataFrame) -> DataFrame:
    """``(class, num_rows, weight)``: each class weighs one half in total."""
    return pairs.groupBy((F.col("label") > 0).cast("int").alias("class")).agg(
        F.count(F.lit(1)).alias("num_rows")).withColumn(
        "weight", F.lit(0.5) / F.greatest("num_rows", F.lit(1)))


def with_class_weights(pairs: DataFrame) -> DataFrame:
    """Pairs with the weight of their class; the weight table has two rows at most."""
    weights = class_weights(pairs).select("class", "weight")
    return pairs.withColumn("class", (F.col("label") > 0).cast("int")).join(
        F.broadcast(weights), "class").drop("class")


def seeded_shuffle(rows: DataFrame, seed: int, keys: Sequence[str], name: str = "position") -> DataFrame:
    """Reproducible random position from 0 of every row, as ``(keys…, position)``; ``keys`` identify a
    row. Only the keys are sorted."""
    keyed = rows.select(*keys, seeded_order(seed, *keys).alias("_shuffle"))
    return positions(keyed, ["_shuffle", *keys], name).drop("_shuffle")


def mark_first(rows: DataFrame, n: int, seed: int, keys: Sequence[str], name: str) -> DataFrame:
    """Rows with ``name``: whether they are among the first ``n`` of the seeded shuffle.

    Nothing is sorted but a sliver: rows are counted by the first 16 bits of their digest (at most 65,536 counts), which
    tells the range in which row ``n`` lies; ranges before it are in, ranges after it out, and only rows of
    that one range are put in order.
    """
    digest = seeded_order(seed, *keys)
    bucket = F.substring(digest, 1, 4)
    before, edge = 0, None
    for r in sorted(rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if before + r.n > n:
            edge = r.bucket
            break
        before += r.n
    if edge is None:
        return rows.withColumn(name, F.lit(True))
    last = positions(rows.where(bucket == edge).select(*keys, digest.alias("_shuffle")), ["_shuffle", *keys], "_place")
    chosen = cut_lineage(last.where(F.col("_place") < n - before).select(*keys, F.lit(True).alias("_in")))
    marked = rows.join(broadcast_if_small(chosen, 64), list(keys), "left")
    return marked.select(*rows.columns, ((bucket < edge) | F.col("_in").isNotNull()).alias(name))


def sample_rows(rows: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows (all when there are fewer), chosen by a seeded shuffle; ``keys`` identify a row."""
    return mark_first(rows, n, seed, keys, "_first").where("_first").drop("_first")


def train_eval_split(rows: DataFrame, eval_fraction: float, seed: int, keys: Sequence[str],
                     max_rows: int | None = None) -> DataFrame:
    """Rows with ``split``: a seeded shuffle keeps ``max_rows`` of them, of which the first
    ``ceil(eval_fraction * rows)`` are ``eval``. A fraction of 0 leaves everything in ``train``."""
    if eval_fraction and not 0.0 < eval_fraction < 1.0:
        raise ValueError("eval_fraction must be between 0 and 1 (exclusive)")
    if max_rows is not None:
        rows = cut_lineage(sample_rows(rows, max_rows, seed, keys))
    num_eval = math.ceil(eval_fraction * rows.count()) if eval_fraction else 0
    marked = mark_first(rows, num_eval, seed, keys, "_eval") if num_eval else rows.withColumn("_eval", F.lit(False))
    return marked.withColumn("split", F.when(F.col("_eval"), "eval").otherwise("train")).drop("_eval")
