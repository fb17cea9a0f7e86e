"""Label coverage of a training table: distribution, per-question counts, histograms, crosstab."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.functions import fixed_values as fv
from siftrank.functions.text import to_label
from siftrank.operators.quality import require_columns


def coerce_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with ``label_num``, NULL where the label cannot be read."""
    return rows.withColumn("label_num", to_label(label))


def usable_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    return coerce_labels(rows, label).where("label_num is not null")


def label_summary(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: positives, negatives, their sum, and rows dropped for an unreadable label."""
    return coerce_labels(rows, label).agg(
        F.count_if(F.col("label_num") == 1).alias("positives"),
        F.count_if(F.col("label_num") == 0).alias("negatives"),
        F.count_if(F.col("label_num").isin(0, 1)).alias("total"),
        F.count_if(F.col("label_num").isNull()).alias("dropped"))


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return usable_labels(rows, label).groupBy("label_num").agg(F.count(F.lit(1)).alias("num_rows"))


def question_coverage(rows: DataFrame, question: str = "Question", label: str = "label") -> DataFrame:
    """Positives, negatives and rows per question, and whether it has both classes."""
    counts = usable_labels(rows, label).groupBy(question).agg(
        F.count_if(F.col("label_num") == 1).alias("pos_count"),
        F.count_if(F.col("label_num") == 0).alias("neg_count"),
        F.count(F.lit(1)).alias("total"))
    has_pos, has_neg = F.col("pos_count") > 0, F.col("neg_count") > 0
    return counts.select("*", has_pos.alias("has_pos"), has_neg.alias("has_neg"),
                         (has_pos & has_neg).alias("ok_pos_and_neg"))


def bad_questions(coverage: DataFrame, question: str = "Question") -> DataFrame:
    """Questions without both classes, fewest positives first."""
    return coverage.where(~F.col("ok_pos_and_neg")).orderBy(
        "pos_count", "neg_count", F.desc("total"), question)


def coverage_summary(coverage: DataFrame) -> DataFrame:
    ok = F.col("ok_pos_and_neg")
    return coverage.agg(F.count(F.lit(1)).alias("num_questions"), F.count_if(ok).alias("num_ok"),
                        F.count_if(~ok).alias("num_missing"))


def positives_histogram(coverage: DataFrame) -> DataFrame:
    return _histogram(coverage, "pos_count", "num_positives")


def negatives_histogram(coverage: DataFrame) -> DataFrame:
    return _histogram(coverage, "neg_count", "num_negatives")


def _histogram(coverage: DataFrame, column: str, name: str) -> DataFrame:
    return coverage.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias("num_questions"))


def pos_neg_counts(coverage: DataFrame) -> DataFrame:
    """Questions per (positives, negatives), long form."""
    return coverage.groupBy("pos_count", "neg_count").agg(F.count(F.lit(1)).alias("num_questions"))


def pos_neg_table(coverage: DataFrame) -> DataFrame:
    """Questions per positives (rows) and negatives (columns), zero filled, both in order. The columns
    are the distinct counts of negatives, so this is for reports; use the long form for more."""
    wide = pos_neg_counts(coverage).groupBy("pos_count").pivot("neg_count").agg(F.sum("num_questions"))
    return wide.na.fill(0).orderBy("pos_count")


def coverage_reports(rows: DataFrame, question: str = "Question", label: str = "label",
                     check_columns: bool = True) -> dict[str, DataFrame]:
    """The five report tables by name."""
    if check_columns:
        require_columns(rows, fv.TRAINING_COLUMNS)
    coverage = question_coverage(rows, question, label)
    return {
        "per_question_coverage": coverage,
        "questions_missing_pos_or_neg": bad_questions(coverage, question),
        "positives_per_question_histogram": positives_histogram(coverage).orderBy("num_positives"),
        "negatives_per_question_histogram": negatives_histogram(coverage).orderBy("num_negatives"),
        "joint_pos_neg_table": pos_neg_table(coverage),
    }
