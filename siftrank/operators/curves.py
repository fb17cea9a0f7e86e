"""Precision-recall, ROC and F1 curves of scored pairs, all models in one plan.

Everything starts from one table: positives and negatives per distinct score of each model, with
running totals from the highest score down. Rows with equal scores collapse in the map-side
combine, so a score shared by a third of all rows costs one row.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.functions import fixed_values as fv
from siftrank.functions.text import finite_or_null, to_int
from siftrank.operators.prefix import running_totals
from siftrank.operators.quality import pick_score_column, require_columns


def prepare_scores(df: DataFrame, query_col: str = "Question", label_col: str = "Label",
                   score_col: str | None = None) -> DataFrame:
    """``(model, label, score)`` of the rows with all values present and a finite score."""
    require_columns(df, ["model", query_col, label_col])
    score_col = score_col or pick_score_column(df, fv.CURVE_SCORE_COLUMNS)
    return (
        df.dropna(subset=[query_col, label_col, score_col])
        .select("model", to_int(label_col).alias("label"), finite_or_null(score_col).alias("score"))
        .where("score is not null")
    )


def count_by_score(scored: DataFrame) -> DataFrame:
    """``(model, score, tp, fp)``: positives and negatives at each distinct score. ``scored`` may be such counts itself, of several
    batches: they are added up. So every curve here takes rows or counts."""
    if {"tp", "fp"} <= set(scored.columns):
        return scored.groupBy("model", "score").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    return scored.groupBy("model", "score").agg(
        F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") != 1).alias("fp"))


class CurveCounts:
    """Counts by score kept as a table, one folder for each batch of scored rows.

    A new batch is counted and added; rows of earlier batches are not read again. A batch that is added a second time, after a failure,
    replaces itself. Labels beside 1 count as negatives, as in ``count_by_score``. ``merge`` puts all batches into one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, scored: DataFrame, batch: str) -> None:
        if not re.fullmatch(r"\w+", batch):
            raise ValueError(f"a batch is named by letters, digits and underscores: {batch!r}")
        count_by_score(scored).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def counts(self) -> DataFrame:
        """``(model, score, tp, fp)`` of all batches, as every curve takes it."""
        return count_by_score(self.spark.read.parquet(self.path).drop("batch"))

    def merge(self, path: str) -> CurveCounts:
        """All batches as one batch of a new table."""
        merged = CurveCounts(self.spark, path)
        merged.add(self.counts(), "merged")
        return merged


def require_mixed_labels(scored: DataFrame) -> DataFrame:
    """Fail, naming a model, unless every model has both classes and no label beside 0 and 1."""
    totals = scored.groupBy("model").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"),
        F.count(F.lit(1)).alias("rows"))
    seen = totals.where("pos = 0 or neg = 0 or pos + neg < rows").first()
    if seen or totals.isEmpty():
        name = seen.model if seen else "(no usable rows)"
        raise ValueError(f"need both labels 0 and 1 and no others: {name}")
    return scored


def cumulative_counts(scored: DataFrame, with_next: bool = False) -> DataFrame:
    """``count_by_score`` with running totals ``ctp, cfp`` and class totals ``pos, neg``."""
    counts = count_by_score(scored).withColumn("_down", -F.col("score"))
    next_row = {"next_tp": "tp", "next_fp": "fp"} if with_next else None
    # Class totals come from the sums per partition, as the offsets do: no second pass and no join on the model.
    running = running_totals(counts, ["model"], ["_down"], {"ctp": "tp", "cfp": "fp"}, next_row,
                             group_totals={"pos": "ctp", "neg": "cfp"})
    return running.drop("_down")


def pr_curve(scored: DataFrame) -> DataFrame:
    """One point per distinct score, and the end point at recall 0, precision 1 with no threshold."""
    points = cumulative_counts(scored)
    return _pr_points(points).unionByName(
        points.select("model").distinct().select(
            "model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
            F.lit(0.0).alias("recall")))


def _pr_points(points: DataFrame) -> DataFrame:
    return points.select(
        "model", F.col("score").alias("threshold"),
        (F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("precision"),
        (F.col("ctp") / F.col("pos")).alias("recall"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Step-wise area: recall gained at each score times the precision there."""
    step = F.col("tp") / F.col("pos") * F.col("ctp") / (F.col("ctp") + F.col("cfp"))
    return cumulative_counts(scored).groupBy("model").agg(F.sum(step).alias("average_precision"))


def prevalence(scored: DataFrame) -> DataFrame:
    """Share of positives of each model."""
    if {"tp", "fp"} <= set(scored.columns):
        return scored.groupBy("model").agg((F.sum("tp") / F.sum(F.col("tp") + F.col("fp"))).alias("prevalence"))
    return scored.groupBy("model").agg(F.avg("label").alias("prevalence"))


def roc_curve(scored: DataFrame, drop_collinear: bool = False) -> DataFrame:
    """One point per distinct score, and the origin with no threshold. ``drop_collinear`` leaves out
    points between two equal steps."""
    points = cumulative_counts(scored, with_next=drop_collinear)
    if drop_collinear:
        same_step = (F.col("next_tp") == F.col("tp")) & (F.col("next_fp") == F.col("fp"))
        points = points.where(~F.coalesce(same_step, F.lit(False)))
    curve = points.select("model", F.col("score").alias("threshold"),
                          (F.col("cfp") / F.col("neg")).alias("fpr"),
                          (F.col("ctp") / F.col("pos")).alias("tpr"))
    origin = points.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"))
    return curve.unionByName(origin)


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve; a tie between a positive and a negative counts one half."""
    below = F.col("fp") * (F.col("ctp") - F.col("tp") / 2.0)
    return cumulative_counts(scored).groupBy("model").agg(
        (F.sum(below) / (F.first("pos") * F.first("neg").cast("double"))).alias("roc_auc"))


def f1_by_threshold(scored: DataFrame) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    return _pr_points(cumulative_counts(scored)).select(
        "model", "threshold", (2 * p * r / (p + r + 1e-12)).alias("f1"))


def best_f1(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """Highest F1 of each model and the lowest threshold that reaches it, best model first.
    ``digits`` rounds F1 before the comparison, so ties do not hang on the last bit."""
    f1 = F.col("f1") if digits is None else F.round("f1", digits)
    best = F.max_by("threshold", F.struct(f1, -F.col("threshold")))
    return (
        f1_by_threshold(scored).groupBy("model")
        .agg(F.max(f1).alias("best_f1"), best.alias("threshold"))
        .orderBy(F.desc("best_f1"), "model")
    )


def model_deltas(metric: DataFrame, value: str, pairs: Mapping[str, str]) -> DataFrame:
    """Base and tuned model side by side for ``{base: tuned}``. A missing metric counts as 0 in the
    difference and as -1 in the order, which is by the tuned value, highest first."""
    spark = metric.sparkSession
    wanted = spark.createDataFrame(list(pairs.items()), "base string, tuned string")
    per_model = metric.select("model", value)

    def named(role: str) -> DataFrame:
        return per_model.select(F.col("model").alias(role), F.col(value).alias(f"{role}_{value}"))

    joined = wanted.join(named("base"), "base", "left").join(named("tuned"), "tuned", "left")
    zero = F.lit(0.0)
    return joined.select(
        "base", "tuned", f"base_{value}", f"tuned_{value}",
        (F.coalesce(f"tuned_{value}", zero) - F.coalesce(f"base_{value}", zero)).alias("delta"),
    ).orderBy(F.coalesce(f"tuned_{value}", F.lit(-1.0)).desc(), "base")


def similarity_label_correlation(scored: DataFrame) -> DataFrame:
    """Pearson and Spearman correlation of score and label per model.

    Both work on (score, label) counts. Spearman needs the average rank of every tie group, which
    comes from running counts over the distinct values.
    """
    cells = scored.groupBy("model", "score", "label").agg(F.count(F.lit(1)).alias("n"))

    def ranks(column: str) -> DataFrame:
        per_value = cells.groupBy("model", column).agg(F.sum("n").alias("same"))
        upto = running_totals(per_value, ["model"], [column], {"upto": "same"})
        return upto.select("model", column,
                           (F.col("upto") - (F.col("same") - 1) / 2.0).alias(f"{column}_rank"))

    ranked = cells.join(ranks("score"), ["model", "score"]).join(ranks("label"), ["model", "label"])
    return ranked.groupBy("model").agg(
        _weighted_corr("score", "label").alias("pearson"),
        _weighted_corr("score_rank", "label_rank").alias("spearman"))


def _weighted_corr(x: str, y: str):
    n = F.sum("n").cast("double")
    w, a, b = F.col("n").cast("double"), F.col(x).cast("double"), F.col(y).cast("double")
    sx, sy = F.sum(w * a), F.sum(w * b)
    cov = F.sum(w * a * b) - sx * sy / n
    spread = (F.sum(w * a * a) - sx * sx / n) * (F.sum(w * b * b) - sy * sy / n)
    return F.when(spread > 0, cov / F.sqrt(spread))
