"""Running totals and positions over a global order, without a single-task window.

A window ordered over a whole table (or over one group that holds a third of it) runs in one
task. Here the table is range-partitioned on (group, order), so a large group spans many
partitions. The layout is pinned with a checkpoint, each partition is summed, and the sums of the
partitions before it are added to a running total inside the partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftrank.session import cut_lineage

PIECE = "_piece"


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column | str],
    next_row: Mapping[str, str] | None = None,
    group_totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums, ascending in ``order``, restarted per ``group``.

    ``totals`` maps a new column to the column it sums. ``next_row`` maps a new column to the
    column whose value it takes from the following row. ``group_totals`` maps a new column to the entry of
    ``totals`` whose sum over the whole group it takes, from the same sums per partition. (group, order) must be unique per row,
    so rows that tie have to be aggregated first. NULL is a group of its own.
    """
    group, order, next_row, group_totals = list(group), list(order), dict(next_row or {}), dict(group_totals or {})
    laid = cut_lineage(
        df.repartitionByRange(*group, *order).withColumn(PIECE, F.spark_partition_id())
    )

    summaries = [F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()]
    if next_row:
        first = F.struct(*[F.col(c).alias(name) for name, c in next_row.items()])
        summaries.append(F.min_by(first, F.struct(*order)).alias("_first"))
    pieces = laid.groupBy(*group, PIECE).agg(*summaries)

    # One row per (group, partition): at most the partitions a group was spread over.
    by_piece = W.partitionBy(*group).orderBy(PIECE) if group else W.partitionBy(F.lit(0)).orderBy(PIECE)
    before = by_piece.rowsBetween(W.unboundedPreceding, -1)
    whole = by_piece.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = pieces.select(
        *[F.col(c).alias(f"_of_{c}") for c in [*group, PIECE]],
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals],
        *[F.sum(f"_sum_{t}").over(whole).alias(f"_whole_{n}") for n, t in group_totals.items()],
        *([F.lead("_first").over(by_piece).alias("_next_piece")] if next_row else []),
    )

    inside = W.partitionBy(*group, PIECE).orderBy(*order)
    to_here = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    same_piece = reduce(lambda a, b: a & b,
                        [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*group, PIECE]])
    joined = laid.join(offsets, same_piece)
    return joined.select(
        *df.columns,
        *[(F.sum(v).over(to_here) + F.col(f"_before_{n}")).alias(n) for n, v in totals.items()],
        *[F.col(f"_whole_{n}").alias(n) for n in group_totals],
        *[
            F.when(F.row_number().over(inside) == F.count(F.lit(1)).over(W.partitionBy(*group, PIECE)),
                   F.col(f"_next_piece.{n}"))
            .otherwise(F.lead(c).over(inside)).alias(n)
            for n, c in next_row.items()
        ],
    )


def positions(df: DataFrame, order: Sequence[str], name: str, group: Sequence[str] = (),
              start: int = 0) -> DataFrame:
    """Dense position of every row in ``order`` (unique within ``group``), from ``start``."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), group, order, {name: "_one"})
    return counted.withColumn(name, F.col(name) - 1 + start).drop("_one")
