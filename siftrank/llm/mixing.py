"""Mixing sources to target weights by Poisson replication.

A source whose target share is r times its own share is repeated r times on average: each document draws its number of
copies from a Poisson distribution with mean r, by inverting the distribution function at a number from 0 to 1
that is a hash of the seed and the document's key. Copies are then dealt out and ordered by another hash, which
shuffles the whole table. Everything is a function of the data and the seed, so a lost task gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.session import broadcast_if_small

SEED = 17
#: Without given targets a source's share is in proportion to its size to this power.
POWER = 0.7


def hashed(*parts: Column | str, digits: int = 13) -> Column:
    """The first hex digits of the md5 of the parts, joined by colons, as a number."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ... up to where nothing is left, for a positive rate."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    begin = F.struct(F.array().cast("array<double>").alias("cdf"), F.lit(0.0).alias("sum"), (-rate).alias("log"))

    def add(state, k):
        log = state["log"] + F.when(k == 0, F.lit(0.0)).otherwise(F.log(rate) - F.log(F.greatest(k, F.lit(1)).cast("double")))
        total = state["sum"] + F.exp(log)
        return F.struct(F.concat(state["cdf"], F.array(total)).alias("cdf"), total.alias("sum"), log.alias("log"))

    return F.aggregate(F.sequence(F.lit(0), last), begin, add, lambda s: s["cdf"])


def source_rates(documents: DataFrame, source: str, text: str, targets: Mapping[str | None, float] | None,
                 power: float, expansion: float) -> DataFrame:
    """(source, size, rate): characters, at least one for each document, and mean copies. A source without target has rate 0."""
    sizes = documents.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.sum(F.greatest(F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(1)).cast("long")).alias("size"))
    if targets is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        weight = F.lit(0.0)
        for name, value in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
        sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.lit(expansion) * F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")
    return sizes.crossJoin(F.broadcast(total)).select(  # one row of totals
        "source", "size", F.when(F.col("weight") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def mix_sources(documents: DataFrame, targets: Mapping[str | None, float] | None = None, power: float = POWER,
                expansion: float = 1.0, seed: int = SEED, key: str = "doc_id", source: str = "source",
                text: str = "text") -> DataFrame:
    """(row struct, copy, n_copies, place) for each copy of each row of ``documents``, shuffled.

    ``targets`` maps sources to weights of any sum; by default weights are size ** power. The output has about
    ``expansion`` times the input's characters. ``copy`` counts from 0, ``place`` is the hash that orders
    copies inside a partition, partitions being dealt out by it, too. NULL is a source of its own. Rows that repeat a key
    draw the same number; rows with NULL key draw one number together. A source of weight 0 goes. Columns of
    the input, whatever their names, are in ``row``. An empty table gives no rows.
    """
    rates = source_rates(documents, source, text, targets, power, expansion).where("rate > 0").select(
        F.col("source").alias("_source"), poisson_cdf(F.col("rate")).alias("_cdf"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
                            F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("_of"))
    # A table of one row per source; a source with very many rows is split by the adaptive join where it isn't broadcast.
    drawn = rows.join(broadcast_if_small(rates, 4096), F.col("_of").eqNullSafe(F.col("_source")))
    u = (hashed(f"{seed}", F.col("_key")) + 0.5) / float(1 << 52)
    drawn = drawn.select("row", "_key", F.size(F.filter("_cdf", lambda c: c <= u)).alias("n_copies")).where("n_copies > 0")
    copies = drawn.select("row", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"), "n_copies", "_key")
    placed = copies.select("row", F.col("copy").cast("long").alias("copy"), F.col("n_copies").cast("long").alias("n_copies"),
                           hashed(f"{seed} place", F.col("_key"), F.col("copy"), digits=15).alias("place"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "place").sortWithinPartitions("place")
