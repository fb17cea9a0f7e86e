"""Records of text files whose separators may also stand inside quotes: CSV with line breaks in cells, JSON arrays and objects.

A file is read as pieces between separators, so it splits over tasks like any text file. Whether a piece begins inside
quotes, and at which depth of brackets, follows from the pieces before it: each block of a file is summed up under both
answers, the few sums per file are added up in order, and every piece then knows its state. A record is what
begins outside quotes at its level, up to where the next one begins. Only a record itself has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftrank.session import SPLIT_BYTES, cut_lineage


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file of a path; contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def worth_splitting(spark: SparkSession, path: str, split: bool | None) -> bool:
    """``split``, or whether a file of the path is longer than one task should read."""
    return largest_file(spark, path) > SPLIT_BYTES if split is None else split


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _depth(parts: Column, parity: int) -> Column:
    """Brackets opened less brackets closed in every other part."""
    text = F.array_join(F.filter(parts, lambda _, i: i % 2 == parity), "")
    return (_count(text, "[{") - _count(text, "]}")).cast("long")


def _assemble(pieces: DataFrame, separator: str, level: int) -> DataFrame:
    """``pieces`` (file, block, no, value, flips, outside, inside): quotes in the piece, and its change of depth if it begins
    outside or inside quotes. Gives (file, block, no, text, first, last), one row per record."""
    block = W.partitionBy("file", "block").orderBy("no")
    before = block.rowsBetween(W.unboundedPreceding, -1)
    turned = pieces.withColumn("turned", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    for begin in (0, 1):
        turned = turned.withColumn(f"change{begin}", F.when(F.col("turned") == begin, F.col("outside")).otherwise(F.col("inside")))
    laid = cut_lineage(turned.select(
        "file", "block", "no", "value", "flips", "turned", "change0", "change1",
        *[F.coalesce(F.sum(f"change{b}").over(before), F.lit(0)).alias(f"above{b}") for b in (0, 1)]))

    # One row per block of a file from here to ``states``: its quotes, its depth under either answer.
    in_order = W.partitionBy("file").orderBy("block")
    earlier = in_order.rowsBetween(W.unboundedPreceding, -1)
    blocks = laid.groupBy("file", "block").agg(
        F.sum("flips").alias("flips"), F.sum("change0").alias("change0"), F.sum("change1").alias("change1"))
    begun = blocks.withColumn("quoted", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("quoted") == 0, F.col("change0")).otherwise(F.col("change1"))
    begun = begun.withColumn("change", change).select(
        "file", "block", "quoted", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth"))

    outside = F.col("quoted") == 0
    states = laid.join(begun, ["file", "block"]).withColumn(
        "depth", F.col("depth") + F.when(outside, F.col("above0")).otherwise(F.col("above1"))).withColumn(
        "after", F.col("depth") + F.when(outside, F.col("change0")).otherwise(F.col("change1"))).withColumn(
        "begins", F.when(((F.col("turned") + F.col("quoted")) % 2 == 0) & (F.col("depth") <= level), F.col("no")))
    # The record that a block's first pieces continue began in the last block before it that has a beginning.
    carried = states.groupBy("file", "block").agg(F.max("begins").alias("begins")).select(
        "file", "block", F.last(F.when(F.col("begins").isNotNull(), F.struct("block", F.col("begins").alias("no"))),
                                ignorenulls=True).over(earlier).alias("carried"))
    own = F.last("begins", ignorenulls=True).over(block.rowsBetween(W.unboundedPreceding, W.currentRow))
    known = states.withColumn("own", own).join(carried, ["file", "block"]).withColumn(
        "record", F.coalesce(F.when(F.col("own").isNotNull(), F.struct("block", F.col("own").alias("no"))), F.col("carried")))
    place = F.struct("block", "no")
    grouped = known.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "no", "value"))).alias("pieces"),
        F.min("depth").alias("least"), F.max_by("after", place).alias("end"))
    return grouped.select(
        "file", F.col("record.block").alias("block"), F.col("record.no").alias("no"),
        F.array_join(F.col("pieces.value"), separator).alias("text"),
        (F.col("least") < level).alias("first"), (F.col("end") < level).alias("last"))


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("no"), "value")


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, block, no, text): the records of CSV files, quotes and line breaks as they are, without empty ones. A file's
    records are ordered by (block, no). ``encoding`` has to write quotes and line breaks as ASCII does."""
    pieces = _pieces(spark, path, "\n")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        pieces = pieces.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    none = F.lit(0).cast("long")
    rows = _assemble(pieces.select("*", _count(F.col("value"), '"').alias("flips"), none.alias("outside"), none.alias("inside")),
                     "\n", 0)
    return rows.select("file", "block", "no", F.regexp_replace("text", "\r$", "").alias("text")).where("text <> ''")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, no, text): the elements of files that hold one JSON array each, or the entries (``"key": value``) of one
    JSON object each, however the file is laid out in lines."""
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    pieces = _pieces(spark, path, ",").withColumn("parts", parts)
    rows = _assemble(pieces.select("file", "block", "no", "value", (F.size("parts") - 1).alias("flips"),
                                   _depth(F.col("parts"), 0).alias("outside"), _depth(F.col("parts"), 1).alias("inside")), ",", 1)
    text = F.when(F.col("first"), F.regexp_replace("text", r"^[\s\x{FEFF}]*[\[{]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    text = F.when(F.col("last"), F.regexp_replace("text", r"[\]}]\s*$", "")).otherwise(F.col("text"))
    return rows.select("file", "block", "no", F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("text")).where("text <> ''")
