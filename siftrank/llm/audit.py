"""Filter interaction audit: what each filter removes, alone and after others, in every order.

Five filters are conditions on a text; the fifth, E, removes a document whose whole text an earlier one (smaller
doc_id) has. E is a left-semi self-join on digest, exact text and smaller id; its ids are united with those of the other
failures and each document becomes one bit combination. All orders are worked out from the counts of the combinations, at
most 32 a part, so texts are read three times whatever the number of orders.

NULL texts are empty texts, NULL sources the part ''. A NULL doc_id is smaller or larger than no other. Rows with one id, and equal
rows, count each. A document is good (toxic) if any of its label rows says so. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.llm.quality_rules import words_of
from siftrank.llm.tables import with_flag
from siftrank.session import broadcast_if_small, cut_lineage

LETTERS = "ABCDE"
COPIES = 1 << LETTERS.index("E")
#: A group of equal texts is dealt out in pieces of at most this share of all rows.
PIECES = 1000


def _failed(text: Column, words: Column) -> list[Column]:
    """Failure of A to D."""
    return [F.size(words) < 50,
            100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
            100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
            text.rlike("[#$%&*|]")]


def _texts(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"),
                            F.xxhash64(text).alias("digest"))


def copies(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose text a row with a smaller ``doc_id`` has. ``keys`` has digest and doc_id of all rows.

    Only digests that several ids have are looked at. Of each text the smallest id stands for all on the right side. Groups above 1 / PIECES of all rows, of which there
    are fewer than PIECES, are dealt out in pieces on the left and repeated for each on the right."""
    groups = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    groups = cut_lineage(groups.where(F.col("first") < F.col("last")).select("digest", "n", "first"))
    total = max(keys.count(), 1)
    several = broadcast_if_small(groups.select("digest", "first"), 24)
    members = texts.join(several, "digest").drop("first")
    hot = groups.where(F.col("n") * PIECES > total).select(
        "digest", F.ceil(F.col("n") * PIECES / total).cast("int").alias("pieces"))
    hot = F.broadcast(hot)  # fewer than PIECES rows
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"), F.lit(0))
    left = members.join(hot, "digest", "left").withColumn("piece", piece).drop("pieces")
    firsts = members.where(F.col("doc_id").isNotNull()).groupBy("digest", "text").agg(F.min("doc_id").alias("doc_id"))
    right = firsts.join(hot, "digest", "left").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("digest", "piece", "text")]
    return a.join(b, reduce(Column.__and__, same) & (F.col("b.doc_id") < F.col("a.doc_id")), "left_semi").select("a.*")


def failure_bits(documents: DataFrame) -> DataFrame:
    """Columns doc_id, digest, part, mask (bit i: fails filter i) and n, the number of such rows."""
    texts = _texts(documents)
    worded = texts.withColumn("words", words_of(F.col("text")))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(_failed(F.col("text"), F.col("words")))]
    rows = cut_lineage(worded.select("doc_id", "digest", "part", reduce(Column.__add__, bits).alias("mask")))
    again = copies(texts, rows.select("doc_id", "digest")).select(
        "doc_id", "digest", "part", F.lit(COPIES).alias("mask"), F.lit(0).alias("n"))
    every = rows.withColumn("n", F.lit(1)).unionByName(again)
    return every.groupBy("doc_id", "digest", "part").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))


def combinations(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns part, mask, n, good, toxic: rows of each bit combination, and how many of them are labelled good and toxic."""
    told = labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
    rows = failure_bits(documents)
    for name, rule in (("is_good", "quality = 1"), ("is_toxic", "toxic = 1")):
        rows = with_flag(rows, told.where(rule).select("doc_id"), name)
    one = {"n": F.col("n"), "good": F.when(F.col("is_good"), F.col("n")), "toxic": F.when(F.col("is_toxic"), F.col("n"))}
    return rows.groupBy("part", "mask").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in one.items()])


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step. ``documents`` has doc_id, text and source, ``labels`` doc_id, quality and toxic."""
    whole = combinations(documents, labels).groupBy("part").agg(  # at most 32 entries a part
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("found"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = whole.select("part", "found", F.explode(orders).alias("filter_order")).select(
        "part", "found", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))

    def bits(letters: Column) -> Column:
        return reduce(Column.__add__, [F.when(F.contains(letters, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(LETTERS)])

    at = F.col("step")
    steps = steps.withColumn("bit", bits(F.substring("filter_order", at, F.lit(1)))).withColumn(
        "before", bits(F.substring("filter_order", F.lit(1), at - 1)))
    bit, before = F.col("bit"), F.col("before")

    def total(value, where) -> Column:
        return F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + F.when(where(x["mask"]), value(x)).otherwise(0).cast("long"))

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(bit) != 0

    def gone(mask: Column) -> Column:
        return mask.bitwiseAND(before) != 0

    def removed(mask: Column) -> Column:
        return fails(mask) & ~gone(mask)

    n = lambda x: x["n"]
    orders_first = F.lit(120)  # of all orders, a filter comes first among the k that a document fails in 120 / k
    return steps.select(
        "part", "filter_order", "step",
        total(n, lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda m: fails(m) & gone(m)).alias("redundant"),
        total(n, lambda m: m == bit).alias("unique_fails"),
        total(lambda x: x["good"], removed).alias("good_lost"),
        total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        total(lambda x: x["n"] * F.floor(orders_first / F.bit_count(x["mask"])), fails).alias("shapley"))
