"""The corpus pipeline: documents in a known language, no copies, no near copies, sources mixed, packed.

A stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of ``docs``; the last one returns
the packing plan. Column ``doc_id`` names a document; after mixing it may repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.llm.exact_dedup import exact_dedup
from siftrank.llm.language import UNDETERMINED, fit, identify
from siftrank.llm.mixing import mix_sources
from siftrank.llm.near_dedup import near_dedup
from siftrank.llm.packing import count_words, pack
from siftrank.llm.tables import table
from siftrank.session import broadcast_if_small, cut_lineage

#: A text of this many letters or more that needs more phrases than this share of its letters is in no learned language.
LETTERS = 20
PHRASES = 0.6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach. Texts without letters go, and longer texts that
    no language explains better than letter by letter."""
    model = fit(docs)
    rest = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"))
    known = (F.col("lang_pred") != UNDETERMINED) & (
        (F.col("letters") < LETTERS) | (F.col("phrases") <= PHRASES * F.col("letters")))
    return identify(rest, model, key="rest", keep_text=True).where(known).select("text", "key.*").select(docs.columns)


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id."""
    return exact_dedup(docs).where("kept").select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id. Rows are told apart by id and text, so a row that
    shares its id with a copy stays; of rows equal in both one stays. NULL ids come last."""
    row = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    names = docs.select("doc_id", row.alias("_row")).groupBy("_row").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    near = near_dedup(docs.select("text", row.alias("_row")), key="_row").where("n_shingles > 0").select(
        F.col("key").alias("_row"), "component_id").distinct()
    found = cut_lineage(near.join(names, "_row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    kept = found.groupBy("component_id").agg(first.alias("_row"))
    gone = cut_lineage(found.join(kept, "_row", "left_anti").select("_row"))
    rest = docs.withColumn("_row", row).join(broadcast_if_small(gone, 16), "_row", "left_anti")
    twice = cut_lineage(found.where("n > 1").join(gone, "_row", "left_anti").select("_row"))
    if not twice.isEmpty():
        some = broadcast_if_small(twice, 16)
        rest = rest.join(some, "_row", "left_anti").unionByName(rest.join(some, "_row", "left_semi").dropDuplicates(["_row"]))
    return rest.select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, towards their source's target share, and shuffled."""
    return mix_sources(docs).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 words; copies of a document never share one."""
    plan = pack(docs, count_words(F.col("text")), F.md5(F.coalesce("text", F.lit(""))))
    return plan.withColumnRenamed("key", "doc_id")


STAGES = [("language_id", language_id), ("exact_dedup", one_of_each_text), ("near_dedup", one_of_near_copies),
          ("mix_sources", mixed), ("best_fit_packing", packed)]

#: Language ID, near-duplicate components and packing have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
