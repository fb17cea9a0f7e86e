"""Question-chunk pairs, resume, reply cache and model annotation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.functions import fixed_values as fv
from siftrank.functions.keys import blake_key
from siftrank.functions.text import content_key
from siftrank.operators.models import ANNOTATED, Annotator, Retry, annotate
from siftrank.operators.search import top_k
from siftrank.session import broadcast_if_small, cut_lineage
from siftrank.sources.readers import CACHE_SCHEMA, read_reply_cache, read_store
from siftrank.sources.writers import append_rows

REPLY_COLUMNS = ["pair_key", "thought", "response", "status", "attempts"]


def asked(questions: DataFrame, question: str = "question") -> DataFrame:
    """Rows that hold a question."""
    return questions.where(F.coalesce(F.col(question), F.lit("")) != "")


def top_k_pairs(questions: DataFrame, chunks: DataFrame, k: int = fv.RETRIEVAL_DEPTH,
                digits: int | None = None) -> DataFrame:
    """Each question with its ``k`` best chunks; empty questions are not asked.

    ``questions(q_ord, question, embedding, …)`` and ``chunks(c_ord, file_name, text, embedding)``.
    Only ids and scores pass through the ranking; texts are joined to the k winners. When a count
    shows the winners to be few they are broadcast, so the chunk texts need no shuffle.
    """
    questions = asked(questions)
    hits = cut_lineage(top_k(questions, chunks, k, "q_ord", "c_ord", digits=digits))
    texts = chunks.select("c_ord", F.col("file_name").alias("filename"), F.col("text").alias("chunk_text"))
    found = texts.join(broadcast_if_small(hits, row_bytes=64), "c_ord")
    return found.join(questions.drop("embedding"), "q_ord")


def file_pairs(questions: DataFrame, chunks: DataFrame, reference: str = "referenced_file") -> DataFrame:
    """Each question with all chunks of the file it refers to."""
    return asked(questions).join(
        chunks.select(F.col("file_name").alias(reference), "pos", F.col("text").alias("chunk_text")), reference)


def questions_without_chunks(questions: DataFrame, chunks: DataFrame,
                             reference: str = "referenced_file") -> DataFrame:
    return asked(questions).join(
        chunks.select(F.col("file_name").alias(reference)), reference, "left_anti")


def pending_pairs(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs with their key that ``done(pair_key)`` does not list. Keys of other tools (BLAKE2b, 24 digits) count, too; they are
    worked out only if ``done`` has any."""
    keyed = pairs.withColumn("pair_key", content_key("question", "chunk_text"))
    left = keyed.join(done.select("pair_key"), "pair_key", "left_anti")
    other = done.where(F.length("pair_key") == 2 * fv.BLAKE_BYTES).select(F.col("pair_key").alias("_other"))
    if not other.isEmpty():
        left = left.withColumn("_other", blake_key("question", "chunk_text")).join(other, "_other", "left_anti").drop("_other")
    return left


def split_by_cache(pending: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pending pairs: those with a cached reply, and those that need a call."""
    # Rows with one key have the same question and chunk, so any of them will do.
    distinct = pending.select("pair_key", "question", "chunk_text").dropDuplicates(["pair_key"])
    known = distinct.select("pair_key").join(
        cache.select("pair_key", "thought", "response").dropDuplicates(["pair_key"]), "pair_key"
    ).select("*", F.lit("ok").alias("status"), F.lit(0).alias("attempts"))
    unknown = distinct.join(cache.select("pair_key"), "pair_key", "left_anti")
    return known, unknown


def annotate_pairs(pairs: DataFrame, make_annotator: Callable[[], Annotator], done: DataFrame,
                   cache: DataFrame | None = None, **options) -> DataFrame:
    """New pairs with thought and response: skip what is done, look replies up in the cache, ask the
    model once per distinct remaining pair, join the replies back. The pending pairs are written once,
    because three steps read them; the model is asked when the result is used."""
    pending = cut_lineage(pending_pairs(pairs, done))
    if cache is None:
        cache = pairs.sparkSession.createDataFrame([], CACHE_SCHEMA)
    known, unknown = split_by_cache(pending, cache)
    fresh = annotate(unknown, make_annotator, **options).select(*REPLY_COLUMNS)
    return pending.join(known.unionByName(fresh), "pair_key")


@dataclass
class AnnotationJob:
    """Annotation with durable replies: a second run adds nothing and calls nothing.

    Calls are made in batches of at most ``calls_per_commit`` pairs, the files of pending pairs one after the other, and each batch commits
    its replies before the next begins. What is asked again follows from the replies, so no other progress is kept. A run that is killed loses the calls of one batch; the next run finds the replies of the others.
    Output rows carry the number of their run. Failed calls are written with status ``error`` and are
    tried again by the next run, unless ``errors_are_done``; ``results`` shows the last run's rows of each pair, so a later success
    takes the place of an error.
    """

    spark: SparkSession
    output_path: str
    cache_path: str
    errors_are_done: bool = False
    calls_per_commit: int = 1000

    def done(self) -> DataFrame:
        earlier = read_store(self.spark, self.output_path, "pair_key string, status string", missing_ok=True)
        finished = earlier if self.errors_are_done else earlier.where("status = 'ok'")
        return finished.select("pair_key").distinct()

    def results(self) -> DataFrame:
        """Output rows, those of each pair's last run only; rows of outputs without a run number are the first."""
        rows = self._numbered()
        last = rows.groupBy("pair_key").agg(F.max("run").alias("run"))
        return rows.join(last, ["pair_key", "run"])

    def _numbered(self) -> DataFrame:
        try:
            rows = self.spark.read.option("mergeSchema", True).parquet(self.output_path)
        except AnalysisException:
            rows = read_store(self.spark, self.output_path, f"pair_key string, {ANNOTATED}", missing_ok=True)
        return rows.withColumn("run", F.coalesce("run", F.lit(0))) if "run" in rows.columns else rows.withColumn("run", F.lit(0))

    def run(self, pairs: DataFrame, make_annotator: Callable[[], Annotator], retry: Retry = Retry(),
            concurrency: int = fv.CALL_CONCURRENCY) -> None:
        replies_path = f"{self.cache_path.rstrip('/')}_replies"
        self._recover(replies_path)
        pending = cut_lineage(pending_pairs(pairs, self.done()))
        _, unknown = split_by_cache(pending, read_reply_cache(self.spark, self.cache_path))
        empty = self.spark.createDataFrame([], f"pair_key string, {ANNOTATED}")
        empty.write.mode("overwrite").parquet(replies_path)  # what was in it is in the cache now
        self._ask(unknown, replies_path, lambda batch: annotate(batch, make_annotator, retry=retry, concurrency=concurrency))
        replies = self.spark.read.schema(empty.schema).parquet(replies_path)
        append_rows(replies.where("status = 'ok'").select("pair_key", "thought", "response"), self.cache_path)
        known, _ = split_by_cache(pending, read_reply_cache(self.spark, self.cache_path))
        answers = known.unionByName(replies.where("status <> 'ok'"))
        number = self._numbered().agg(F.coalesce(F.max("run"), F.lit(0)).alias("run")).first().run + 1
        append_rows(pending.join(answers, "pair_key").withColumn("run", F.lit(number)), self.output_path)

    def _ask(self, unknown: DataFrame, replies_path: str, ask: Callable[[DataFrame], DataFrame]) -> None:
        """Replies of all ``unknown`` pairs, a commit for each file of at most ``calls_per_commit`` of them."""
        size = unknown.agg(F.count(F.lit(1)).alias("n")).first().n
        if not size:
            return
        files = -(-size // self.calls_per_commit)
        queue = cut_lineage(unknown.repartition(files), rows_per_file=self.calls_per_commit)
        for file in sorted(queue.inputFiles()):
            batch = self.spark.read.schema(queue.schema).parquet(file)
            append_rows(ask(batch).select(*REPLY_COLUMNS), replies_path)

    def _recover(self, replies_path: str) -> None:
        """Replies of a run that stopped before it added them to the cache."""
        kept = read_store(self.spark, replies_path, f"pair_key string, {ANNOTATED}", missing_ok=True).where("status = 'ok'")
        lost = kept.join(read_reply_cache(self.spark, self.cache_path), "pair_key", "left_anti")
        if not lost.isEmpty():
            append_rows(lost.select("pair_key", "thought", "response"), self.cache_path)


def pair_counts(pairs: DataFrame, done: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: pairs, pairs still to process, and distinct calls the cache does not save."""
    pending = pending_pairs(pairs, done)
    cached = cache.select("pair_key", F.lit(1).alias("cached")).distinct()
    per_key = pending.groupBy("pair_key").agg(F.count(F.lit(1)).alias("n")).join(cached, "pair_key", "left")
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("to_process"),
                       F.count_if(F.col("cached").isNull()).alias("calls"))
