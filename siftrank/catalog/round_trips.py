"""Registered queries that write tables to the shared folder and read them back, and queries of what guards do."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from siftrank.catalog import fixtures as fx
from siftrank.catalog.queries import DIGITS, query, rounded
from siftrank.functions import keys
from siftrank.operators import coverage, curves, growing_index, index, models, quality, rank_metrics, scores
from siftrank.plans import annotation, corpus, score_files
from siftrank.session import broadcast_if_small, cut_lineage, scratch_folder
from siftrank.sources import readers, writers


def _new_folder(spark) -> str:
    return scratch_folder(spark, "round-trip")


def _documents(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _digested(df):
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "lang", "source")


@query
def csv_round_trip(spark, d):
    """Texts with line breaks and quotes through CSV, encoding and breaks found by the reader, missing cells as text."""
    path = f"{_new_folder(spark)}/documents.csv"
    docs = _documents(spark, d)
    writers.write_scores(docs, path, "csv", file_rows=writers.rows_per_file(docs))
    return _digested(readers.read_table(spark, path, empty_as_null=False))


@query
def csv_gz_round_trip(spark, d):
    path = f"{_new_folder(spark)}/documents.csv.gz"
    docs = _documents(spark, d)
    writers.write_scores(docs, path, "csv.gz", file_rows=writers.rows_per_file(docs))
    return _digested(readers.read_table(spark, path, empty_as_null=False, partitions=8))


@query
def json_corpus_round_trip(spark, d):
    path = f"{_new_folder(spark)}/corpus"
    fx.corpus(spark, d).select("file_name", "text_data").write.json(path)
    return readers.read_corpus(spark, path).select("file_name", F.md5("text_data").alias("text_md5"))


@query
def csv_split_round_trip(spark, d):
    """Texts with line breaks and quotes through CSV in ISO-8859-1, records put together from lines. Other characters become "?"."""
    path = f"{_new_folder(spark)}/documents.csv"
    latin = _documents(spark, d).withColumn("text", F.regexp_replace("text", r"[^\x00-\xFF]", "?"))
    latin.write.options(header=True, quote='"', escape='"', emptyValue="", encoding="ISO-8859-1").csv(path)
    return _digested(readers.read_csv(spark, path, empty_as_null=False, multi_line=True, encoding="ISO-8859-1", split=True))


ENTRIES_PER_FILE = 1000


@query
def json_array_round_trip(spark, d):
    """The corpus as JSON arrays of about ``ENTRIES_PER_FILE`` documents, elements put together from pieces."""
    rows = fx.corpus(spark, d).select(F.to_json(F.struct("file_name", "text_data")).alias("value"), "file_name")
    arrays = _in_files(rows, "file_name").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ", "), F.lit("]")).alias("value"))
    path = f"{_new_folder(spark)}/corpus"
    arrays.repartition("part").write.partitionBy("part").text(path)
    return readers.read_corpus(spark, path, lines=False, split=True).select("file_name", F.md5("text_data").alias("text_md5"))


def _in_files(rows, key: str):
    """``rows`` grouped by a digest of ``key`` into as many files as they need."""
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(rows.count() // ENTRIES_PER_FILE + 1)).alias("part"))


@query
def json_reply_cache_import(spark, d):
    """A reply cache in JSON objects of about ``ENTRIES_PER_FILE`` entries."""
    asked = fx.table(spark, d, "benchmark").select(
        F.to_json(F.array("text", F.concat(F.lit("chunk "), "item_id"))).alias("key"),
        F.array(F.lit("thought"), F.concat(F.lit("reply "), "item_id")).alias("value"))
    objects = _in_files(asked, "key").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("value"))
    path = f"{_new_folder(spark)}/cache"
    objects.repartition("part").write.partitionBy("part").text(path)
    cache = readers.read_json_reply_cache(spark, path)
    return cache.select("pair_key", "thought", "response", F.lit(readers.count_json_entries(spark, path)).cast("bigint").alias("entries"))


@query
def model_set_round_trip(spark, d):
    """Scores of two models written to a file each, and to one folder per model, read as one table."""
    folder, scored = _new_folder(spark), fx.scored_pairs(spark, d)
    for name, fmt in (("base", "csv"), ("tuned", "csv.gz")):
        writers.write_scores(scored.where(F.col("model") == name).drop("model"), f"{folder}/{name}.{fmt}", fmt)
    writers.write_scores(scored, f"{folder}/all.parquet", by_model=True)
    files = readers.read_models(spark, [f"base={folder}/base.csv", f"tuned={folder}/tuned.csv.gz"])
    folders = readers.read_table(spark, f"{folder}/all.parquet")
    both = files.select("model", F.col("label").cast("int").alias("label"), F.lit("files").alias("source")).unionByName(
        folders.select("model", "label", F.lit("folders").alias("source")))
    return both.groupBy("source", "model", "label").agg(F.count(F.lit(1)).alias("num_rows"))


def _counts_of_two_batches(spark, d):
    """Counts of the positives, then of the negatives, each added as a batch, the second one twice."""
    counts, scored = curves.CurveCounts(spark, f"{_new_folder(spark)}/counts"), fx.scored_pairs(spark, d)
    counts.add(scored.where("label = 1"), "positives")
    for _ in range(2):
        counts.add(scored.where("label = 0"), "negatives")
    return counts.counts()


@query
def pr_curve_batches(spark, d):
    return rounded(curves.pr_curve(_counts_of_two_batches(spark, d)), "precision", "recall")


@query
def roc_auc_batches(spark, d):
    return rounded(curves.roc_auc(_counts_of_two_batches(spark, d)), "roc_auc")


@query
def store_resume_round_trip(spark, d):
    """A chunk store filled with the labelled documents, then with all; nothing is done twice, empty files count as done."""
    store, docs = corpus.ChunkStore(spark, _new_folder(spark)), fx.corpus(spark, d)
    labelled = docs.join(fx.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("file_name", "text_data")
    store.add(labelled, models.letter_encoder, "first")
    store.add(docs.select("file_name", "text_data"), models.letter_encoder, "second")
    store.add(docs.select("file_name", "text_data"), models.letter_encoder, "third")
    chunks = store.chunks().groupBy("batch_id").agg(F.countDistinct("file_name").alias("files"), F.count(F.lit(1)).alias("chunks"))
    return chunks.select(F.col("batch_id").cast("string").alias("batch_id"), "files", "chunks",
                         F.lit(store.progress().count()).cast("bigint").alias("done"))


def _with_lengths(tables: index.TextTables) -> index.TextTables:
    """The same rows, joined, by keys that say, too, whether the length of a text is odd: ``q_odd`` and ``d_odd``. Texts that are NULL have none."""
    questions = tables.questions.withColumn("q_odd", F.length("Question") % 2)
    chunks = tables.chunks.withColumn("d_odd", F.length("chunk_text") % 2)
    rows, on = tables.rows, ([*tables.question_on, "q_odd"], [*tables.chunk_on, "d_odd"])
    for texts, keys in ((questions, on[0]), (chunks, on[1])):
        lengths = cut_lineage(texts.dropna(subset=keys).select(*keys).distinct())
        rows = rows.join(broadcast_if_small(lengths, 40), keys[:-1])
    return index.TextTables(cut_lineage(rows), questions, chunks, *on)


@query
def index_of_two_batches(spark, d):
    """An index over the judged rows of the questions and texts of even length, grown by all other rows; the second batch is added twice."""
    pairs, grown = _with_lengths(fx.text_tables(spark, d)), growing_index.GrowingIndex(spark, _new_folder(spark))
    early = F.col("q_odd") == F.col("d_odd")
    grown.add(dataclasses.replace(pairs, rows=pairs.rows.where(early)), "row_no", 0)
    for _ in range(2):
        grown.add(dataclasses.replace(pairs, rows=pairs.rows.where(~early)), "row_no", 1)
    return grown.index().judged.select("qid", "did", "relevant", "first_label", "first_row")


class _Refused(Exception):
    status = 400


def refusing_annotator():
    """Fails on questions of an odd number of characters: a refusal, which isn't worth another call."""
    inner = models.word_overlap_annotator()

    def reply(question: str, chunk: str):
        if len(question) % 2:
            raise _Refused("refused")
        return inner(question, chunk)

    return reply


@query
def annotation_job_twice(spark, d):
    """An annotation job with durable replies, run twice: failed calls are tried again, the others are not."""
    folder = _new_folder(spark)
    job = annotation.AnnotationJob(spark, f"{folder}/output", f"{folder}/cache")
    pairs = annotation.file_pairs(fx.file_questions(spark, d), fx.corpus(spark, d).select(
        "file_name", F.lit(0).alias("pos"), F.col("text_data").alias("text")))
    retry = models.Retry(attempts=2, base_seconds=0.0, retriable=models.server_error)
    for _ in range(2):
        job.run(pairs, refusing_annotator, retry=retry)
    output = job.results()
    replies = readers.read_reply_cache(spark, job.cache_path)
    kept = output.groupBy("conv_id", "turn", "status").agg(F.count(F.lit(1)).alias("num_rows"), F.max("attempts").alias("attempts"))
    return kept.withColumn("cached", F.lit(replies.count()).cast("bigint"))


@query
def other_keys_resume(spark, d):
    """Pairs that an earlier output with BLAKE2b keys, kept as CSV, does not list: it has the pairs of even conversations."""
    pairs = annotation.file_pairs(fx.file_questions(spark, d), fx.corpus(spark, d).select(
        "file_name", F.lit(0).alias("pos"), F.col("text_data").alias("text")))
    path = f"{_new_folder(spark)}/earlier.csv"
    earlier = pairs.where("conv_id % 2 = 0").select(keys.blake_key("question", "chunk_text").alias("pair_key"), F.lit("ok").alias("status"))
    writers.write_scores(earlier, path, "csv")
    left = annotation.pending_pairs(pairs, readers.read_table(spark, path))
    return left.select("conv_id", "turn", "pair_key")


@query
def failing_calls(spark, d):
    """Calls that fail with a server error are tried three times and reported as rows."""
    def make():
        class Busy(Exception):
            status = 503

        def reply(question: str, chunk: str):
            if len(question) % 2:
                raise Busy("busy")
            return "", question[:5]
        return reply

    asked = fx.table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), F.lit("c").alias("chunk_text"))
    rows = models.annotate(asked, make, retry=models.Retry(attempts=3, base_seconds=0.0, retriable=models.server_error))
    return rows.select("item_id", "thought", "response", "status", "attempts")


@query
def annotation_messages(spark, d):
    """System text and rendered prompt as the callable gets them."""
    def make():
        import hashlib

        return lambda system, prompt: (hashlib.md5(system.encode()).hexdigest(), hashlib.md5(prompt.encode()).hexdigest())

    asked = fx.table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), F.lit("c").alias("chunk_text"))
    return models.annotate(asked, make, messages=True).select("item_id", "thought", "response")


@query
def report_files(spark, d):
    """The report set of label coverage through files."""
    folder = _new_folder(spark)
    reports = coverage.coverage_reports(fx.labelled_rows(spark, d), check_columns=False)
    writers.write_reports(reports, folder)
    tables = [readers.read_csv(spark, f"{folder}/{name}").select(
        F.lit(name).alias("report"), F.to_json(F.struct("*")).alias("row")) for name in reports]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("report").agg(F.count(F.lit(1)).alias("num_rows"))


@query
def report_rows(spark, d):
    """Every cell of the report set of label coverage, read back from its files."""
    folder = _new_folder(spark)
    reports = coverage.coverage_reports(fx.labelled_rows(spark, d), check_columns=False)
    writers.write_reports(reports, folder)
    out = None
    for name in reports:
        table = readers.read_csv(spark, f"{folder}/{name}")
        table = table.select([F.col(f"`{c}`").cast("string").alias(c) for c in table.columns])
        if table.columns:  # a report without rows has no header, either
            cells = table.unpivot([table.columns[0]], table.columns[1:], "column", "value")
            cells = cells.select(F.lit(name).alias("report"), F.col(f"`{table.columns[0]}`").alias("of"), "column", "value")
            out = cells if out is None else out.unionByName(cells)
    return out


def _evaluated(spark, d, models_):
    """Score files of ``models_`` over the judged texts. Run twice: the second run finds every model done."""
    rows = fx.text_tables(spark, d)
    built = index.build_index(rows, "row_no")
    files = score_files.ScoreFiles(spark, _new_folder(spark))
    for _ in range(2):
        files.add(rows, built, "row_no", models_, digits=DIGITS, check=False)
    return files


TWO_ENCODERS = score_files.Model("two encoders", models.letter_encoder, models.folded_letter_encoder)


@query
def model_reports(spark, d):
    """Metrics of a model that encodes questions and documents differently, both tasks, and of one that reads pairs, from files."""
    files = _evaluated(spark, d, [TWO_ENCODERS, score_files.Model("lengths", make_scorer=models.length_scorer)])
    return rounded(files.report(), *rank_metrics.metric_names())


@query
def model_score_files(spark, d):
    """The ranked scores of all pairs from the files of such a model."""
    table = _evaluated(spark, d, [TWO_ENCODERS]).full_corpus(F.md5)
    return table.select("model", "q_ord", "d_ord", "cos_full", "rank_full", "relevance_label", "Source", F.col("chunk_text").alias("chunk_md5"))


@query
def score_blocks(spark, d):
    """All pairs with scores and labels, added to one file set in blocks by two calls, the first of which stops after two blocks."""
    rows, blocks = fx.judged_rows(spark, d), score_files.ScoreBlocks(spark, _new_folder(spark))
    labels = scores.original_labels(rows, "row_no", "qid", "did", "relevance_label").where("Label <> 0")  # one row per pair; others have label 0
    queries, docs = fx.query_vectors(spark, d), fx.doc_vectors(spark, d)
    per_block = queries.count() * docs.count() // 4 + 1
    for most in (2, None):
        blocks.add(queries, docs, labels, rows_per_block=per_block, blocks=most, digits=DIGITS)
    return blocks.scores()


@query
def round_report(spark, d):
    """Mean price and quantity per flag, rounded to four digits and ordered."""
    report = fx.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.avg(F.col("l_extendedprice").cast("double")).alias("price"), F.avg(F.col("l_quantity").cast("double")).alias("quantity"))
    return rank_metrics.round_report(report, ["l_returnflag", "l_linestatus"])


@query
def guard_messages(spark, d):
    """What the guards say: missing columns, and models whose labels are all alike."""
    scored, found = fx.scored_pairs(spark, d), []
    one_sided = scored.where("model = 'base' or label = 1")
    for name, check in (("columns", lambda: quality.require_columns(scored, ["model", "Question", "cos"])),
                        ("labels", lambda: curves.require_mixed_labels(one_sided)),
                        ("mixed", lambda: curves.require_mixed_labels(scored))):
        try:
            check()
            found.append((name, "fine"))
        except ValueError as error:
            found.append((name, str(error)))
    return scored.groupBy("model").agg(F.count(F.lit(1)).alias("num_rows")).crossJoin(
        F.broadcast(spark.createDataFrame(found, "guard string, message string")))  # three rows
