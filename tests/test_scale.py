"""What must not grow with the rows: texts that move, vectors that travel with pairs, hits and texts that a task holds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftrank.operators import chunking, index, models, pruned, scores, search
from siftrank.operators.search import SearchBudget
from siftrank.plans.score_files import Model, ScoreFiles
from tests.test_search import brute_force, vectors


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_picked_by_number_before_they_are_joined(spark):
    """The semi join on row numbers lies below the join that brings the texts."""
    lines = spark.range(40).select(F.col("id").alias("row_no"), (F.col("id") % 5).alias("t"), F.lit("1").alias("relevance_label"), F.lit("q").alias("Question"))
    texts = spark.range(5).select(F.col("id").alias("t"), F.concat(F.lit("text "), "id").alias("chunk_text"))
    built = index.build_index(lines.join(texts, "t"), "row_no")
    assert sorted(r.chunk_text for r in built.docs.collect()) == [f"text {i}" for i in range(5)]
    steps = plan(built.docs).splitlines()
    depth = {kind: max(len(s) - len(s.lstrip(" :+-")) for s in steps if f"Join {kind}" in s) for kind in ("Inner", "LeftSemi")}
    assert depth["LeftSemi"] > depth["Inner"]


def test_index_scores_join_digests_only(spark):
    rows = spark.createDataFrame([(0, " q", "a", "1"), (1, "q", "b ", "0"), (2, None, "a", "1"), (1, "q", "b ", "0")],
                                 "row_no long, Question string, chunk_text string, relevance_label string")
    built = index.build_index(rows, "row_no")
    run = built.judged.select("q_ord", "d_ord", F.col("d_ord").cast("double").alias("score"))
    of_pair = scores.index_scores(built, run)
    assert of_pair.columns == ["q_key", "d_key", "score"]
    texts = spark.createDataFrame([("q", "a", 0.0), ("q", "b", 1.0)], "question string, chunk_text string, score double")
    for given in (of_pair, texts):
        got = sorted(((r.row_no, r.cos) for r in scores.attach_scores(rows, given, "cos").collect()), key=str)
        assert got == [(0, 0.0), (1, 1.0), (1, 1.0), (2, None)]


@pytest.mark.parametrize("budget", [SearchBudget(), SearchBudget(query_bytes=200, document_bytes=300)])
def test_listed_pairs_as_a_join_gives_them(spark, budget):
    """Keys that repeat, that are missing or NULL, and NULL vectors; vectors do not travel with the pairs."""
    queries = spark.createDataFrame([(q % 6, [float(q), 1.0]) for q in range(8)] + [(9, None), (None, [1.0, 1.0])], "qid long, embedding array<float>")
    docs = spark.createDataFrame([(d % 20, [1.0, float(d)]) for d in range(25)] + [(30, None), (None, [1.0, 1.0])], "did int, embedding array<double>")
    listed = [(q, d, f"{q}-{d}") for q in (0, 1, 5, 7, 9, None) for d in (0, 3, 19, 30, 40, None)]
    pairs = spark.createDataFrame(listed * 2, "qid int, did long, tag string").repartition(5)
    found = search.score_candidates(pairs, queries, docs, digits=6, budget=budget)
    expect = pairs.join(docs.withColumnRenamed("embedding", "dv"), "did").join(queries.withColumnRenamed("embedding", "qv"), "qid").select(
        "qid", "did", "tag", F.expr("qv[0] * dv[0] + qv[1] * dv[1]").alias("score"))
    assert sorted(map(str, found.collect())) == sorted(map(str, expect.select(*found.columns).collect()))
    assert "Join" not in plan(found)


def test_listed_pairs_by_text_keys_and_of_unlike_lengths(spark):
    q = spark.createDataFrame([("a", [2.0])], "qid string, embedding array<double>")
    d = spark.createDataFrame([(1, [3.0])], "did long, embedding array<double>")
    assert [r.score for r in search.score_candidates(spark.createDataFrame([("a", 1)], "qid string, did long"), q, d).collect()] == [6.0]
    pairs = spark.createDataFrame([(1, 1)], "qid long, did long")
    with pytest.raises(Exception, match="differ in length"):
        search.score_candidates(pairs, spark.createDataFrame([(1, [1.0, 2.0])], "qid long, embedding array<double>"), d).collect()
    assert search.score_candidates(pairs, q.limit(0).select(F.lit(1).cast("long").alias("qid"), "embedding"), d).isEmpty()


def test_hits_that_a_task_holds_are_bounded(spark, monkeypatch):
    """No more queries at a time than ``held_hits`` allows, plain and pruned; the hits are the same."""
    rng = np.random.default_rng(3)
    queries, docs = rng.normal(size=(23, 4)).astype("float32"), rng.normal(size=(60, 4)).astype("float32")
    budget = SearchBudget(held_hits=20)
    q, d = vectors(spark, queries, "qid"), vectors(spark, docs, "did")
    assert {tuple(r) for r in search.top_k(q, d, 5, digits=6, budget=budget).collect()} == brute_force(queries, docs, 5)
    store = pruned.build_store(d, parts=3)
    assert {tuple(r) for r in pruned.top_k_pruned(q, store, 5, digits=6, budget=budget).hits.collect()} == brute_force(queries, docs, 5)

    seen = []
    monkeypatch.setattr(search, "_best_documents", lambda qids, *rest: seen.append(len(qids)) or iter(()))
    block = pa.RecordBatch.from_arrays([pa.array(range(23), pa.int64()), pa.array(queries.tolist())], names=["_id", "_vec"])
    list(search._multiply_shares(block, [block], 5, 6, budget, 0, []))
    assert seen and max(seen) <= 4


def test_chunking_makes_objects_of_few_texts_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(f"f{i}", "one two\nthree\n\nfour" if i % 7 else None) for i in range(300)], "file_name string, text_data string")
    got = {(r.file_name, r.pos): r.text for r in chunking.chunk_paragraphs(docs.coalesce(1), 2).collect()}
    assert got == {(f"f{i}", p): t for i in range(300) if i % 7 for p, t in enumerate(["one two", "three four"])}
    taken = []
    groups = chunking.paragraph_groups
    monkeypatch.setattr(chunking, "paragraph_groups", lambda t, n: taken.append(1) or groups(t, n))
    sizes = []
    array = pa.array
    monkeypatch.setattr(chunking.pa, "array", lambda values, **kw: sizes.append(len(values)) or array(values, **kw))
    chunking.split_texts(array(["a b"] * 200), 2)
    assert len(taken) == 200 and max(sizes) <= chunking.ROWS_AT_ONCE


def test_texts_are_kept_once_for_each_model(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"question {i % 5}", f"chunk {i % 7}", "1") for i in range(35)],
                                 "row_no long, Question string, chunk_text string, relevance_label string")
    built = index.build_index(rows, "row_no")
    files = ScoreFiles(spark, str(tmp_path))
    files.add(rows, built, "row_no", [Model("a", models.letter_encoder), Model("b", models.letter_encoder)], digits=6)
    assert not {"Question", "chunk_text"} & set(spark.read.parquet(files.paths["full_corpus"]).columns)
    table = files.full_corpus()
    assert table.count() == 70 and table.select("model", "Question", "chunk_text").distinct().count() == 70
    named = {(r.d_ord, r.chunk_text) for r in table.collect()}
    assert named == {(r.d_ord, r.chunk_text) for r in built.docs.collect()}
    assert {r.chunk_text for r in files.full_corpus(F.md5).collect()} == {r.m for r in built.docs.select(F.md5("chunk_text").alias("m")).collect()}
