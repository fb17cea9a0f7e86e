import json
import threading
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftrank.functions import keys as pair_keys
from siftrank.operators import chunking, models
from siftrank.plans import annotation
from siftrank.plans.corpus import ChunkStore
from siftrank.sources import readers
from siftrank.streaming.ingest import ingest_stream


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), readers.CORPUS_SCHEMA)


def test_golden_chunks(spark):
    df = corpus(spark, {"f": "a b\n\n c \nd e f g\nh", "blank": " \n ", "none": None})
    rows = chunking.chunk_paragraphs(df, 3).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("f", 0, "a b c", 3), ("f", 1, "d e f g", 4), ("f", 2, "h", 1)]
    assert {r.file_name for r in chunking.empty_files(df).collect()} == {"blank", "none"}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t　")), max_size=80), st.integers(1, 6))
def test_chunks_keep_all_words(text, size):
    chunks = list(chunking.paragraph_groups(text, size))
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    assert " ".join(c for c, _ in chunks) == " ".join(lines)
    assert all(n == len(c.split()) for c, n in chunks)
    assert all(n >= size for _, n in chunks[:-1])
    counted = chunking._count_chunks(text, [size])[0]
    assert (counted["chunks"], counted["tokens"]) == (len(chunks), sum(n for _, n in chunks))


def test_sweep_of_empty_corpus(spark):
    rows = chunking.chunk_size_sweep(corpus(spark, {"a": " "}), [100, 200]).collect()
    assert {tuple(r) for r in rows} == {(100, 0.0, 0), (200, 0.0, 0)}


def test_call_batch_plan(spark):
    df = spark.createDataFrame([(130,), (131,), (300,)], "num_chunks bigint")
    got = {r.num_chunks: (r.batch_size, r.num_calls) for r in chunking.call_batch_plan(df).collect()}
    assert got == {130: (130, 1), 131: (2, 66), 300: (3, 100)}


def test_store_resumes(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    docs = corpus(spark, {"a": "x y\nz", "b": "q", "blank": " "})
    store.add(docs.where("file_name = 'a'"), models.letter_encoder, "b1", 1)
    assert {r.file_name for r in store.progress().collect()} == {"a"}
    store.add(docs, models.letter_encoder, "b2", 1)
    assert {r.file_name for r in store.progress().collect()} == {"a", "b", "blank"}
    before = sorted(map(str, store.chunks().drop("embedding").collect()))
    store.add(docs, models.letter_encoder, "b3", 1)
    assert sorted(map(str, store.chunks().drop("embedding").collect())) == before and len(before) == 3
    assert {r.batch_id for r in store.chunks().collect()} == {"b1", "b2"}


def test_store_shows_nothing_of_a_run_that_was_killed(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "store"))
    docs = corpus(spark, {"a": "x y\nz", "b": "q", "blank": " "})
    for step in range(3):  # killed before the chunks, the files, the commit
        calls = []

        def killed(df, path, by=None):
            calls.append(path)
            if len(calls) > step:
                raise OSError("killed")
            df.write.mode("append").parquet(path)

        monkeypatch.setattr("siftrank.plans.corpus.append_rows", killed)
        with pytest.raises(OSError):
            store.add(docs, models.letter_encoder, f"killed{step}", 1)
        assert store.progress().count() == 0 and store.chunks(missing_ok=True).count() == 0
    monkeypatch.undo()
    store.add(docs, models.letter_encoder, "1", 1)
    assert sorted((r.file_name, r.pos, r.batch_id) for r in store.chunks().collect()) == [("a", 0, "1"), ("a", 1, "1"), ("b", 0, "1")]
    assert store.progress().count() == 3


def test_two_writers_at_once_add_no_chunk_twice(spark, tmp_path):
    barrier, texts = threading.Barrier(2), {"a": "x y\nz", "b": "q", "c": "r\ns", "d": " "}

    class Together(ChunkStore):
        def progress(self):
            found = super().progress()
            barrier.wait(60)  # both know the same files
            return found

    def add(names, batch):
        Together(spark, str(tmp_path / "store")).add(corpus(spark, {n: texts[n] for n in names}), models.letter_encoder, batch, 1)

    writers = [threading.Thread(target=add, args=a) for a in (("abd", "one"), ("bcd", "two"))]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    store = ChunkStore(spark, str(tmp_path / "store"))
    assert store.commits().count() == 2
    assert sorted((r.file_name, r.pos) for r in store.chunks().collect()) == [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1)]
    assert sorted(r.file_name for r in store.progress().collect()) == ["a", "b", "c", "d"]
    before = {(r.file_name, r.batch_id) for r in store.chunks().collect()}
    store.add(corpus(spark, {**texts, "e": "t"}), models.letter_encoder, "three", 1)
    assert {(r.file_name, r.batch_id) for r in store.chunks().collect()} == before | {("e", "three")}


def test_missing_store(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ChunkStore(spark, str(tmp_path / "nothing")).chunks()


def test_stream_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store = ChunkStore(spark, str(tmp_path / "store"))

    def run():
        ingest_stream(spark, str(source), store, models.letter_encoder, str(tmp_path / "ckpt"), 1).awaitTermination(120)

    (source / "1.jsonl").write_text(json.dumps({"file_name": "a", "text_data": "x y\nz"}) + "\n")
    run()
    assert store.chunks().count() == 2
    # a file that repeats a document adds only the new one
    (source / "2.jsonl").write_text("".join(
        json.dumps({"file_name": n, "text_data": "x y\nz"}) + "\n" for n in ("a", "b")))
    run()
    assert {(r.file_name, r.n) for r in store.chunks().groupBy("file_name").agg(F.count("*").alias("n")).collect()} \
        == {("a", 2), ("b", 2)}


def test_retry():
    calls, slept = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return x + 1

    assert models.call_with_retry(flaky, models.Retry(3), 1, sleep=slept.append) == (2, None, 3)
    assert slept == [1.0, 2.0]
    value, error, attempts = models.call_with_retry(
        lambda: 1 / 0, models.Retry(5, retriable=lambda e: not isinstance(e, ZeroDivisionError)), sleep=slept.append)
    assert value is None and isinstance(error, ZeroDivisionError) and attempts == 1


def test_encode(spark):
    df = spark.createDataFrame([(1, "aab"), (2, "aab"), (3, "123"), (4, None)], "id int, t string")
    for repeated in (False, True):
        got = {r.id: r.embedding for r in models.encode(df, "t", models.letter_encoder, repeated=repeated).collect()}
        assert set(got) == {1, 2, 3, 4} and got[4] is None and got[1] == got[2] and set(got[3]) == {0.0}
        assert got[1][:2] == pytest.approx([2 / 5 ** .5, 1 / 5 ** .5])


def test_encode_rate_and_repeated_calls(spark):
    acc = spark.sparkContext.accumulator(0)

    def make():
        def encoder(texts):
            acc.add(len(texts))
            return np.ones((len(texts), 2))
        return encoder

    df = spark.createDataFrame([("same",)] * 20 + [("other",)], "t string")
    out = models.encode(df, "t", make, repeated=True, calls_per_minute=60000, num_tasks=2)
    assert out.count() == 21
    out.collect()
    assert acc.value <= 4


def test_encode_failure_stops_the_job(spark):
    def make():
        def encoder(texts):
            raise RuntimeError("no such model")
        return encoder

    df = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match="no such model"):
        models.encode(df, "t", make, retry=models.Retry(1)).collect()


def pairs(spark):
    return spark.createDataFrame(
        [(1, "red fox", "a red fox"), (2, "red fox", "a red fox"), (3, "red fox", "blue whale"), (4, "bad", "x")],
        "n int, question string, chunk_text string")


def failing():
    reply = models.word_overlap_annotator()

    def ask(question, chunk):
        if question == "bad":
            raise RuntimeError("refused")
        return reply(question, chunk)

    return ask


def test_annotation_job_resumes_and_caches(spark, tmp_path):
    job = annotation.AnnotationJob(spark, str(tmp_path / "out"), str(tmp_path / "cache"))
    retry = models.Retry(2, base_seconds=0.0)
    job.run(pairs(spark), failing, retry)
    out = spark.read.parquet(job.output_path)
    rows = {r.n: r for r in out.collect()}
    assert rows[1].response == rows[2].response == "[ Guess ]: Yes\n[ Confidence ]: 100"
    assert rows[3].response.startswith("[ Guess ]: No")
    assert (rows[4].status, rows[4].thought, rows[4].response, rows[4].attempts) == ("error", "", "ERROR: refused", 2)
    assert readers.read_reply_cache(spark, job.cache_path).count() == 2  # distinct pairs that succeeded

    job.run(pairs(spark), models.word_overlap_annotator, retry)          # only the failed pair again
    again = spark.read.parquet(job.output_path)
    assert again.count() == 5 and again.where("status = 'ok' and n = 4").count() == 1
    job.run(pairs(spark), failing, retry)
    assert spark.read.parquet(job.output_path).count() == 5


def test_errors_can_count_as_done(spark, tmp_path):
    job = annotation.AnnotationJob(spark, str(tmp_path / "out"), str(tmp_path / "cache"), errors_are_done=True)
    for _ in range(2):
        job.run(pairs(spark), failing, models.Retry(1))
    assert spark.read.parquet(job.output_path).count() == 4


def test_replies_survive_a_lost_output(spark, tmp_path):
    job = annotation.AnnotationJob(spark, str(tmp_path / "out"), str(tmp_path / "cache"))
    todo = pairs(spark).where("n < 4")
    job.run(todo, models.word_overlap_annotator)
    other = annotation.AnnotationJob(spark, str(tmp_path / "out2"), job.cache_path)

    def broken():
        def ask(question, chunk):
            raise AssertionError("called although cached")
        return ask

    other.run(todo, broken, models.Retry(1))
    assert spark.read.parquet(other.output_path).where("status = 'ok'").count() == 3


def test_file_pairs(spark):
    chunks = spark.createDataFrame([("f", 0, "c0"), ("f", 1, "c1"), ("g", 0, "d0")], "file_name string, pos int, text string")
    questions = spark.createDataFrame([("q1", "f"), ("", "f"), (None, "g"), ("q2", "missing")],
                                      "question string, referenced_file string")
    got = {(r.question, r.pos, r.chunk_text) for r in annotation.file_pairs(questions, chunks).collect()}
    assert got == {("q1", 0, "c0"), ("q1", 1, "c1")}
    assert [r.question for r in annotation.questions_without_chunks(questions, chunks).collect()] == ["q2"]


def test_a_killed_run_keeps_the_batches_it_committed(spark, tmp_path):
    """The callable dies half way; the second run calls only what no batch has committed."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def counting(limit):
        def make():
            def reply(question, chunk):
                if len(list(calls.iterdir())) >= limit:
                    raise KeyboardInterrupt("killed")
                (calls / uuid.uuid4().hex).touch()
                return "", question
            return reply
        return make

    todo = spark.range(20).selectExpr("concat('q', id) as question", "'c' as chunk_text", "id")
    job = annotation.AnnotationJob(spark, str(tmp_path / "out"), str(tmp_path / "cache"), calls_per_commit=2)
    with pytest.raises(Exception):
        job.run(todo, counting(9), models.Retry(1), concurrency=1)
    made = len(list(calls.iterdir()))
    committed = spark.read.parquet(f"{job.cache_path}_replies").where("status = 'ok'").count()
    assert 9 <= made <= 17 and committed >= 6  # whole batches only, all but the last
    job.run(todo, counting(1000), models.Retry(1), concurrency=1)
    assert len(list(calls.iterdir())) == made + 20 - committed
    assert sorted(r.response for r in job.results().collect()) == sorted(f"q{i}" for i in range(20))


def test_results_have_the_last_rows_of_each_pair(spark, tmp_path):
    job = annotation.AnnotationJob(spark, str(tmp_path / "out"), str(tmp_path / "cache"))
    job.run(pairs(spark), failing, models.Retry(1))
    job.run(pairs(spark), failing, models.Retry(1))
    assert {r.n: r.status for r in job.results().collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "error"} and job.results().count() == 4
    job.run(pairs(spark), models.word_overlap_annotator, models.Retry(1))
    assert {r.n: r.status for r in job.results().collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "ok"} and job.results().count() == 4
    assert [r.n for r in job.results().where("run = 3").collect()] == [4]


def test_keys_of_other_tools(spark):
    """Golden digests, and pairs that an output with such keys lists are done."""
    rows = [("What is β?", "a chunk"), ("", ""), (None, "x"), ("q", "c")]
    df = spark.createDataFrame(rows, "question string, chunk_text string")
    keys = [r[0] for r in df.select(pair_keys.blake_key("question", "chunk_text")).collect()]
    assert keys == ["6e12d7819157232852fc8607", "1bb7b835aec6a21a17ea5d85", None, "1076946d89624e35c3c84e94"]
    done = spark.createDataFrame([(keys[0],), (None,)], "pair_key string")
    left = annotation.pending_pairs(df.where("question is not null"), done)
    assert sorted(r.question for r in left.collect()) == ["", "q"]
    both = done.unionByName(left.where("question = 'q'").select("pair_key"))
    assert [r.question for r in annotation.pending_pairs(df.where("question is not null"), both).collect()] == [""]


def test_batches_of_like_length(spark):
    """Padded batches stay within the budget, vectors and scores are those of single calls, in place."""
    texts = ["a" * n for n in (5, 900, 3, 40, 41, 7, 2000, 1, 39)] + [None, ""]

    def make():
        inner = models.letter_encoder()

        def encode_texts(batch):
            assert len(batch) == 1 or max(map(len, batch)) * len(batch) <= 100 and len(batch) <= 4
            return inner(batch) + np.array([[len(t)] + [1] * 25 for t in batch])
        return encode_texts

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    rows = models.encode(df, "t", make, batch_size=4, batch_chars=100).collect()
    alone = models.encode(df, "t", make, batch_size=1).collect()
    assert {r.i: r.embedding for r in rows} == {r.i: r.embedding for r in alone} and len(rows) == len(texts)
    assert [r.embedding for r in rows if texts[r.i] is None] == [None]
    sizes = [len(b) for b in models.length_batches(["x" * n for n in (50, 1, 50, 1, 101)], 4, 100)]
    assert sizes == [2, 2, 1]
