import gzip
import json

import pytest
from pyspark.sql import functions as F

from siftrank.functions.text import content_key
from siftrank.operators import coverage, training
from siftrank.sources import readers, writers


def test_csv_encodings(spark, tmp_path):
    cases = {"utf8.csv": ("Question,n\ncafé,1\n", "utf-8"), "bom.csv": ("﻿Question,n\ncafé,1\n", "utf-8"),
             "latin.csv": ("Question,n\ncafé,1\n", "iso-8859-1")}
    for name, (text, encoding) in cases.items():
        path = tmp_path / name
        path.write_bytes(text.encode(encoding))
        df = readers.read_table(spark, str(path))
        assert df.columns == ["Question", "n"], name
        assert [tuple(r) for r in df.collect()] == [("café", "1")], name


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "t.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write('a,b\n"two\nlines","say ""hi"", ok"\n,x\n')
    assert {tuple(r) for r in readers.read_table(spark, str(path)).collect()} == {("two\nlines", 'say "hi", ok'), (None, "x")}
    kept = readers.read_table(spark, str(path), empty_as_null=False, partitions=3)
    assert {r.a for r in kept.collect()} == {"two\nlines", ""} and kept.rdd.getNumPartitions() == 3
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_table(spark, "x.xlsx")


def _small_blocks(spark, size=64):
    """Sets the bytes one task reads; gives back the setting to restore."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return before


ODD_CELLS = ["plain", "two\nlines", 'say ""hi""', "a,b", "\n\n", "", "x\r\ny", '""', "é漢\n,", "long " * 40 + "\nend"]


@pytest.mark.parametrize("size, end", [(37, "\n"), (41, "\r\n"), (1 << 20, "\n")])
def test_split_csv_reads_as_one_task_does(spark, tmp_path, size, end):
    def write(folder, end):
        folder.mkdir()
        rows = [f'{i},"{cell}","{ODD_CELLS[(i * 7) % 10]}"' for i in range(3) for cell in ODD_CELLS]
        for name in ("a.csv", "b.csv"):
            (folder / name).write_bytes(end.join(['n,"text, or\nnot",text2', *rows, ""]).encode())
        return str(folder)

    whole = readers.read_csv(spark, write(tmp_path / "whole", "\n"), split=False)
    path = write(tmp_path / "parts", end)
    before = _small_blocks(spark, size)
    try:
        parts = readers.read_csv(spark, path, split=True if end == "\n" else None)  # such ends need no asking
        pieces = spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions()
        got = sorted(map(repr, parts.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts.columns == whole.columns and len(got) == 60
    assert got == sorted(map(repr, whole.collect())) and (pieces > 50 or size > 64)


def test_split_csv_of_latin_text_and_without_rows(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes('q,"a b"\ncafé,"x\nß"\n"",ü\n'.encode("iso-8859-1"))
    for empty_as_null in (True, False):
        whole = readers.read_csv(spark, str(tmp_path / "latin.csv"), split=False, empty_as_null=empty_as_null)
        parts = readers.read_csv(spark, str(tmp_path / "latin.csv"), split=True, empty_as_null=empty_as_null)
        assert parts.columns == whole.columns and sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))
    (tmp_path / "head.csv").write_text('a,"b\nc"\n')
    assert readers.read_csv(spark, str(tmp_path / "head.csv"), split=True).count() == 0


@pytest.mark.parametrize("indent, size", [(None, 29), (1, 64), (1, 1 << 20)])
def test_split_json(spark, tmp_path, indent, size):
    texts = ['a, "b" ]}', "\\", '\\"', "[{", "x\ny", "", None, "é漢,", '{"a": [1, 2]}', ",", "\\\\,"]
    rows = [{"file_name": f"f{i}", "text_data": t} for i, t in enumerate(texts * 2)]
    cache = {json.dumps([f"q{i},", t or ""], ensure_ascii=False): [t or "", f"r{i}"] for i, t in enumerate(texts * 2)}
    (tmp_path / "c.json").write_text(json.dumps(rows, indent=indent) + "\n")
    (tmp_path / "cache.json").write_text(json.dumps(cache, indent=indent, ensure_ascii=False))
    (tmp_path / "none.json").write_text("[ ]\n")
    before = _small_blocks(spark, size)
    try:
        got = readers.read_corpus(spark, str(tmp_path / "c.json"), split=True).collect()
        replies = readers.read_json_reply_cache(spark, str(tmp_path / "cache.json")).collect()
        assert readers.read_corpus(spark, str(tmp_path / "none.json"), split=True).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.file_name, r.text_data or "") for r in got) == sorted((r["file_name"], r["text_data"] or "") for r in rows)
    assert sorted((r.thought, r.response) for r in replies) == sorted(map(tuple, cache.values()))


def test_repeated_keys_of_a_json_object_keep_the_last(spark, tmp_path):
    (tmp_path / "cache.json").write_text('{"[\\"q\\", \\"c\\"]": ["a", "b"], "[\\"q\\", \\"c\\"]": ["c", "d"]}')
    row = readers.read_json_reply_cache(spark, str(tmp_path / "cache.json")).first()
    assert (row.thought, row.response) == ("c", "d") and readers.count_json_entries(spark, str(tmp_path / "cache.json")) == 1


def test_json_tables(spark, tmp_path):
    rows = [{"file_name": "a", "text_data": "x\ny"}, {"file_name": "b", "text_data": None}]
    (tmp_path / "c.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    expect = {("a", "x\ny"), ("b", None)}
    assert {tuple(r) for r in readers.read_corpus(spark, str(tmp_path / "c.json")).collect()} == expect
    assert {tuple(r) for r in readers.read_corpus(spark, str(tmp_path / "c.jsonl"), lines=True).collect()} == expect
    assert readers.read_table(spark, str(tmp_path / "c.json")).count() == 2
    assert readers.read_table(spark, str(tmp_path / "c.jsonl"), empty_as_null=False).where("text_data = ''").count() == 1


def test_json_reply_cache(spark, tmp_path):
    path = tmp_path / "cache.json"
    path.write_text(json.dumps({json.dumps(["q1", "é"], ensure_ascii=False): ["t", "r"], json.dumps(["q2", "c"]): ["", "s"]},
                               ensure_ascii=False, indent=2))
    assert readers.count_json_entries(spark, str(path)) == 2
    key = spark.range(1).select(content_key(F.lit("q1"), F.lit("é"))).first()[0]
    got = {r.pair_key: (r.thought, r.response) for r in readers.read_json_reply_cache(spark, str(path)).collect()}
    assert got[key] == ("t", "r") and len(got) == 2


def test_models_and_scores_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q, 1", "c\n2", 0.5), ("", None, 1.5)], "Question string, chunk_text string, score double")
    for fmt, ext in (("csv", "csv"), ("csv.gz", "csv"), ("parquet", "parquet")):
        writers.write_scores(df, str(tmp_path / f"{fmt}.{ext}"), fmt)
    both = readers.read_models(spark, [f"base={tmp_path}/csv.csv", f"ft=x={tmp_path}/csv.gz.csv"][:1])
    assert {(r.model, r.Question, r.chunk_text, r.score) for r in both.collect()} >= {("base", "q, 1", "c\n2", "0.5")}
    two = readers.read_models(spark, {"a": f"{tmp_path}/csv.gz.csv", "b": f"{tmp_path}/csv.csv"})
    assert {r.model for r in two.select("model").distinct().collect()} == {"a", "b"} and two.count() == 4
    writers.write_scores(df.withColumn("model", F.lit("m")), str(tmp_path / "p"), by_model=True)
    assert (tmp_path / "p" / "model=m").is_dir()
    with pytest.raises(ValueError):
        writers.write_scores(df, str(tmp_path / "q"), "xlsx")


def labels(spark):
    rows = [("q1", "c", " Yes "), ("q1", "c", "0"), ("q1", "c", "2"), ("q2", "c", "TRUE"), ("q3", "c", "no"),
            ("q3", "c", "n/a"), ("q4", "c", "")]
    return spark.createDataFrame(rows, "Question string, chunk_text string, label string")


def test_coverage(spark):
    rows = labels(spark)
    assert coverage.label_summary(rows).first().asDict() == {"positives": 2, "negatives": 2, "total": 4, "dropped": 2}
    per_q = coverage.question_coverage(rows)
    got = {r.Question: tuple(r)[1:] for r in per_q.collect()}
    assert got == {"q1": (1, 1, 3, True, True, True), "q2": (1, 0, 1, True, False, False),
                   "q3": (0, 1, 1, False, True, False)}
    assert [r.Question for r in coverage.bad_questions(per_q).collect()] == ["q3", "q2"]
    assert tuple(coverage.coverage_summary(per_q).first()) == (3, 1, 2)
    wide = coverage.pos_neg_table(per_q)
    assert wide.columns == ["pos_count", "0", "1"]
    assert [tuple(r) for r in wide.collect()] == [(0, 0, 1), (1, 1, 1)]


def test_coverage_reports(spark, tmp_path):
    rows = labels(spark)
    with pytest.raises(ValueError, match="Expert_file"):
        coverage.coverage_reports(rows)
    writers.write_reports(coverage.coverage_reports(rows, check_columns=False), str(tmp_path))
    hist = readers.read_csv(spark, str(tmp_path / "positives_per_question_histogram"))
    assert {tuple(r) for r in hist.collect()} == {("0", "1"), ("1", "2")}


def test_training_pairs(spark):
    rows = spark.createDataFrame(
        [("q", "c", "1"), ("q", "c", "0.5"), ("q", "c", "x"), ("q", "c", "nan"), ("q", "c", None), ("", "c", "1"), ("q", None, "1")],
        "Question string, chunk_text string, label string")
    pairs = training.training_pairs(rows)
    assert sorted(r.label for r in pairs.collect()) == [0.5, 1.0]
    assert training.training_pairs(rows, model_name="BGE-small").first().sentence1.endswith("passages: q")
    assert training.positives_only(pairs.where("label < 0")).isEmpty()
    with pytest.raises(ValueError):
        training.require_positives(pairs.where("label < 0"))
    with pytest.raises(ValueError):
        training.require_training_pairs(pairs.where("label < 0"))
    weights = {r["class"]: r.weight for r in training.class_weights(pairs).collect()}
    assert weights == {1: 0.25}
    assert training.with_class_weights(pairs).select("weight").distinct().count() == 1


def test_instruct_pairs(spark):
    rows = spark.createDataFrame([("q", "c", "5"), ("q", "c", "-1"), ("q", "c", "0.5"), (None, "c", "1")],
                                 "Question string, chunk_text string, label string")
    assert sorted(r.label for r in training.instruct_pairs(rows).collect()) == [0.0, 1.0]
    assert [tuple(r) for r in training.unreadable_labels(rows).collect()] == [("0.5", 1)]


def test_sample_and_split_are_exact_and_repeatable(spark):
    df = spark.range(500).withColumn("x", F.col("id") * 2)
    one = {r.id for r in training.sample_rows(df, 40, 1, ["id"]).collect()}
    assert len(one) == 40 and one == {r.id for r in training.sample_rows(df.repartition(7), 40, 1, ["id"]).collect()}
    assert one != {r.id for r in training.sample_rows(df, 40, 2, ["id"]).collect()}
    assert training.sample_rows(df, 1000, 1, ["id"]).count() == 500
    split = training.train_eval_split(df, 0.1, 1, ["id"], max_rows=205)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"eval": 21, "train": 184}
    assert {r.split for r in training.train_eval_split(df, 0, 1, ["id"]).collect()} == {"train"}
    with pytest.raises(ValueError):
        training.train_eval_split(df, 1.5, 1, ["id"])


def test_lineage_scope_removes_its_tables(spark):
    from siftrank.session import cut_lineage, lineage_scope

    before = cut_lineage(spark.range(3))
    with lineage_scope(spark):
        inside = cut_lineage(spark.range(5))
        path = inside.inputFiles()[0]
        assert inside.count() == 5
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        spark.read.parquet(path).count()
    assert before.count() == 3


def test_first_of_a_seeded_shuffle(spark):
    rows = spark.range(5000).selectExpr("id", "id % 7 as v")
    order = [r.id for r in training.seeded_shuffle(rows, 3, ["id"]).orderBy("position").collect()]
    for n in (0, 1, 700, 4999, 5000, 9000):
        assert {r.id for r in training.sample_rows(rows, n, 3, ["id"]).collect()} == set(order[:n])
    split = training.train_eval_split(rows, 0.1, 3, ["id"], max_rows=1000).collect()
    assert {r.id for r in split} == set(order[:1000]) and {r.id for r in split if r.split == "eval"} == set(order[:100])
