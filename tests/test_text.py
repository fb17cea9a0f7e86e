import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftrank.functions import fixed_values as fv
from siftrank.functions import text as tx


def values(spark, rows, expr, schema="x string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


SAMPLES = ["", " ", "a", "  a b  ", "\x1fa\x1c", "  x\t\n", "a\x85", "a b", "​a", "one  two\n three\t", None]


def test_strip_and_tokens_like_python(spark):
    assert values(spark, SAMPLES, tx.strip("x")) == [s.strip() if s is not None else None for s in SAMPLES]
    counts = values(spark, SAMPLES[:-1], tx.token_count("x"))
    assert counts == [len(s.split()) for s in SAMPLES[:-1]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab" + fv.WHITESPACE)), max_size=12), min_size=20, max_size=40))
def test_strip_property(spark, texts):
    assert values(spark, texts, tx.strip("x")) == [s.strip() for s in texts]
    assert values(spark, texts, tx.token_count("x")) == [len(s.split()) for s in texts]


def test_to_int(spark):
    rows = ["1.9", "abc", "", None, " 2 ", "1e2", "inf", "nan", "3d", "4f", "-1.5", "99999999999"]
    assert values(spark, rows, tx.to_int("x")) == [1, 0, 0, 0, 2, 100, 0, 0, 0, 0, -1, 0]


def test_to_label(spark):
    rows = [" Yes ", "TRUE", "n/a", "0", "no", "False", "2", "1.0", None]
    assert values(spark, rows, tx.to_label("x")) == [1, 1, None, 0, 0, 0, 2, 1, None]


def test_facets(spark):
    rows = [" Factual", "FACTUAL ", None, "Straße"]
    assert values(spark, rows, tx.facet_key("x")) == ["factual", "factual", "nan", "strasse"]
    titles = ["on-axis beam", "o'neil 2nd", "éa b"]
    assert values(spark, titles, tx.title_case("x")) == [t.title() for t in titles]
    flags = ["TRUE", "0", " False ", "1", "maybe", None]
    assert values(spark, flags, tx.yes_no("x")) == ["yes", "no", "no", "yes", "maybe", "nan"]


def test_scores(spark):
    rows = ["0.5", "x", None, "NaN", "Infinity", "-Infinity"]
    assert values(spark, rows, tx.finite_or_null("x")) == [0.5, None, None, None, None, None]
    assert values(spark, rows, tx.zero_if_missing("x")) == [0.5, 0.0, 0.0, 0.0, None, None]
    assert values(spark, [-1, 0, 1, 5], tx.clip01("x"), "x int") == [0, 0, 1, 1]


def test_source_tag(spark):
    assert values(spark, [None, " ", "f1"], tx.source_tag("x")) == ["expert", "expert", "IPAC"]


def test_content_key_keeps_bytes(spark):
    import hashlib

    df = spark.createDataFrame([("q ", " c")], "q string, c string")
    key = df.select(tx.content_key("q", "c")).first()[0]
    assert key == hashlib.sha256("q \x1e c".encode()).hexdigest()


def test_templates(spark):
    df = spark.createDataFrame([("why?", "because")], "q string, c string")
    got = df.select(
        tx.query_with_instruction("q").alias("a"), tx.query_with_instruction("q", "Do it").alias("b"),
        tx.rerank_text("q", "c").alias("c"), tx.annotation_text("q", "c").alias("d"),
        tx.prompted_query("q", "org/BGE-m3").alias("e"), tx.prompted_query("q", "other").alias("f")).first()
    assert got.a == f"<Instruct>: {fv.DEFAULT_QUERY_INSTRUCTION}\n<Query>: why?"
    assert got.b == "<Instruct>: Do it\n<Query>: why?"
    assert got.c.endswith("<Query>: why?\n<Document>: because")
    assert got.d.startswith("Question: why?\nParagraph: because\nIs this paragraph helpful")
    assert got.e == fv.BGE_QUERY_PROMPT + "why?" and got.f == "why?"


def test_vectors(spark):
    from siftrank.functions import vectors as vec

    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])],
                               "a array<double>, b array<double>").coalesce(1)
    rows = df.select(vec.l2_normalize("a").alias("u"), vec.l2_normalize("a", 1.0).alias("e"),
                     vec.dot("a", "b").alias("d"), vec.dot_native("a", "b").alias("n")).collect()
    assert [round(x, 6) for x in rows[0].u] == [0.6, 0.8] and rows[1].u == [0.0, 0.0]
    assert [round(x, 6) for x in rows[0].e] == [0.5, 0.666667]
    assert [r.d for r in rows] == [3.0, 0.0, None] == [r.n for r in rows]
    p = df.select(vec.prob_yes(F.lit(0.0), F.lit(math.log(3.0))), vec.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0)))).first()
    assert p[0] == pytest.approx(0.75) and p[1] == pytest.approx(1000 + math.log(2))


def test_dot_rejects_ragged_vectors(spark):
    from siftrank.functions import vectors as vec

    df = spark.createDataFrame([([1.0, 2.0], [1.0]), ], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in length"):
        df.select(vec.dot("a", "b")).collect()


def test_case_folding_of_all_code_points(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i:i + 500]) for i in range(0, len(points), 500)] + ["Straße ſ İ ﬁ ΣΊΣΥΦΟΣ ς", "PLAIN", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.f for r in df.select("i", tx.fold_case("t").alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else t.casefold()), i
