import math
import random

import pytest
from pyspark.sql import functions as F

from siftrank.operators import curves, prefix, quality, rank_metrics as rm


def run_of(spark, rows):
    return spark.createDataFrame(rows, "qid string, did string, score double")


def qrels_of(spark, rows):
    return spark.createDataFrame(rows, "qid string, did string")


def one(df):
    return df.collect()[0].asDict()


def test_golden_ndcg_and_map(spark):
    run = run_of(spark, [("q", "a", 0.9), ("q", "b", 0.8), ("q", "c", 0.7)])
    got = one(rm.evaluate(run, qrels_of(spark, [("q", "a"), ("q", "c")]), ks=(1, 3)))
    assert got["ndcg@3"] == pytest.approx(1.5 / (1 + 1 / math.log2(3)))
    assert got["map@3"] == pytest.approx((1 + 2 / 3) / 2)
    assert got["map@1"] == pytest.approx(0.5)
    least = one(rm.evaluate(run, qrels_of(spark, [("q", "a"), ("q", "c")]), ks=(1,), map_divisor="least"))
    assert least["map@1"] == pytest.approx(1.0)


def test_queries_come_from_qrels(spark):
    run = run_of(spark, [("q", "a", 0.9), ("extra", "a", 0.9)])
    got = one(rm.evaluate(run, qrels_of(spark, [("q", "a"), ("unseen", "a")]), ks=(3,)))
    assert got["ndcg@3"] == pytest.approx(0.5)


def test_models_answer_every_query(spark):
    run = run_of(spark, [("q", "a", 0.9)]).withColumn("model", F.lit("m1"))
    got = {r.model: r["ndcg@3"] for r in rm.evaluate(
        run, qrels_of(spark, [("q", "a"), ("p", "a")]), ks=(3,), models=["m1", "m2"]).collect()}
    assert got == {"m1": 0.5, "m2": 0.0}


def test_perfect_order_is_one(spark):
    run = run_of(spark, [("q", str(i), float(-i)) for i in range(30)])
    got = one(rm.evaluate(run, qrels_of(spark, [("q", str(i)) for i in range(4)])))
    assert all(got[f"ndcg@{k}"] == pytest.approx(1.0) for k in (5, 10, 20))


def facet_rows(spark):
    rows = [(0, "base", " q ", "d1", "1", " Type-a", "0.9"), (1, "base", "q", "d2", "0", "type-A", "0.1"),
            (2, "base", "q", "d2", "0", "type-A", "0.95"), (3, "base", "p", "d1", "0", None, "0.5"),
            (4, "base", "p", "d3", "1", None, None), (5, "base", "r", "d1", "0", "empty", "0.5")]
    return spark.createDataFrame(
        rows, "row_no int, model string, Question string, chunk_text string, relevance_label string, Question_type string, cos string")


def test_facets_allowlist(spark):
    got = {r.Question_type: r["ndcg@3"] for r in rm.metrics_by_question_type(
        facet_rows(spark), "allowlist", "row_no", ks=(3,)).collect()}
    # last score wins, so d2 outranks d1; a missing score is unranked; a facet without positives is absent
    assert got == {"Type-A": pytest.approx(1 / math.log2(3)), "Nan": 0.0}


def test_facets_full_corpus_keep_missing_scores(spark):
    full = facet_rows(spark).selectExpr(
        "row_no", "model", "trim(Question) as qid", "chunk_text as did", "relevance_label", "Question_type",
        "cos as cos_full")
    got = {r.Question_type: r["ndcg@3"] for r in rm.metrics_by_question_type(full, "full", "row_no", ks=(3,)).collect()}
    assert got["Nan"] == pytest.approx(1 / math.log2(3))


def test_round_report(spark):
    df = spark.createDataFrame([("b", 0.123456), ("a", 1.0)], "f string, v double")
    assert [tuple(r) for r in rm.round_report(df, ["f"]).collect()] == [("a", 1.0), ("b", 0.1235)]


def scored(spark, rows, model="m"):
    return spark.createDataFrame([(model, y, s) for y, s in rows], "model string, label int, score double")


def test_golden_curves(spark):
    assert one(curves.roc_auc(scored(spark, [(1, .5), (0, .5)])))["roc_auc"] == 0.5
    ap = scored(spark, [(1, .9), (0, .8), (1, .7)])
    assert one(curves.average_precision(ap))["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    tie = scored(spark, [(1, .9), (0, .8), (0, .7), (1, .6)])
    best = one(curves.best_f1(tie, digits=9))
    assert best["threshold"] == .6 and best["best_f1"] == pytest.approx(2 / 3)
    points = {(r.threshold, r.precision, r.recall) for r in curves.pr_curve(ap).collect()}
    assert points == {(.9, 1.0, .5), (.8, .5, .5), (.7, 2 / 3, 1.0), (None, 1.0, 0.0)}


def test_auc_is_mann_whitney(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < .4), round(rng.gauss(0, 1), 1)) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    got = one(curves.roc_auc(scored(spark, rows)))["roc_auc"]
    assert got == pytest.approx(wins / len(pos) / len(neg))


def test_collinear_points(spark):
    # steps: (1,0) (1,0) (0,1) (0,1) (1,1)
    rows = [(1, .9), (1, .8), (0, .7), (0, .6), (1, .5), (0, .5)]
    kept = sorted(r.threshold for r in curves.roc_curve(scored(spark, rows), drop_collinear=True).collect() if r.threshold)
    assert kept == [.5, .6, .8]


@pytest.mark.parametrize("rows", [[(1, .5)], [(0, .5)], [(2, .5), (1, .1), (0, .2)]])
def test_mixed_label_guard_names_the_model(spark, rows):
    with pytest.raises(ValueError, match="tuned"):
        curves.require_mixed_labels(scored(spark, rows, "tuned"))


def test_prepare_scores(spark):
    df = spark.createDataFrame([("m", "q", "1", "0.5", None), ("m", "q", "x", "inf", None), ("m", None, "1", "1", None)],
                               "model string, Question string, Label string, cos_score string, other string")
    assert [tuple(r) for r in curves.prepare_scores(df).collect()] == [("m", 1, 0.5)]
    with pytest.raises(ValueError, match="score column"):
        curves.prepare_scores(df.drop("cos_score"))


def test_correlation_matches_pandas(spark):
    import pandas as pd

    rng = random.Random(1)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(200)]
    got = one(curves.similarity_label_correlation(scored(spark, rows)))
    frame = pd.DataFrame(rows, columns=["y", "s"])
    assert got["pearson"] == pytest.approx(frame.s.corr(frame.y))
    assert got["spearman"] == pytest.approx(frame.s.rank().corr(frame.y.rank()))


def test_running_totals_equal_a_window_for_any_partitioning(spark):
    rng = random.Random(2)
    # One group holds most rows.
    rows = [("hot" if rng.random() < .7 else [None, "g1", "g2"][i % 3], i, rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    expect, seen = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + v
        expect[g, o] = seen[g]
    for parts in (1, 3, 8):
        got = prefix.running_totals(df.repartition(parts), ["g"], ["o"], {"t": "v"}, {"n": "o"}).collect()
        assert {(r.g, r.o): r.t for r in got} == expect
        order = {}
        for g, o, _ in sorted(rows, key=lambda r: r[1]):
            order.setdefault(g, []).append(o)
        follow = {(g, a): b for g, os in order.items() for a, b in zip(os, os[1:] + [None])}
        assert {(r.g, r.o): r.n for r in got} == follow


def test_no_single_partition_window(spark):
    counts = curves.cumulative_counts(scored(spark, [(i % 2, i / 7) for i in range(100)]))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan


def test_run_quality(spark):
    run = run_of(spark, [("q", "a", 0.1), ("q", "a", 0.2), ("q", "b", float("nan")), ("p", "a", 0.3)])
    got = {r.qid: (r.num_scores, r.num_docs, r.repeated_docs, r.bad_scores) for r in quality.run_quality(run).collect()}
    assert got == {"q": (3, 2, 1, 1), "p": (1, 1, 0, 0)}
    with pytest.raises(ValueError, match="repeated"):
        quality.require_sound_run(run)
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        quality.require_columns(run, ["qid", "y", "x"])


def test_vector_checks(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, embedding array<double>")
    assert {r.id for r in quality.mismatched_vectors(df, 2).collect()} == {2, 3}


def test_model_deltas(spark):
    metric = spark.createDataFrame([("a", 0.2), ("b", 0.5), ("d", 0.9)], "model string, ap double")
    rows = curves.model_deltas(metric, "ap", {"a": "b", "c": "d", "b": "missing"}).collect()
    assert [(r.base, round(r.delta, 6)) for r in rows] == [("c", 0.9), ("a", 0.3), ("b", -0.5)]


def test_curves_of_two_batches(spark, tmp_path):
    """Curves from counts of two batches are those of all rows; a repeated batch counts once; merged batches say the same."""
    rows = [(m, (i * 7) % 11 / 10, int((i * 5) % 3 == 0)) for m in ("a", "b") for i in range(40)]
    scored = spark.createDataFrame(rows, "model string, score double, label int").repartition(3)
    counts = curves.CurveCounts(spark, str(tmp_path / "counts"))
    first, second = scored.where("score < 0.5"), scored.where("score >= 0.4 and label = 1 or score >= 0.5")
    both = first.unionByName(second)
    counts.add(second, "one")
    counts.add(first, "one")
    for _ in range(2):
        counts.add(second, "two")
    for state in (counts, counts.merge(str(tmp_path / "merged"))):
        for curve in (curves.pr_curve, curves.roc_curve, curves.average_precision, curves.roc_auc, curves.f1_by_threshold, curves.prevalence, curves.best_f1):
            want, got = ({tuple(r) for r in curve(x).collect()} for x in (both, state.counts()))
            assert {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got} == {
                tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in want}
    with pytest.raises(ValueError):
        counts.add(first, "no/path")
