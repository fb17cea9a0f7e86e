"""The labelled product of all pairs."""

from collections import Counter

import numpy as np
import pytest

from siftrank.operators import scores, search
from tests.test_search import vectors


def above_product(df):
    """The plan's text above the step that makes the product."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan[:plan.index("MapInArrow")]


@pytest.mark.parametrize("budget", [search.BUDGET, search.SearchBudget(part_bytes=1 << 8, share_scores=20), search.SearchBudget(share_scores=20, ranked_documents=3)])
def test_score_labelled(spark, budget):
    """Keys that repeat on either side, labels that repeat, are NULL or of unknown keys; many parts and shares, or few."""
    rng = np.random.default_rng(5)
    q = [(i % 23, rng.integers(-2, 3, 3).astype(float).tolist(), f"q{i % 23}") for i in range(25)] + [(None, [1.0, 1.0, 1.0], "x"), (40, None, "y")]
    d = [(i % 61, rng.integers(-2, 3, 3).astype(float).tolist(), f"d{i % 61}") for i in range(63)]
    lab = [(i % 30, (7 * i) % 70, i if i % 3 else None) for i in range(400)] + [(None, 1, 5), (1, None, 5), (3, 21, 9)]
    queries = spark.createDataFrame(q, "qid long, embedding array<double>, name string").repartition(3)
    docs = spark.createDataFrame(d, "did int, embedding array<double>, tag string").repartition(4)
    labels = spark.createDataFrame(lab, "qid int, did long, Label int")
    made = search.score_labelled(queries, docs, labels, "Label", digits=6, query_columns=["name"], doc_columns=["tag"], budget=budget)
    got = Counter(tuple(r) for r in made.select("qid", "did", "score", "Label", "name", "tag").collect())
    want = Counter()
    for a, x, n in q:
        for b, y, t in d:
            if a is not None and x is not None:
                for label in [v for i, j, v in lab if (i, j) == (a, b)] or [None]:
                    want[(a, b, round(float(np.dot(x, y)), 6) + 0.0, label, n, t)] += 1
    assert got == want
    ranked = search.score_labelled(queries, docs, labels, "Label", digits=6, rank="place", budget=budget).collect()
    for a in range(23):
        mine = sorted((r for r in ranked if r.qid == a), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.score, r.did) for r in mine] == sorted(((r.score, r.did) for r in mine), key=lambda x: (-x[0], x[1]))
    assert Counter((r.qid, r.did, r.score, r.Label) for r in ranked) == Counter(
        x for row, n in want.items() for x in [row[:4]] * n)


def test_product_is_not_shuffled(spark):
    """Labels, ranks and texts reach all pairs without an exchange or a join by sorting of the product."""
    q = vectors(spark, [[1.0, 0.0], [0.0, 1.0]], "qid").selectExpr("*", "'q' as Question", "'t' as Question_type", "'f' as specific_to_paper")
    d = vectors(spark, [[1.0, 2.0], [3.0, 1.0]], "did").selectExpr("*", "'c' as chunk_text", "'expert' as Source")
    rows = spark.createDataFrame([(0, 0, 0, "1")], "row_no int, qid bigint, did bigint, Label string")
    judged = rows.selectExpr("qid", "did", "cast(Label as int) as first_label")
    for table in (scores.full_pair_scores(rows, q, d, "row_no"), scores.full_corpus_table(q, d, judged)):
        above = above_product(table)
        assert "SortMergeJoin" not in above and "Window" not in above, above
        assert table.count() == 4
