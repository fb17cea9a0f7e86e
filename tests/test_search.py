import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.operators import index, pruned, search
from siftrank.operators.search import SearchBudget, _BestPerQuery


def vectors(spark, matrix, key, parts=3):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>").repartition(parts, key)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    docs = rng.normal(size=(120, 8)).astype("float32")
    docs[40:90] = docs[40]  # a group of copies that holds over a third of the documents
    return rng.normal(size=(17, 8)).astype("float32"), docs


def brute_force(queries, docs, k, digits=6):
    scores = np.round(queries.astype("f8") @ docs.astype("f8").T, digits) + 0.0
    out = set()
    for q in range(len(queries)):
        order = sorted(range(len(docs)), key=lambda d: (-scores[q, d], d))[:k]
        out |= {(q, d, scores[q, d], r) for r, d in enumerate(order, 1)}
    return out


BLOCKS = SearchBudget(query_bytes=256, block_scores=64, document_bytes=600)
TINY = SearchBudget(block_scores=16)
TWO_STEP = SearchBudget(split_bytes=1, partials_per_query=1)


@pytest.mark.parametrize("budget", [SearchBudget(), BLOCKS, TINY, TWO_STEP])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_top_k_is_exact(spark, data, budget, k):
    queries, docs = data
    got = search.top_k(vectors(spark, queries, "qid"), vectors(spark, docs, "did"), k, digits=6, budget=budget)
    assert {tuple(r) for r in got.collect()} == brute_force(queries, docs, k)


def test_best_per_query_cuts_back_to_k(data):
    queries, docs = data
    scores = queries.astype("f8") @ docs.astype("f8").T
    best = _BestPerQuery(5, len(queries))
    for start in range(0, len(docs), 11):
        block = scores[:, start:start + 11]
        best.limit = 0
        best.add(0, block, np.arange(start, start + block.shape[1]))
        assert best.held <= 5 * len(queries)
    q, d, s = best.cut()
    expect = brute_force(queries, docs, 5, digits=15)
    assert {(a, b) for a, b in zip(q, d)} == {(a, b) for a, b, _, _ in expect}


@pytest.mark.parametrize("budget", [SearchBudget(), BLOCKS])
def test_score_all_carries_columns(spark, data, budget):
    queries, docs = data
    q = vectors(spark, queries, "qid").withColumn("name", F.concat(F.lit("q"), "qid"))
    d = vectors(spark, docs, "did").withColumn("tag", F.concat(F.lit("d"), "did"))
    rows = search.score_all(q, d, digits=6, query_columns=["name"], doc_columns=["tag"], budget=budget).collect()
    assert len(rows) == len(queries) * len(docs)
    scores = np.round(queries.astype("f8") @ docs.astype("f8").T, 6)
    for r in rows:
        assert r.score == pytest.approx(scores[r.qid, r.did]) and (r.name, r.tag) == (f"q{r.qid}", f"d{r.did}")


@pytest.mark.parametrize("dense_rows", [1 << 20, 30, 3])
def test_rank_all_matches_window(spark, data, dense_rows):
    """Ties of a third of all documents, bands cut further or not."""
    queries, docs = data
    run = search.score_all(vectors(spark, queries, "qid"), vectors(spark, docs, "did"), digits=2)
    ranked = search.rank_all(run, dense_rows=dense_rows)
    got = {(r.qid, r.did, r.rank_full) for r in ranked.collect()}
    assert got == {(q, d, r) for q, d, _, r in brute_force(queries, docs, len(docs), digits=2)}
    assert "rangepartitioning" not in ranked._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dense_rows", [1 << 20, 2])
def test_rank_all_of_odd_scores(spark, dense_rows):
    scores = [None, float("nan"), float("inf"), -float("inf"), 1.0, 1.0, -1e300, 1e300, 0.0, None, float("nan")]
    run = spark.createDataFrame([(q, d, s) for q in (1, 2) for d, s in enumerate(scores)], "qid long, did long, score double").repartition(3)
    got = {(r.qid, r.did): r.rank_full for r in search.rank_all(run, dense_rows=dense_rows).collect()}
    order = [0, 9, 2, 7, 4, 5, 8, 6, 3, 1, 10]  # NULL, then descending, then NaN; ties by document
    assert got == {(q, d): r for q in (1, 2) for r, d in enumerate(order, 1)}


def test_query_blocks_stay_out_of_the_driver(spark, data, monkeypatch):
    """Many small files of queries: nothing but names and counts is collected, and a file holds a block."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from siftrank.operators import blocks

    queries, docs = data
    collect = Classic.collect

    def counts(self):
        rows = collect(self)
        assert len(rows) <= 1, "rows at the driver"
        return rows

    def refuse(self, *args):
        raise AssertionError("rows at the driver")

    q, d = vectors(spark, queries, "qid"), vectors(spark, docs, "did")
    monkeypatch.setattr(Classic, "collect", counts)
    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(Classic, name, refuse)
    plan = search.top_k(q, d, 3, digits=6, budget=BLOCKS)
    files, n = blocks.block_files(q, "embedding", 256)
    monkeypatch.undo()
    assert n == len(queries) and len(files) >= 5
    assert all(blocks.read_block(f).num_rows <= 256 // 72 for f in files)
    assert sum(blocks.read_block(f).num_rows for f in files) == n
    assert {tuple(r) for r in plan.collect()} == brute_force(queries, docs, 3)


def test_score_candidates(spark, data):
    queries, docs = data
    pairs = spark.createDataFrame([(0, 1), (3, 40), (16, 119)], "qid bigint, did bigint")
    rows = search.score_candidates(pairs, vectors(spark, queries, "qid"), vectors(spark, docs, "did")).collect()
    assert {(r.qid, r.did): pytest.approx(float(queries[r.qid].astype("f8") @ docs[r.did].astype("f8"))) for r in rows} \
        == {(r.qid, r.did): r.score for r in rows} and len(rows) == 3


def test_context_edges(spark):
    chunks = spark.createDataFrame([("f", p, f"t{p} ") for p in range(3)] + [("g", 0, "only")],
                                   "file_name string, pos int, text string")
    hits = spark.createDataFrame([(1, "f", 0), (2, "f", 1), (3, "f", 2), (4, "g", 0)],
                                 "rank int, file_name string, pos int")
    got = {r.rank: r.context for r in search.with_context(hits, chunks, 1).collect()}
    assert got == {1: "t0 t1 ", 2: "t0 t1 t2 ", 3: "t1 t2 ", 4: "only"}


@pytest.mark.parametrize("n", [0, 4, 1000])
def test_sample_outside_top(spark, data, n):
    queries, docs = data
    q = vectors(spark, queries, "qid")
    d = index.positions(vectors(spark, docs, "did"), ["did"], "d_ord")
    hits = search.top_k(q, d, 5, did="d_ord")
    once = search.sample_outside_top(q, d, hits, 5, n, seed=3).collect()
    again = search.sample_outside_top(q, d, hits, 5, n, seed=3).collect()
    assert sorted(once) == sorted(again)
    top = {(r.qid, r.d_ord) for r in hits.collect()}
    seen = [(r.qid, r.d_ord) for r in once]
    assert len(seen) == len(set(seen)) == len(queries) * min(n, len(docs) - 5)
    assert not top & set(seen)


def test_top_k_plan_trims_before_the_shuffle(spark, data):
    queries, docs = data
    df = search.top_k(vectors(spark, queries, "qid"), vectors(spark, docs, "did"), 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_vectors_that_are_not_finite_are_never_hits(spark):
    """More NaN scores in one task than k, infinite ones and NULL elements: the clean documents win all the same."""
    clean = [(i, [float(i), 1.0]) for i in range(100)]
    bad = [(1000 + i, [float("nan"), 1.0]) for i in range(40)] + [(2000 + i, [float("inf"), 1.0]) for i in range(9)] + [
        (3000, [None, 1.0]), (3001, None), (3002, [0.0, 0.0])]
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid long, embedding array<double>")
    docs = spark.createDataFrame(bad + clean, "did long, embedding array<double>").coalesce(1)
    hits = {(r.qid, r["rank"]): r.did for r in search.top_k(queries, docs, 5).collect()}
    assert [hits[1, r] for r in range(1, 6)] == [99, 98, 97, 96, 95]
    assert [hits[2, r] for r in range(1, 6)] == [0, 1, 2, 3, 4]
    assert search.top_k(queries, docs.where("did >= 1000 and did < 3002"), 5).count() == 0


@pytest.mark.parametrize("budget", [SearchBudget(), BLOCKS])
@pytest.mark.parametrize("k", [1, 7, 500])
@pytest.mark.parametrize("parts", [1, 6])
def test_pruned_top_k_is_exact(spark, data, budget, k, parts):
    queries, docs = data
    store = pruned.build_store(vectors(spark, docs, "did"), parts=parts, sample_rows=50)
    found = pruned.top_k_pruned(vectors(spark, queries, "qid"), store, k, digits=6, budget=budget)
    assert {tuple(r) for r in found.hits.collect()} == brute_force(queries, docs, k)
    assert store.vectors.count() == len(docs) and sum(r.n for r in store.parts.collect()) == len(docs)


def test_pruned_search_skips_most_of_a_clustered_corpus(spark):
    """Forty clusters, one with a third of all documents: more than half of the pairs of query and part are skipped."""
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(40, 16)) * 4
    of = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 40, 3000))
    docs = (middle[of] + rng.normal(size=(3000, 16)) * 0.2).astype("float32")
    queries = (middle[rng.integers(0, 40, 30)] + rng.normal(size=(30, 16)) * 0.2).astype("float32")
    store = pruned.build_store(vectors(spark, docs, "did"), parts=40)
    found = pruned.top_k_pruned(vectors(spark, queries, "qid"), store, 10, digits=6)
    assert {tuple(r) for r in found.hits.collect()} == brute_force(queries, docs, 10)
    assert found.skipped_share() > 0.5


def test_pruned_search_of_unclean_vectors(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, None)], "qid long, embedding array<double>")
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("inf"), 0.0]), (3, [None, 1.0]), (4, None), (None, [1.0, 1.0]), (5, [3.0, 0.0])],
                                 "did long, embedding array<double>")
    found = pruned.top_k_pruned(queries, pruned.build_store(docs), 5)
    assert sorted(map(tuple, found.hits.collect())) == [(1, 1, 1.0, 2), (1, 5, 3.0, 1)]
    empty = pruned.top_k_pruned(queries, pruned.build_store(docs.where("false")), 5)
    assert empty.hits.count() == 0 and empty.skipped_share() == 0
    assert pruned.top_k_pruned(queries.where("false"), pruned.build_store(docs), 5).hits.count() == 0
