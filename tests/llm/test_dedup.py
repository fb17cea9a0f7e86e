"""Exact, near and substring dedup against plain versions."""

import json
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftrank.llm import substring_dedup as module
from siftrank.llm.components import components
from siftrank.llm.exact_dedup import CuckooIndex, exact_dedup
from siftrank.llm.near_dedup import near_dedup
from siftrank.llm.substring_dedup import substring_dedup
from tests.llm.helpers import EDGE_SCHEMA, cut_repeats, edge_rows, near_components, sha, shingles


def test_cuckoo_index_is_exact_through_growth_and_deletion():
    draw, live, index = random.Random(1), {}, CuckooIndex(buckets=4)
    for n in range(6000):
        digest = sha(str(draw.randrange(2500))).encode()[:32]
        if draw.random() < 0.35:
            assert index.delete(digest) == (live.pop(digest, None) is not None)
        elif digest not in live:
            index.insert(digest, n)
            live[digest] = n
        found = index.find(digest)
        assert (found and found[1]) == live.get(digest)
    assert {d: v for d, v in index.entries()} == live and index.size == len(live)
    assert index.mask + 1 > 4


def test_exact_dedup_of_edge_rows(spark):
    rows = edge_rows()
    got = exact_dedup(spark.createDataFrame(rows, EDGE_SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [x[0] for x in rows if (x[1] or "") == (r.row.text or "")]
        ids = [i for i in same if i is not None]
        keep = max(ids) if ids else None
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), r.row.doc_id == keep)
        assert r.text_sha256 == sha(r.row.text or "")


def test_exact_dedup_with_a_hot_text(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    kept = exact_dedup(docs).where("kept").selectExpr("row.doc_id", "group_size").collect()
    assert len(kept) == 2001 and {r.group_size for r in kept if r.doc_id == 2997} == {1000}


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: (0 if n < 100 else 100 if n < 200 else 200) for e in edges for n in e}


def _variants(seed):
    """Families of edited copies, some only linked through others, among unrelated texts."""
    draw, rows = random.Random(seed), []
    for family in range(25):
        text = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([3, 6, 12, 40, 150, 600]))]
        for _ in range(draw.choice([1, 1, 3, 8])):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(draw.choice([0, 1, 1, 2, max(1, len(text) // 30)])):
                text[draw.randrange(len(text))] = f"e{draw.randrange(10**6)}"
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_finds_every_link(spark, seed):
    rows = _variants(seed)
    expected = near_components(rows)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.key: r.component_id for r in got} == expected
    assert {r.key: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert all(r.kept == (r.key == r.component_id) for r in got)


def test_near_dedup_where_the_star_centre_is_far(spark):
    """One bucket, several components: links that no centre has are found in the second pass."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for block in range(6):
        text = list(base)
        for _ in range(14):
            text[draw.randrange(400)] = f"b{block}-{draw.randrange(10**6)}"
        for _ in range(3):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[draw.randrange(400)] = f"c{draw.randrange(10**6)}"
    got = {r.key: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_components(rows) and len(set(got.values())) > 1


def test_near_dedup_of_edge_rows(spark):
    rows = edge_rows()
    got = near_dedup(spark.createDataFrame(rows, EDGE_SCHEMA)).collect()
    assert len(got) == len(rows)
    by_key = Counter((r.key, r.component_id) for r in got)
    assert by_key[(1, 1)] == 2 and by_key[(5, 1)] == 1 and by_key[(9, 9)] == 1 and by_key[(10, 9)] == 1
    assert by_key[(None, None)] == 2 and by_key[(3, 3)] == 1 and by_key[(4, 4)] == 1
    assert all(r.kept for r in got if r.key is None or r.n_shingles == 0)


@pytest.mark.parametrize("suffixes, part_bytes", [(1_000_000, 64 << 20), (8, 64 << 20), (8, 100)])
def test_substring_dedup(spark, suffixes, part_bytes):
    """Shared passages, copies, repeats inside a text; with groups so small that prefixes must grow, and with many parts."""
    draw = random.Random(3)
    passages = [[f"p{i}-{j}" for j in range(draw.choice([12, 13, 14, 40]))] for i in range(5)] + [["again"] * 30]
    rows = []
    for i in range(60):
        text = [f"w{draw.randrange(300)}" for _ in range(draw.choice([0, 2, 12, 13, 30, 80]))]
        for _ in range(draw.choice([0, 1, 2])):
            at = draw.randrange(len(text) + 1)
            text[at:at] = draw.choice(passages)
        rows.append((draw.randrange(1000) * 2, " ".join(text)))
    rows += [(r[0] + 1, r[1]) for r in rows[:10]] + rows[:3] + [(None, rows[4][1]), (None, "x " * 40), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup(docs, group_suffixes=suffixes, part_bytes=part_bytes).collect()
    assert Counter((r.key, r.n_words, r.n_removed, r.kept_text) for r in got) == cut_repeats(rows)


def test_no_group_of_suffixes_exceeds_the_bound(spark, tmp_path, monkeypatch):
    """Many small blocks, in each of which every prefix is rare; one first word begins half of all suffixes."""
    draw, bound = random.Random(9), 600
    lines = [" ".join(["hot" if draw.random() < 0.5 else f"w{draw.randrange(60)}" for _ in range(30)]) for _ in range(300)]
    rows = [(i, f"{lines[i % 300]} {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(100, "doc_id")
    whole = module._subtrees

    def counted(window, parts):
        inner, folder = whole(window, parts), str(tmp_path)

        def run(batches):
            sizes = Counter()

            def seen():
                for batch in batches:
                    for r in batch.to_pylist():
                        if r["kind"] == 0:
                            sizes[r["grp"]] += len(r["pos"]) // 4
                    yield batch
            yield from inner(seen())
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                json.dump(list(sizes.values()), f)
        return run

    monkeypatch.setattr(module, "_subtrees", counted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # a batch is a block
    try:
        got = substring_dedup(docs, group_suffixes=bound).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter((r.key, r.n_words, r.n_removed, r.kept_text) for r in got) == cut_repeats(rows)
    sizes = [n for p in tmp_path.iterdir() for n in json.loads(p.read_text())]
    assert sum(sizes) > 8 * bound and max(sizes) <= bound


def test_substring_dedup_of_edge_rows(spark):
    rows = edge_rows()
    got = substring_dedup(spark.createDataFrame(rows, EDGE_SCHEMA)).collect()
    assert Counter((r.key, r.n_words, r.n_removed, r.kept_text) for r in got) == cut_repeats([r[:2] for r in rows])


def test_empty_tables(spark):
    none = spark.createDataFrame([], EDGE_SCHEMA)
    assert exact_dedup(none).count() == near_dedup(none).count() == substring_dedup(none).count() == 0


def test_one_stray_among_many_members(spark):
    """A bucket of 20,000 members of one component and one stray: rows compared stay near the number of members."""
    from siftrank.llm.near_dedup import BLOCK, leftover_cells

    nodes = spark.range(20_000).selectExpr("cast(cast(id as string) as binary) as node", "7L as bucket")
    lone = spark.createDataFrame([(bytearray(b"x"), 7), (bytearray(b"x"), 8), (bytearray(b"1"), 9), (bytearray(b"2"), 9)], "node binary, bucket long")
    labels = nodes.select("node", F.lit(bytearray(b"0")).alias("component"))
    cells = leftover_cells(nodes.unionByName(lone), labels)
    counts = {r.stray: r["count"] for r in cells.groupBy("stray").count().collect()}
    assert counts[False] == 20_001 and counts[True] <= 20_001 // BLOCK + 1
    assert {r.bucket for r in cells.select("bucket").distinct().collect()} == {7}
    assert cells.where("stray").select("j").distinct().count() == counts[True]


@pytest.mark.parametrize("words", [8, 14, 40, 400])
def test_links_that_no_centre_has(spark, monkeypatch, words):
    """Chains of texts of any size, each linked with the next only: as with all pairs, in blocks of two."""
    from siftrank.llm import near_dedup as module

    monkeypatch.setattr(module, "BLOCK", 2)
    rng, rows = random.Random(words), []
    for chain in range(6):
        text = [f"c{chain}w{i}" for i in range(words)]
        for step in range(8):
            rows.append((len(rows), " ".join(text)))
            for _ in range(max(1, words // 80)):
                text[-1 - step if words < 80 else rng.randrange(words)] = f"new{rng.random()}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.key: r.component_id for r in module.near_dedup(docs).collect()}
    assert got == near_components(rows)
