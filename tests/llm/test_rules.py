"""Quality rules and filter audit against plain versions."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from siftrank.llm import audit, quality_rules, tables
from siftrank.llm.queries import REGISTRY
from tests.llm.helpers import EDGE_SCHEMA, edge_rows, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain_counts(text):
    text = text or ""
    w = words(text)
    seen, repeated = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i:i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
            len(w) < 50 or 100 * len(repeated) > 50 * len(w))


EXTRA = ["a a a a", "x y z x y z", "x y x y x", "a\na\n\n \n\na", "# b #\n# b #", "é ü é ü é ü é", "\x0bq\x0cq\rq", "one two one two"]


def rule_rows():
    return [(r[0], r[1]) for r in edge_rows()] + [(100 + i, t) for i, t in enumerate(EXTRA)] + [(200, "w " * 49), (201, " ".join(f"w{i}" for i in range(50)))]


def test_counts_of_edges(spark):
    rows = rule_rows()
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, trusted string, n_words long").repartition(3)
    out = quality_rules.quality_rules(docs, spark.createDataFrame([(7,), (7,), (None,)], "doc_id long"))
    got = Counter(tuple(r) for r in out.select("doc_id", *COUNTS).collect())
    assert got == Counter((i, *plain_counts(t)) for i, t in rows)
    assert all(not r.kept for r in out.where("base_failed").collect())


def test_no_rows_and_no_trusted(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert quality_rules.quality_rules(spark.createDataFrame([], EDGE_SCHEMA), none).count() == 0
    docs = spark.createDataFrame(rule_rows(), "doc_id long, text string")
    out = quality_rules.quality_rules(docs, none)
    assert out.where("kept = base_failed or score is not null or threshold is not null").count() == 0


def test_query_counts_and_verdicts(spark):
    """Counts of every row as in the plain version; texts labelled good and not failed by rule stay, those labelled bad go."""
    folder = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in REGISTRY["op11_quality_rules"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        assert tuple(out[d.doc_id][c] for c in COUNTS) == plain_counts(d.text)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(labels[i], r.kept) for i, r in out.items() if i in labels and not r.base_failed]
    assert sum(kept for q, kept in judged if q == 1) >= 0.99 * sum(q == 1 for q, _ in judged)
    assert sum(kept for q, kept in judged if q == 0) <= 0.1 * sum(q == 0 for q, _ in judged)


def test_scores_are_the_mean_log_ratio(spark):
    rows = [(1, "good words here are good"), (2, "bad bad junk"), (3, "good junk words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    model = quality_rules.fit(docs, trusted, 64).first()
    hashed = quality_rules._hashed(docs.withColumn("_words", quality_rules.words_of(F.col("text"))))
    grams = {r.doc_id: r.g for r in hashed.select("doc_id", quality_rules.grams(F.col("_hashes"), 64).alias("g")).collect()}
    raw, good = Counter(sum(grams.values(), [])), Counter(grams[1])
    n_raw, n_good = sum(raw.values()), sum(good.values())
    assert n_raw == sum(2 * len(words(t)) - 1 for _, t in rows)
    import math
    for bucket, weight in enumerate(model.weights):
        want = math.log((good[bucket] + 1) / (n_good + 64)) - math.log((raw[bucket] + 1) / (n_raw + 64))
        assert abs(weight - want * 1e6) <= 1
    for r in quality_rules.quality_rules(docs, trusted, 64).collect():
        assert abs(r.score - sum(model.weights[g] for g in grams[r.doc_id]) / len(grams[r.doc_id]) / 1e6) < 2e-6


def test_flags_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(r[0], r[1]) for r in edge_rows()], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (1,), (9,), (None,)], "doc_id long")
    want = Counter((r[0], r[1], r[0] in (1, 9)) for r in edge_rows())
    for few in (tables.broadcast_if_small, lambda df, row_bytes: df):
        monkeypatch.setattr(tables, "broadcast_if_small", few)
        assert Counter(map(tuple, tables.with_flag(docs, ids, "hit").collect())) == want


def plain_audit(docs, labels):
    """docs are (doc_id, text, source), labels (doc_id, quality, toxic)."""
    def failures(i, text):
        w = words(text)
        found = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)}
        return {k for k, v in found.items() if v}

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(i, s or "", failures(i, t or "")) for i, t, s in docs]
    out = []
    for part in {p for _, p, _ in rows}:
        mine = [(i, f) for i, p, f in rows if p == part]
        shapley, kept_rows = Counter(), []
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[:step - 1])
                fails = [(i, f) for i, f in mine if x in f]
                removed = [i for i, f in fails if not f & before]
                shapley[x] += len(removed)
                kept_rows.append((part, "".join(order), step, sum(not f & (before | {x}) for _, f in mine), len(removed), len(fails) - len(removed),
                                  sum(f == {x} for _, f in mine), sum(i in good for i in removed), sum(i in toxic for i in removed)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in kept_rows]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows(out):
    return sorted(tuple(r) for r in out.select(AUDIT).collect())


@pytest.mark.parametrize("pieces,few", [(1000, True), (3, False), (1, True)])
def test_audit(spark, monkeypatch, pieces, few):
    """Edges, a group of copies that holds a third of all rows, groups dealt out in pieces or not, no broadcast."""
    docs = [(r[0], r[1], r[3]) for r in edge_rows()]
    docs += [(50 + i, "SAME text # again", "a" if i % 3 else "b") for i in range(12)] + [(None, "SAME text # again", "a"), (3, "SAME text # again", None)]
    docs += [(90, " ".join(f"w{i}" for i in range(60)), "a"), (91, " ".join(f"w{i}" for i in range(60)), "a")]
    labels = [(1, 1, 0), (1, 0, 1), (51, 1, 1), (52, 1, 0), (None, 1, 1), (90, 1, 0), (91, 1, 0), (999, 1, 1), (3, None, None)]
    monkeypatch.setattr(audit, "PIECES", pieces)
    if not few:
        monkeypatch.setattr(audit, "broadcast_if_small", lambda df, row_bytes: df)
    frame = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, source string, mask long, part string").repartition(4)
    out = audit.filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert audit_rows(out) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(spark.createDataFrame([], EDGE_SCHEMA), labels).count() == 0
