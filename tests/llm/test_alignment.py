"""Cross-tokenizer alignment against a plain version, whole query included."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftrank.llm import alignment
from siftrank.llm.queries import REGISTRY
from tests.llm.helpers import EDGE_SCHEMA, edge_rows

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_tokens(vocabulary, text):
    """(id, begin, end) of each token, or None if their bytes are not those of the space and the text."""
    tokens = vocabulary.token.to_pylist()
    ids = vocabulary.encode([" " + text])[0]
    if b"".join(tokens[i] for i in ids) != (" " + text).encode():
        return None
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(tokens[i])))
        at += len(tokens[i])
    return out


def plain(rows):
    a, b = alignment.load(alignment.FOLDER)
    found, count = [], Counter()
    for _, text in rows:
        ta, tb = (plain_tokens(v, text) for v in (a, b)) if text else (None, None)
        if not ta or not tb:
            found.append(None)
            continue
        ends = sorted({e for _, _, e in ta} & {e for _, _, e in tb})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if s >= begin and e <= end) for side in (ta, tb)))
            begin = end
        links = [(i, j) for i, s, e in ta for j, u, v in tb if s < v and u < e]
        count.update(links)
        found.append((ta, tb, groups, links))
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    out = []
    for (key, _), f in zip(rows, found):
        if f is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            ta, tb, groups, links = f
            out.append((key, len(ta), len(tb), len(groups), len(links), sum(count[x] == top[x[1]] for x in links),
                        sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


ODD = ["▁x", "a ▁ b", "<s></s><|endoftext|> <0x41>\x00\r\n", "ä" * 9, "日本語 のテスト " * 9, "\n\n  x\t y ", " lead", "don't DON'T 12345 !!??", "🙂🙃 é́ ﬁ"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_edges_and_odd_texts(spark):
    rows = [(r[0], r[1]) for r in edge_rows() if len(r[1] or "") < 3000] + list(enumerate(ODD))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n_a long").repartition(3)
    out = alignment.cross_align(docs, digest=True).withColumnsRenamed({"key": "doc_id", "groups": "groups_sha256"})
    assert rows_of(out) == plain(rows)


def test_empty_table(spark):
    assert alignment.cross_align(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0


def test_query_is_the_plain_result(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 4000)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(REGISTRY["op13_cross_alignment"](spark, str(tmp_path))) == plain(rows)


def test_shuffled_pairs_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, alignment.cross_align(docs, digest=True).collect()))
    monkeypatch.setattr(alignment, "broadcast_if_small", lambda df, row_bytes: df)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 5000)
    monkeypatch.setattr(alignment, "KEPT_TOKENS", 500)
    assert sorted(map(tuple, alignment.cross_align(docs, digest=True).collect())) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.booleans(), st.booleans(), st.integers(1, 4)), min_size=0, max_size=30), min_size=1, max_size=5))
def test_divide_finds_every_common_end(texts):
    """Each text is a list of steps; a step of some bytes ends a token of A, of B, of both or of none."""
    at, a, b, first_a, first_b = 0, [], [], [0], [0]
    for steps in texts:
        for in_a, in_b, size in steps:
            at += size
            a += [at] if in_a else []
            b += [at] if in_b else []
        if steps:
            at += 1
            a.append(at)
            b.append(at)
        first_a.append(len(a))
        first_b.append(len(b))
    ea, eb = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    ga, gb = alignment.divide(ea, eb, np.array(first_a), np.array(first_b))
    assert ea[ga - 1].tolist() == eb[gb - 1].tolist() == sorted(set(a) & set(b))


@pytest.mark.parametrize("text", ["plain words of no great length, 12 of them, it's said\n\n  and more", "é ü 日本 x  y\t z " * 9])
def test_words_are_encoded_alike(text):
    vocabularies = alignment.load(alignment.FOLDER)
    encoder = alignment._Encoder(vocabularies)
    cut = alignment._PLACE.split(text)
    assert " ".join(cut) == text and len(cut) > 5
    for _ in range(2):  # new words, then known ones
        for vocabulary, (ids, sizes) in zip(vocabularies, encoder.encode(cut)):
            assert ids.tolist() == vocabulary.encode([" " + text])[0] and len(sizes) == len(cut)
