"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and which pairs go together.

Both tokenizers cut the same bytes (a space and the text). Where a token of each ends at the same byte, the sequences can be cut: an
interval of tokens is divided at the common end nearest to its middle, looked for by bisecting the other side's ends from the
middle to the right and then to the left, and both halves are divided likewise. Intervals without a common end inside are the groups. All intervals
of a batch are divided at once, level by level, with NumPy.

A link is a pair of occurrences whose byte ranges overlap. Links of a pair of ids are counted over all texts; each document is then told how
often its links are the best of their B id. Counts are sums made before the shuffle. They go back to the documents by a broadcast only if they are few;
otherwise the pairs that hold more than 1 / HOT of all links, of which there are fewer than HOT, are broadcast and the rest is shuffled.

NULL and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens: zeros and an empty string. Rows with one id, and equal
rows, count each. Texts of any length are taken in pieces that begin at a space after another character, where neither tokenizer joins. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.tables import small_batches
from siftrank.llm.words import slices
from siftrank.session import broadcast_if_small, cut_lineage

FOLDER = "/opt/tokenizers"
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
SLICE_BYTES = 1 << 18
#: Tokens, and their words, that a task keeps to encode a word once.
KEPT_TOKENS = 1 << 21
HOT = 1000
_PLACE = re.compile(r"(?<=\S) (?=\S)")


@dataclass
class Vocabulary:
    """Bytes of each id, their lengths, and how to encode: texts that begin with a space to lists of ids."""

    token: pa.Array
    size: np.ndarray
    encode: object


def _vocabulary(tokens: Sequence[bytes], encode) -> Vocabulary:
    return Vocabulary(pa.array(tokens, pa.binary()), np.array([len(t) for t in tokens], dtype=np.int64), encode)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def byte_level(path: str) -> Vocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letter = _byte_letters()
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    tokens = [bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t in names]
    return _vocabulary(tokens, lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)])


@lru_cache(maxsize=4)
def pieces(path: str) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    raw = re.compile(r"<0x([0-9A-F]{2})>")
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    codes = [raw.fullmatch(t) if processor.is_byte(i) else None for i, t in enumerate(names)]
    tokens = [bytes([int(m[1], 16)]) if m else t.replace("▁", " ").encode() for t, m in zip(names, codes)]
    return _vocabulary(tokens, lambda texts: processor.encode([t[1:] for t in texts], num_threads=1))  # it adds the space


def load(folder: str) -> tuple[Vocabulary, Vocabulary]:
    return byte_level(f"{folder}/{FILES[0]}"), pieces(f"{folder}/{FILES[1]}")


def _nearest(ea: np.ndarray, eb: np.ndarray, la, ha, lb) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the places, in A and B, of a common end near its middle; -1 where it has none inside."""
    at_a, at_b = np.full(len(la), -1), np.full(len(la), -1)
    middle = (la + ha) // 2 - 1

    def found(which, i, j):
        at_a[which], at_b[which] = i, j

    live, i = np.arange(len(la)), middle
    while len(live):  # to the right: the next end of B, the next end of A after it, and so on
        j = np.searchsorted(eb, ea[i])
        hit = eb[j] == ea[i]
        found(live[hit], i[hit], j[hit])
        live, j = live[~hit], j[~hit]
        i = np.searchsorted(ea, eb[j])
        inside = i < ha[live] - 1
        live, i = live[inside], i[inside]
    live = np.flatnonzero(at_a < 0)
    i = middle[live]
    while len(live):  # to the left
        j = np.searchsorted(eb, ea[i], "right") - 1  # the last end of B until here
        inside = j >= lb[live]
        live, j = live[inside], j[inside]
        i = np.searchsorted(ea, eb[j])
        hit = ea[i] == eb[j]
        found(live[hit], i[hit], j[hit])
        live, i = live[~hit], i[~hit] - 1
        inside = i >= la[live]
        live, i = live[inside], i[inside]
    return at_a, at_b


def divide(ea: np.ndarray, eb: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups, as numbers of tokens before them in A and B, ascending. ``ea`` and ``eb`` are the ascending ends of the
    tokens in bytes, ``first_a`` and ``first_b`` where each text's tokens begin (and the last one's end); a text's last ends are equal."""
    la, ha, lb, hb = first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]
    some = ha > la
    cuts_a, cuts_b = [ha[some]], [hb[some]]
    while True:
        wide = (ha - la > 1) & (hb - lb > 1)  # one token on a side: nothing to divide
        la, ha, lb, hb = la[wide], ha[wide], lb[wide], hb[wide]
        if not len(la):
            break
        at_a, at_b = _nearest(ea, eb, la, ha, lb)
        cut = at_a >= 0
        la, ha, lb, hb, ca, cb = la[cut], ha[cut], lb[cut], hb[cut], at_a[cut] + 1, at_b[cut] + 1
        cuts_a.append(ca)
        cuts_b.append(cb)
        la, ha, lb, hb = (np.concatenate(x) for x in ((la, ca), (ca, ha), (lb, cb), (cb, hb)))
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


class _Encoder:
    """Ids of words by several vocabularies. Words met before are looked up; the table begins anew when it is full."""

    def __init__(self, vocabularies: Sequence[Vocabulary]) -> None:
        self.vocabularies = vocabularies
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        none = np.zeros(0, dtype=np.int64)
        self.ids, self.size = [none for _ in self.vocabularies], [none for _ in self.vocabularies]

    def encode(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vocabulary the ids of all words, one after the other, and how many each word has."""
        if max(map(len, self.ids)) > KEPT_TOKENS:
            self._clear()
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            for v, vocabulary in enumerate(self.vocabularies):
                found = vocabulary.encode([" " + w for w in new])
                sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
                flat = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(sizes.sum()))
                self.ids[v], self.size[v] = np.concatenate((self.ids[v], flat)), np.concatenate((self.size[v], sizes))
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        out = []
        for ids, size in zip(self.ids, self.size):
            sizes, first = size[at], (np.cumsum(size) - size)[at]
            place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)
            out.append((ids[place], sizes))
        return out


def _first(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def _joined(values: pa.Array, index: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One value per text: those at ``index``, one after the other."""
    lists = pa.LargeListArray.from_arrays(pa.array(_first(counts)), values.take(pa.array(index)))
    return pc.binary_join(lists, pa.scalar("" if values.type in (pa.string(), pa.large_string()) else b"", values.type))


class Aligner:
    """Alignment of batches of texts. Make one per task."""

    def __init__(self, folder: str) -> None:
        self.a, self.b = load(folder)
        self.encoder = _Encoder((self.a, self.b))
        # Ids as they stand in the description of groups, with what follows: , or | after A, nothing, comma or ; after B.
        names = [f"{i}{x}" for i in range(len(self.a.size)) for x in (",", "|")]
        names += [f"{i}{x}" for i in range(len(self.b.size)) for x in ("", ",", ";")]
        self.names, self.names_b = pa.array(names, pa.large_string()), 2 * len(self.a.size)

    def align(self, texts: Sequence[str | None]):
        """For each text: tokens of A and B, groups, links (counts), the groups' description, and the links' pairs of ids with the number
        of times, pairs of all texts one after the other, with where each text's begin."""
        n = len(texts)
        filled = [t or "" for t in texts]
        cut = [_PLACE.split(t) if t else [] for t in filled]  # a space goes before each
        doc = np.repeat(np.arange(n), [len(c) for c in cut])
        whole = pa.array([(" " + t).encode() if t else b"" for t in filled], pa.binary())
        sides, same = [], np.ones(n, dtype=bool)
        for vocabulary, (ids, sizes) in zip((self.a, self.b), self.encoder.encode(list(chain.from_iterable(cut)))):
            counts = np.bincount(doc, weights=sizes, minlength=n).astype(np.int64)
            back = _joined(vocabulary.token, ids, counts)
            same &= pc.equal(back.cast(pa.binary()), whole).to_numpy(zero_copy_only=False)
            sides.append((ids, counts))
        if not same.all():
            sides = [(ids[np.repeat(same, counts)], np.where(same, counts, 0)) for ids, counts in sides]
        (ia, na), (ib, nb) = sides
        first_a, first_b = _first(na), _first(nb)
        ea, eb = np.cumsum(self.a.size[ia]), np.cumsum(self.b.size[ib])
        ga, gb = divide(ea, eb, first_a, first_b)
        n_groups = np.searchsorted(ga, first_a[1:], "right") - np.searchsorted(ga, first_a[:-1], "right")
        groups = self._described(ia, ib, ga, gb, first_b, na + nb)
        # Each token of A overlaps those of B from the one that ends after its begin to the one that ends at or after its end.
        low = np.searchsorted(eb, ea - self.a.size[ia], "right")
        times = np.searchsorted(eb, ea) - low + 1
        begin = _first(times)
        token_b = np.arange(begin[-1]) - np.repeat(begin[:-1] - low, times)
        code = np.repeat(ia, times) * len(self.b.size) + ib[token_b]
        n_links = begin[first_a[1:]] - begin[first_a[:-1]]
        code, times, first = _distinct(code, np.repeat(np.arange(n), n_links), n)
        return na, nb, n_groups, n_links, groups, code, times, first

    def _described(self, ia, ib, ga, gb, first_b, counts) -> pa.Array:
        """a1,a2|b1;a3|b2,b3 for each text."""
        index = np.empty(len(ia) + len(ib), dtype=np.int64)
        last_a, last_b = np.zeros(len(ia), dtype=np.int64), np.ones(len(ib), dtype=np.int64)
        last_a[ga - 1] = 1
        last_b[gb - 1] = 2
        last_b[first_b[1:][np.diff(first_b) > 0] - 1] = 0
        size_a, size_b = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
        index[np.arange(len(ia)) + np.repeat(gb - size_b, size_a)] = ia * 2 + last_a
        index[np.arange(len(ib)) + np.repeat(ga, size_b)] = self.names_b + ib * 3 + last_b
        return _joined(self.names, index, counts)


def _distinct(code: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of each document, how often each, and where a document's begin."""
    order = np.sort(doc << np.int64(44) | code)
    new = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1]))) if len(order) else np.zeros(0, dtype=np.int64)
    kept = order[new]
    first = np.searchsorted(kept, np.arange(n + 1, dtype=np.int64) << np.int64(44))
    return kept & np.int64((1 << 44) - 1), np.diff(np.append(new, len(order))), first


PAIRS = pa.struct([("code", pa.int64()), ("times", pa.int64())])


def align(documents: DataFrame, key: str = "doc_id", folder: str = FOLDER, digest: bool = False) -> DataFrame:
    """One row per row of ``documents`` (``key``, ``text``): ``row_id``, ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (the description, or its
    SHA-256 if ``digest``; empty without tokens) and ``pairs``, the distinct pairs of linked ids (A id * size of B + B id) with their number of links."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).alias("key"), "text")
    kept = [f for f in rows.schema.fields if f.name != "text"]
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in counts], T.StructField("groups", T.StringType()),
                           T.StructField("pairs", T.ArrayType(T.StructType([T.StructField("code", T.LongType()), T.StructField("times", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(folder)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for part in slices(texts, SLICE_BYTES):
                held = batch.slice(part.start, part.stop - part.start)
                *numbers, groups, code, times, first = aligner.align([t if t is None else t.decode() for t in texts[part]])
                if digest:
                    groups = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups.to_pylist()])
                pairs = pa.StructArray.from_arrays([pa.array(code), pa.array(times)], fields=list(PAIRS))
                yield pa.RecordBatch.from_arrays(
                    [held.column(f.name) for f in kept] + [pa.array(x, pa.int64()) for x in numbers]
                    + [groups.cast(pa.string()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pairs)], names=schema.names)

    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """Columns ``code``, ``n`` (links of the pair over all texts) and ``best`` (no pair with that B id has more)."""
    pairs = aligned.select(F.explode("pairs").alias("p")).groupBy(F.col("p.code").alias("code")).agg(F.sum("p.times").alias("n"))
    pairs = cut_lineage(pairs.withColumn("b", F.col("code") % size_b))
    most = F.broadcast(pairs.groupBy("b").agg(F.max("n").alias("most")))  # at most size_b rows
    return pairs.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """``aligned`` without pairs, and ``n_best`` and ``count_sum``."""
    each = aligned.select("row_id", F.explode("pairs").alias("p")).select("row_id", "p.code", "p.times")
    pairs = cut_lineage(pairs)
    few = broadcast_if_small(pairs, 24)
    if few is not pairs:
        found = each.join(few, "code")
    else:
        total = F.lit(pairs.agg(F.sum("n")).first()[0])
        hot = F.broadcast(pairs.where(F.col("n") * HOT > total))  # fewer than HOT rows
        found = each.join(hot, "code").unionByName(each.join(hot, "code", "left_anti").join(
            pairs.where(F.col("n") * HOT <= total), "code").select("code", "row_id", "times", "n", "best"))
    sums = found.groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"),
                                       F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)

    return aligned.drop("pairs").join(sums, "row_id", "left").select(
        "key", "n_a", "n_b", "n_groups", "n_links", number("n_best"), number("count_sum"), "groups")


def cross_align(documents: DataFrame, key: str = "doc_id", folder: str = FOLDER, digest: bool = False) -> DataFrame:
    """Alignment and link scores of each row. Texts are encoded once; what they gave is written, without texts."""
    aligned = cut_lineage(align(documents, key, folder, digest))
    size_b = len(pieces(f"{folder}/{FILES[1]}").size)
    return link_scores(aligned, pair_counts(aligned, size_b))
