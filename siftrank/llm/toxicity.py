"""Toxic passages by maximum-scoring segments over token log-odds.

A token's weight is the log-odds of its occurrence in texts labelled toxic against others, with a Dirichlet prior in
proportion to its frequency in both, lowered by ``SIGMAS`` standard errors and by a constant cost, so that the expected
weight is negative. A linear scan finds every maximal segment of positive sum. In clean text the sum follows
an extreme-value law: at least x is expected scale * tokens * exp(-rate * x) times. The rate is that at which the weights'
exponential moment over clean tokens is one, the scale comes from the segments of all texts labelled clean.
A text's evidence is that of its best r segments together, for the r that gives most: how unlikely it is
that so many of that sum come by chance. A logistic curve through the labelled texts turns evidence into a probability.
A text's passages are all its segments whose own expected number is below a level, whatever r is.

Tokens are lower-cased runs of ASCII letters and digits and all other non-ASCII bytes. Where a script sets no spaces each
character begins a token, of up to three characters that overlap with the next. A token has the largest weight of
itself as a whole and of its stems of 4, 5 and 7 characters (2 in unspaced scripts), as many languages build words from
stems. All are counted in 2**20 hash buckets, so the model has a fixed size however large the vocabulary is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm.tables import small_batches
from siftrank.llm.words import WordHasher, Words, slices, window_hashes
from siftrank.session import broadcast_if_small, cut_lineage

BUCKET_BITS = 20
STEMS = (4, 5, 7)
#: In unspaced scripts a token is so many characters, its stem one less.
GRAM = 3
#: Code points, first and last, of scripts without spaces between words, and of signs that stand side by side: Thai, Lao,
#: Tibetan; Myanmar; Khmer; Tai scripts; Balinese; arrows to dingbats; CJK, kana, bopomofo; Yi; Javanese, Myanmar
#: extended; compatibility and full-width forms; kana supplements; emoji; further CJK.
UNSPACED = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x1AAF), (0x1B00, 0x1B7F), (0x2190, 0x2BFF),
            (0x2E80, 0x312F), (0x31A0, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F),
            (0xFF00, 0xFFEF), (0x1B000, 0x1B16F), (0x1F000, 0x1FAFF), (0x20000, 0x3FFFF))
_EDGES = np.array([edge for first, last in UNSPACED for edge in (first, last + 1)])
PRIOR = 5_000.0
SIGMAS = 3.0
COST = 0.5
BIN = 0.25
#: Smallest hashes by which copies are known, and how many of them copies share at least (three in four).
SKETCHES, ALIKE = 8, 6
#: The weight of one text in whole units.
UNIT = 1 << 20
BINS = 400
#: A scale is read off only where so many clean segments are left.
TAIL = 20
#: A passage is a segment of which a clean text of the same length has fewer than this on average.
LEVEL = 0.01


class TokenHasher(WordHasher):
    """Tokens of texts, and their features: stems and whole tokens."""

    def __init__(self) -> None:
        apart = np.ones(256, dtype=bool)
        apart[48:58] = apart[65:91] = apart[97:123] = apart[128:] = False
        super().__init__(True, apart)

    def _parts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs, those of unspaced scripts parted into overlapping sequences of characters, one at each character."""
        if data.max(initial=0) < 0xE0:
            return start, end
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        high = np.flatnonzero(data[lead] >= 0xE0)
        b = [data[np.minimum(lead[high] + i, len(data) - 1)].astype(np.int64) for i in range(4)]
        point = ((b[0] & 15) << 12) | ((b[1] & 63) << 6) | (b[2] & 63)
        point = np.where(b[0] < 0xF0, point, ((b[0] & 7) << 18) | ((b[1] & 63) << 12) | ((b[2] & 63) << 6) | (b[3] & 63))
        high = high[np.searchsorted(_EDGES, point, "right") % 2 == 1]
        if not len(high):
            return start, end
        unspaced, cut = np.zeros(len(data), bool), np.zeros(len(data) + 1, bool)
        unspaced[lead[high]] = True
        cut[start] = cut[lead[high]] = cut[np.append(lead, len(data))[high + 1]] = True
        begin = np.flatnonzero(cut[:-1] & ~self.apart[data])
        run = np.searchsorted(start, begin, "right") - 1
        stop = np.minimum(np.append(begin[1:], len(data)), end[run])
        own = unspaced[begin]
        joined = own[:-1] & own[1:] & (run[:-1] == run[1:])  # an unspaced character and one more in the same run
        reach, whole = stop.copy(), joined.copy()
        for i in range(1, GRAM):
            at = np.flatnonzero(whole)
            reach[at] = stop[at + i]
            whole = whole[:-1] & joined[i:]
        return begin, reach

    def features(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Buckets of the tokens' features of one kind, and which tokens have one that is none of the kinds before."""
        gram = np.zeros(len(words.start), bool)
        gram[:-1] = words.end[:-1] > words.start[1:]  # others do not overlap
        before = np.zeros(len(words.start), np.int64)
        for size, (hashes, length) in zip((GRAM - 1, *STEMS), self.stems(words, (GRAM - 1, *STEMS))):
            own = gram if size < STEMS[0] else length > before
            yield _bucket(hashes), own
            before = np.where(own, length, before)
        yield _bucket(words.hash), words.end - words.start > before


def token_hasher() -> TokenHasher:
    return TokenHasher()


@dataclass
class Model:
    """Weight of each bucket, the extreme-value law, and the logistic curve's slope and height."""

    weights: np.ndarray
    rate: float
    scale: float = 0.1
    slope: float = 0.0
    height: float = 0.0


def weigh(toxic: np.ndarray, clean: np.ndarray) -> Model:
    """Weights of the buckets from the number of toxic and of clean texts that have them."""
    both = toxic + clean
    total, n1, n0 = both.sum(), toxic.sum(), clean.sum()
    if not n1 or not n0:
        return Model(np.full(len(both), -COST, np.float32), 1.0)
    prior = np.maximum(PRIOR * both / total, 1e-9)
    odds = np.log((toxic + prior) / (n1 + PRIOR - toxic - prior)) - np.log((clean + prior) / (n0 + PRIOR - clean - prior))
    error = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    weights = np.where(both > 0, np.sign(odds) * np.maximum(0, np.abs(odds) - SIGMAS * error), 0) - COST
    share = (clean + prior) / (n0 + PRIOR)
    share[both == 0] = 0
    share /= share.sum()
    return Model(weights.astype(np.float32), extreme_rate(weights, share))


def extreme_rate(weights: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * weight)) = 1, 1 if no weight is positive."""
    if not (share[weights > 0] > 0).any() or (share * weights).sum() >= 0:
        return 1.0
    low, high = 0.0, 1e-3
    moment = lambda r: float((share * np.exp(np.minimum(r * weights, 700))).sum())
    while moment(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    return high


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) of a sequence, in order, in linear time.

    No part of a segment that begins or ends it has a negative sum, and none of them can be extended. Only
    positive entries are visited; the sums between them come from running totals."""
    total = np.concatenate(([0.0], np.cumsum(weights, dtype=np.float64)))
    found: list[list] = []  # start, end, total before, total after, the nearest earlier one that begins lower
    for i in np.flatnonzero(weights > 0).tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right, j])
                break
            start, left = found[j][0], found[j][2]  # joins everything since j
            before = found[j][4]
            del found[j:]
            j = before
    return [(s, e, float(b - a)) for s, e, a, b, _ in found]


class Scorer:
    """Evidence and significant passages of texts. Make one per task."""

    def __init__(self, model: Model, level: float = LEVEL) -> None:
        self.model, self.level, self.hasher = model, level, token_hasher()

    def score(self, texts: list[bytes | None]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """Per text its evidence and its passages (start, end in code points, expected number in clean text): all
        segments expected fewer times than the level."""
        for i, n, sums, places in self._segments(texts):
            expected = np.minimum(self.model.scale * n * np.exp(-self.model.rate * sums), 1.0)
            order = np.argsort(expected, kind="stable")
            r = np.arange(1, len(order) + 1)
            together = -r * np.log(expected[order] + 1e-300) + np.cumsum(np.log(r))
            evidence = float(together.max(initial=0.0))
            found = [(*places[j], float(expected[j])) for j in np.flatnonzero(expected < self.level)]
            if found:  # byte offsets to code points
                lead = np.concatenate(([0], np.cumsum((np.frombuffer(texts[i], np.uint8) & 0xC0) != 0x80)))
                found = [(int(lead[s]), int(lead[e]), x) for s, e, x in found]
            yield evidence, found

    def _segments(self, texts: list[bytes | None]):
        """Per text its number, its tokens, the sums of its segments and their places in bytes."""
        words = self.hasher.words(texts)
        weights = np.full(len(words.start), -np.inf, np.float32)
        for bucket, own in self.hasher.features(words):
            weights[own] = np.maximum(weights[own], self.model.weights[bucket[own]])
        up = np.concatenate(([0], np.cumsum(weights > 0)))
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            found = segments(weights[a:b]) if up[b] > up[a] else []
            begin = words.begin[i]
            after = [words.start[a + s] for s, _, _ in found[1:]] + [words.end[b - 1] if b > a else 0]
            # The last characters' token may reach into the next segment.
            places = [(int(words.start[a + s] - begin), int(min(words.end[a + e - 1], c) - begin))
                      for (s, e, _), c in zip(found, after)]
            yield i, b - a, np.array([x for _, _, x in found]), places

    def clean_tail(self, texts: list[bytes | None], weights: np.ndarray) -> tuple[np.ndarray, int]:
        """Segments by the bin of rate * sum, and tokens, each as often as its text's weight says."""
        tail, tokens = np.zeros(BINS, np.int64), 0
        for i, n, sums, _ in self._segments(texts):
            tokens += n * int(weights[i])
            if len(sums):
                tail += weights[i] * np.bincount(np.minimum(BINS - 1, self.model.rate * sums / BIN).astype(int), minlength=BINS)
        return tail, tokens


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each of ``SKETCHES`` mixes, a row with the smallest hash of a text's 5-word sequences. Two texts share one
    with the probability of their similarity."""
    hasher, mixes = token_hasher(), np.random.default_rng(5).integers(0, 1 << 63, (SKETCHES, 2), np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        texts, out = batch.column(1).to_pylist(), []
        for part in slices(texts):
            words = hasher.words(texts[part])
            every = window_hashes(words.hash, 5)
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                own = every[a : b - 4] if b - a >= 5 else window_hashes(words.hash[a:b], max(1, b - a))
                out += [((own ^ x) * y).min() if len(own) else np.uint64(0) for x, y in mixes]
        rows = np.repeat(np.arange(len(texts)), SKETCHES)
        key, digest, toxic = (batch.column(c).take(pa.array(rows)) for c in (0, 2, 3))
        yield pa.RecordBatch.from_arrays(
            [key, digest, toxic, pa.array(np.tile(np.arange(SKETCHES, dtype=np.int32), len(texts))),
             pa.array(np.array(out, np.uint64).view(np.int64))], ["key", "digest", "toxic", "mix", "sketch"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each bucket in toxic and clean texts, in the units of the weights; n of them in one text count
    1 + floor(log2(n)) times the text's weight."""
    hasher, size = token_hasher(), 1 << BUCKET_BITS
    counts = np.zeros(2 * size, np.int64)
    for batch in batches:
        texts, toxic, units = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for part in slices(texts):
            words = hasher.words(texts[part])
            doc = words.doc()
            keys = [doc[own] * size + bucket[own] for bucket, own in hasher.features(words)]
            once, n = np.unique(np.concatenate(keys), return_counts=True)
            weight = (1 + np.log2(n).astype(np.int64)) * units[part][once // size]
            np.add.at(counts, toxic[part][once // size] * size + once % size, weight)
    used = np.flatnonzero(counts[:size] + counts[size:])
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used + size]), pa.array(counts[used])],
                                     ["bucket", "toxic", "clean"])


def _tail(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, tail, tokens = Scorer(model.value), np.zeros(BINS, np.int64), 0
        for batch in batches:
            texts, units = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            for part in slices(texts):
                more, n = scorer.clean_tail(texts[part], units[part])
                tail, tokens = tail + more, tokens + n
        bins = np.append(np.flatnonzero(tail), -1)
        yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int32)), pa.array(np.append(tail[bins[:-1]], tokens))],
                                         ["bin", "n"])
    return run


def tail_scale(bins: np.ndarray, tokens: float) -> float:
    """The largest scale that any height of the law asks for, where at least ``TAIL`` clean segments are as high."""
    beyond = np.cumsum(bins[::-1])[::-1]
    scale = beyond / max(tokens, 1) * np.exp(np.arange(len(bins)) * BIN)
    return float(max(scale[beyond >= TAIL].max(initial=0.0), 1e-9, TAIL / max(tokens, 1)))


def _evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), []
            for part in slices(texts):
                out += [min(BINS - 1, math.ceil(e / BIN)) for e, _ in scorer.score(texts[part])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), batch.column(1), batch.column(2)], ["bin", "toxic", "weight"])
    return run


def logistic(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Slope and height of the curve through counts of ones and zeros at x, with one of each added at the ends."""
    x = np.append(x, [x.max(), 0.0])
    ones, zeros = np.append(ones, [0.5, 0.5]), np.append(zeros, [0.5, 0.5])
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        n = ones + zeros
        slope = design.T @ (ones - n * p) - np.array([1e-3, 0]) * beta
        bend = (design.T * (n * p * (1 - p))) @ design + np.diag([1e-3, 1e-9])
        move = np.linalg.solve(bend, slope)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Learn from the documents that ``labels`` marks 0 or 1. Each keeps its label and counts 1 / n, where n
    documents of its label or more share each of ``ALIKE`` of its ``SKETCHES`` smallest sequence hashes, as copies do:
    otherwise the words of a text with many copies look telling. A passage in common is not enough.
    Counts of at most 2**20 buckets and 400 bins come to the driver. Rows without key or label count nowhere; a
    document with both labels counts with each."""
    small_batches(documents.sparkSession)
    spark = documents.sparkSession
    marks = labels.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").cast("long").alias("toxic")).where(
        "toxic in (0, 1) and key is not null").distinct()
    texts = documents.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    texts = texts.withColumn("digest", F.xxhash64("text"))
    marked = texts.join(broadcast_if_small(marks, 24), "key").select("key", "text", "digest", "toxic")
    sketches = cut_lineage(marked.mapInArrow(_sketch, "key long, digest long, toxic long, mix int, sketch long"))
    groups = sketches.groupBy("mix", "sketch", "toxic").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sketches.distinct().join(broadcast_if_small(cut_lineage(groups), 36), ["mix", "sketch", "toxic"], "left").groupBy(
        "key", "digest", "toxic").agg(F.array_sort(F.collect_list(F.coalesce("n", F.lit(1)))).alias("n"))
    copies = F.element_at("n", SKETCHES - ALIKE + 1)
    chosen = cut_lineage(sizes.select(  # whole units, so sums do not depend on their order
        "key", "digest", "toxic", F.greatest(F.lit(1), F.floor(UNIT / copies)).cast("long").alias("weight")))
    rows = texts.join(broadcast_if_small(chosen, 40), ["key", "digest"]).select("text", "toxic", "weight")
    table = (rows.mapInArrow(_count, "bucket long, toxic long, clean long").groupBy("bucket")
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow())
    counts = np.zeros((2, 1 << BUCKET_BITS))
    for i, name in enumerate(("toxic", "clean")):
        counts[i, table["bucket"].to_numpy()] = table[name].to_numpy() / UNIT
    model = weigh(counts[0], counts[1])
    shared = spark.sparkContext.broadcast(model)
    tail = (rows.where("toxic = 0").mapInArrow(_tail(shared), "bin int, n long").groupBy("bin")
            .agg(F.sum("n").alias("n")).collect())
    bins = np.zeros(BINS)
    for r in tail:
        bins[r.bin] += r.n / UNIT if r.bin >= 0 else 0
    model.scale = tail_scale(bins, sum(r.n for r in tail if r.bin < 0) / UNIT)
    shared = spark.sparkContext.broadcast(model)
    bins = (rows.mapInArrow(_evidence(shared), "bin int, toxic long, weight long").groupBy("bin")
            .agg((F.sum(F.col("toxic") * F.col("weight")) / UNIT).alias("ones"), (F.sum("weight") / UNIT).alias("n")).collect())
    if bins:
        x, ones, n = (np.array([r[i] for r in bins], float) for i in range(3))
        model.slope, model.height = logistic(x * BIN, ones, n - ones)
    return model


_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("expected", pa.float64())]))


def _score(model, level: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, m = Scorer(model.value, level), model.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in slices(texts):
                score, found = [], []
                for evidence, passages in scorer.score(texts[part]):
                    x = min(math.ceil(evidence / BIN), BINS - 1) * BIN
                    score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * x + m.height)))))
                    found.append([{"start": a, "end": b, "expected": e} for a, b, e in passages])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[part], pa.array(score), pa.array(found, _PASSAGES)], ["key", "score", "passages"])
    return run


def score_toxicity(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id",
                   level: float = LEVEL) -> DataFrame:
    """(key, score, passages) for each row of ``documents``: the probability that the label is 1, and all significant toxic
    passages (start, end in code points, expected number of such in a clean text of that length) in order: those
    whose expected number is below ``level``. The score does not depend on ``level``.
    NULL, empty and blank texts have no evidence and get the curve's height; a model of no or one-sided labels
    gives the same score to all. NULL keys and repeated rows pass through, other columns are not looked at."""
    rows = documents.select(F.col(f"`{text}`").cast("binary").alias("text"), F.col(f"`{key}`").alias("key"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 4 MB whatever the vocabulary
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_score(shared, level),
                           f"key {kind}, score double, passages array<struct<start: bigint, end: bigint, expected: double>>")
