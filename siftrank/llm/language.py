"""Language ID by cross-parsing: how many phrases of a language's labelled text does a text fall into?

Of each language a bounded sample of labelled text becomes a suffix automaton, which knows every substring of
the sample. A text is parsed from left to right: a phrase is the longest match from where the last one ended.
A phrase costs log2(sample length) bits, the language with the lowest cost wins. The automaton's states are
written out as a table (state, letter) -> (next state, phrase ends here), so a task parses many texts in
step, one array operation per letter. Texts longer than a piece are parsed piece by piece, whole.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftrank.llm.tables import small_batches
from siftrank.llm.words import slices

#: Bounds of the labelled sample, per language: texts, characters of each, letters in all.
SAMPLE_TEXTS = 32
TEXT_CHARS = 2_000
SAMPLE_LETTERS = 24_000
MAX_LANGUAGES = 64
#: Letters with a code of their own, shared codes for all others, and entries of the whole table (4 bytes each).
LETTERS = 150
SHARED = 16
TABLE_ENTRIES = 1 << 26
UNDETERMINED = "und"
PIECE = 512
#: Bits that count as one doubling of the odds; phrases are not independent, so more than one.
BITS = 4.0


def _letter(char: str) -> str:
    """The lower-case letter, or "" for everything that isn't one."""
    low = char.lower()
    return (low if len(low) == 1 else char) if char.isalpha() else ""


def normal(text: str) -> str:
    """Lower-case letters with one space for each run of others."""
    return " ".join("".join(_letter(c) or " " for c in unicodedata.normalize("NFC", text)).split())


def suffix_automaton(codes: list[int]) -> tuple[list[dict[int, int]], int]:
    """Transitions of the automaton of all substrings of ``codes``; the root is state 0."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
        last = new
    return go, last


@dataclass
class Model:
    """``table`` holds 2 * (first entry of the next state) + (a phrase ends); ``roots`` the languages' first entries.
    Letters have codes from 1 in the order of ``alphabet``, 0 is a gap, other letters share ``SHARED`` more codes."""

    languages: list[str]
    alphabet: str
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray


def letter_code(letter: str, known: dict[str, int]) -> int:
    return known.get(letter) or len(known) + 1 + ord(letter) % SHARED


def build(samples: dict[str, str]) -> Model:
    """The model of normalised sample texts by language. With many languages each sample is cut to its share of the table."""
    often = Counter(c for text in samples.values() for c in text if c != " ")
    alphabet = "".join(sorted(sorted(often, key=lambda c: (-often[c], c))[:LETTERS]))
    known = {c: i + 1 for i, c in enumerate(alphabet)}
    code = {" ": 0} | {c: letter_code(c, known) for c in often}
    width = len(alphabet) + 1 + SHARED
    share = TABLE_ENTRIES // (2 * width * max(1, len(samples)))  # an automaton has at most two states a letter
    samples = {k: text[:share] for k, text in samples.items()}
    parts, roots, bits, begin = [], [], [], 0
    for text in samples.values():
        go, _ = suffix_automaton([code[c] for c in text])
        root = np.full(width, 2 * begin + 1, dtype=np.int64)  # a letter that never occurs is a phrase of its own
        for c, to in go[0].items():
            root[c] = 2 * (begin + to * width) + 1
        table = np.tile(root, (len(go), 1))
        for state, edges in enumerate(go):
            for c, to in edges.items():
                table[state, c] = 2 * (begin + to * width)
        parts.append(table.ravel())
        roots.append(begin)
        bits.append(math.log2(len(text) + 2))
        begin += table.size
    table = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return Model(list(samples), alphabet, table, np.array(roots, np.int64), np.array(bits))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn from a sample of ``labelled``: of each language the ``SAMPLE_TEXTS`` texts with the smallest hashes, of each at
    most ``TEXT_CHARS`` characters, together at most ``SAMPLE_LETTERS``. Rows with NULL are left out. Of more than ``max_languages`` languages those with most rows are
    learned (of equally many, the first by name), the others, as with misspelt labels, are not. The
    sample, at most ``max_languages`` times 24,000 letters, is what goes through the driver."""
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"),
                           F.xxhash64(F.col(f"`{text}`")).alias("h")).where("text is not null and lang is not null")
    ranked = rows.select("lang", "h").distinct().withColumn(
        "rank", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= SAMPLE_TEXTS)
    ends = ranked.groupBy("lang").agg(F.max("h").alias("limit"))
    limits = ends.limit(max_languages + 1).collect()
    if len(limits) > max_languages:
        often = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
        limits = ends.join(F.broadcast(often), "lang").collect()
    chosen = None
    for r in limits:
        near = (F.col("lang") == r.lang) & (F.col("h") <= r.limit)
        chosen = near if chosen is None else chosen | near
    samples: dict[str, list[str]] = {}
    if chosen is not None:
        found = (rows.where(chosen).groupBy("lang", "h").agg(F.min(F.substring("text", 1, TEXT_CHARS)).alias("text"))
                 .collect())
        for r in sorted(found, key=lambda r: (r.lang, r.h)):
            samples.setdefault(r.lang, []).append(normal(r.text))
    joined = {k: " ".join(v)[:SAMPLE_LETTERS].strip() for k, v in samples.items()}
    return build({k: v for k, v in joined.items() if v})


class Parser:
    """Parses texts with a model. Make one per task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.codes = np.full(0x110000, 255, dtype=np.uint8)
        self.known = {c: i + 1 for i, c in enumerate(model.alphabet)}

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, and where each text begins (one entry more than texts). Gaps are folded, none begins a text,
        and one ends each text with letters, so the codes of a text do not depend on its neighbours."""
        points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        code = self.codes[points]
        new = np.flatnonzero(code == 255)
        if len(new):
            for p in np.unique(points[new]).tolist():
                low = _letter(chr(p))
                self.codes[p] = letter_code(low, self.known) if low else 0
            code = self.codes[points]
        keep = code != 0
        keep[1:] |= code[:-1] != 0
        begins = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        before = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(keep, out=before[1:])
        return code[keep], before[begins]

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text by language, its codes, and its letters."""
        code, begins = self._encoded(texts)
        sizes = np.diff(begins)
        letters = np.zeros(len(code) + 1, dtype=np.int64)
        np.cumsum(code != 0, out=letters[1:])
        letters = letters[begins[1:]] - letters[begins[:-1]]
        count = (sizes + PIECE - 1) // PIECE
        doc = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = begins[doc] + nth * PIECE
        length = np.minimum(PIECE, begins[doc + 1] - start)
        order = np.argsort(-length, kind="stable")
        start, length, doc = start[order], length[order], doc[order]
        active = np.searchsorted(-length, -np.arange(PIECE), side="left")
        languages, width = len(self.model.languages), int(active[0]) if len(length) else 0
        ended = np.zeros((languages, width), dtype=np.int32)
        value = np.repeat((2 * self.model.roots)[:, None], width, axis=1).astype(np.int32)
        for step in range(PIECE if width else 0):
            n = int(active[step])
            if not n:
                break
            at = (value[:, :n] >> 1) + code[start[:n] + step]
            now = self.model.table.take(at)
            value[:, :n] = now
            ended[:, :n] += now & 1
        phrases = np.zeros((len(texts), languages))
        for i in range(languages):
            phrases[:, i] = np.bincount(doc, weights=ended[i] + 1, minlength=len(texts))
        return phrases, sizes, letters


def _predict(model, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(model.value)
        languages, bits = parser.model.languages, parser.model.bits
        for batch in batches:
            whole = batch.column(0).to_pylist()
            for part in slices(whole):
                phrases, _, letters = parser.parse([(t or b"").decode("utf-8", "replace") for t in whole[part]])
                n = len(letters)
                if languages:
                    cost = phrases * bits
                    best = cost.argmin(axis=1)
                    odds = np.exp2((cost.min(axis=1, keepdims=True) - cost) / BITS)
                    score, least = 1 / odds.sum(axis=1), phrases[np.arange(n), best]
                else:
                    best, score, least = np.zeros(n, int), np.zeros(n), np.zeros(n)
                none = (letters == 0) | (not languages)
                names = [UNDETERMINED if x else languages[b] for x, b in zip(none, best)]
                kept = [batch.column(0)[part].cast(pa.string())] if keep_text else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[part], *kept, pa.array(names), pa.array(np.where(none, 0.0, score)),
                     pa.array(np.where(none, 0, least).astype(np.int64)), pa.array(letters)],
                    ["key", *["text"] * keep_text, "lang_pred", "score", "phrases", "letters"])
            pa.default_memory_pool().release_unused()
    return run


def identify(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id",
             keep_text: bool = False) -> DataFrame:
    """(key, lang_pred, score, phrases, letters) for each row of ``documents``: the learned language with the lowest cost, a
    confidence from 0 to 1, the phrases that it needs. Ties go to the first language in the order of the model.
    A text that is NULL or has no letter is ``und`` with score 0, and so is every text when nothing was
    learned. Whole texts are parsed. With ``keep_text`` the text comes along after the key. No other column is looked at; NULL keys and repeated rows pass through."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(f"`{text}`").cast("binary").alias("text"), F.col(f"`{key}`").alias("key"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most TABLE_ENTRIES * 4 bytes
    kind = rows.schema["key"].dataType.simpleString()
    kept = "text string, " if keep_text else ""
    return rows.mapInArrow(_predict(shared, keep_text), f"key {kind}, {kept}lang_pred string, score double, phrases long, letters long")
