"""Small tables and plain versions of the operators, to compare with."""

import hashlib
import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns whose names the operators use themselves.
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, key string, row string, copy string, node string, n_words long"


def edge_rows():
    """NULLs, empty and blank texts, repeated rows, ties, one long text and one long word."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old farm house"
    other = ("k", "r", "c", "n", 1)
    return [
        (1, base, "en", "a", *other), (1, base, "en", "a", *other), (2, None, None, None, *other),
        (3, "", "en", "a", *other), (4, " \n\t ", "en", None, *other), (None, base, "en", "b", *other),
        (None, None, None, None, *other), (5, base + " x", "fr", "b", *other), (6, "déjà vu", "fr", "b", *other),
        (7, (base + " ") * 400, "en", "a", *other), (8, "z" * 5000, None, "c", *other),
        (9, "a b", "en", "c", *other), (10, "a  b", "en", "c", *other), (2, "two words", "en", "c", *other),
        (11, base.replace("fox", "cat"), "en", "a", *other),
    ]


def words(text):
    return WORDS.findall(text or "")


def shingles(text, size=5):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def near_components(rows, percent=75):
    """doc_id to smallest reachable id, by comparing all pairs of texts; rows are (doc_id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def cut_repeats(rows, window=13):
    """Per row (words, removed words, kept text); rows are (doc_id, text), NULL ids come last."""
    last = float("inf")
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            p = tuple(w[k:k + window])
            least[p] = min(least.get(p, last), last if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < (last if i is None else i):
                gone[k:k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), " ".join(kept)))
    return Counter(out)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
