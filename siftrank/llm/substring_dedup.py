"""Removal of word sequences that an earlier document has too, by prefix-partitioned suffix trees.

A window is ``window`` consecutive words. The suffix tree of all texts, cut off at that depth, has a deep internal
node for each window that occurs more than once; below it are the suffixes that share it. The tree is built in
parts that fit in memory, each for the suffixes that begin with certain prefixes:

1. ``anchors``. Most suffixes share nothing, so they are told apart first: of the 6-word sequences inside a window
   the one with the smallest hash is its anchor (one word in five or so is one). Windows that are equal have equal
   anchors, so only suffixes whose anchor occurs in two texts go on. This drops no repeat.
2. ``prefixes``. The remaining suffixes are counted by their first word, over all texts. A prefix with more than half the
   suffixes that fit is replaced by longer ones (2, 3, 5, 8 words, the window), counted in turn. Of the prefixes that
   remain, those with more than 1/64 of what fits are packed into groups by their counts; the others are dealt by hash to
   groups that they fill by half. Only a single window with more entries than fit has a larger group, and it has
   one entry a block of texts.
3. ``subtrees``. A group sorts its suffixes and finds common prefixes of neighbours, which are the internal nodes;
   those of full depth are the repeats, and their smallest document keeps its words.

What a block of texts can decide alone it decides alone: of each anchor and each window it sends one entry, however
often it occurs there, so a passage of very many documents sends as many entries as there are blocks.
Texts that are equal as a whole are one text before all this. Entries carry 16 bits of each word and 64 bits of the whole
window.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.llm.tables import small_batches
from siftrank.llm.words import WordHasher, mix, slices, window_hashes
from siftrank.session import broadcast_if_small, cut_lineage

WINDOW = 13
ANCHOR = 6
GROUP_SUFFIXES = 1_000_000
#: Bytes of text for each part that anchors and places are dealt to; a task holds one part's.
PART_BYTES = 64 << 20
LENGTHS = (1, 2, 3, 5, 8, 13)
LAST = (1 << 63) - 1
_RID = np.dtype([("key", "<i8"), ("print", "<i8")])
_ENTRY = ("grp int, kind int, mark binary, path binary, doc binary, pos binary, rid binary")


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(sorted_values)), bool),
                                          sorted_values[1:] != sorted_values[:-1])))


class _Block:
    """Some texts with the hashes of their words and windows."""

    def __init__(self, hasher: WordHasher, keys, prints, texts, window: int) -> None:
        words = hasher.words(texts)
        self.first, self.hash, self.window = words.first, words.hash, window
        self.doc = words.doc().astype(np.int64)
        self.rid = np.zeros(len(keys), _RID)
        self.rid["key"], self.rid["print"] = keys, prints
        n = max(0, len(self.hash) - window + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 : window - 1 + n]) if n else np.zeros(0, np.int64)
        self.whole = window_hashes(self.hash, window)[self.at]

    def anchors(self) -> np.ndarray:
        """The word at which each window's anchor begins."""
        grams = window_hashes(self.hash, min(ANCHOR, self.window))
        least, place = grams[self.at], self.at.copy()
        for j in range(1, self.window - ANCHOR + 1):
            other = grams[self.at + j]
            less = other < least
            least = np.where(less, other, least)
            place[less] = self.at[less] + j
        return place

    def grams(self) -> np.ndarray:
        return window_hashes(self.hash, min(ANCHOR, self.window))


def _rows(block: _Block, grp: np.ndarray, kind: int, mark, path, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Entries as one row per group; positions are counted from the document's first word."""
    order = np.argsort(grp, kind="stable")
    begins = np.append(_starts(grp[order]), len(order))
    out: list[list] = [[] for _ in range(7)]
    for a, b in zip(begins[:-1], begins[1:]):
        part = order[a:b]
        docs, local = np.unique(doc[part], return_inverse=True)
        out[0].append(int(grp[part[0]]))
        out[1].append(kind)
        out[2].append(None if mark is None else mark[part].tobytes())
        out[3].append(None if path is None else path[part].tobytes())
        out[4].append(local.astype("<u4").tobytes())
        out[5].append((pos[part] - block.first[doc[part]]).astype("<u4").tobytes())
        out[6].append(block.rid[docs].tobytes())
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)],
                                      ["grp", "kind", "mark", "path", "doc", "pos", "rid"])


def _blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[_Block, pa.RecordBatch]]:
    hasher = WordHasher(False)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        keys, prints = batch.column("key").to_numpy(), batch.column("print").to_numpy()
        for part in slices(texts):
            yield (_Block(hasher, keys[part], prints[part], texts[part], window),
                   batch.slice(part.start, part.stop - part.start))


def _ask_anchors(window: int, groups: int):
    """Kind 0: an anchor to look up, its sign set when it is known to repeat; kind 1: an anchor that repeats here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _blocks(batches, window):
            if not len(block.at):
                continue
            pos = np.unique(block.anchors())
            value = block.grams()[pos]
            order = np.argsort(value, kind="stable")
            value, pos = value[order], pos[order]
            doc = block.doc[pos]
            starts = _starts(value)
            ends = np.append(starts[1:], len(value)) - 1
            repeats = doc[starts] != doc[ends]  # positions ascend inside a value, so documents do
            every = np.repeat(repeats, np.diff(np.append(starts, len(value))))
            known = np.flatnonzero(every)
            if len(known):
                yield _rows(block, pos[known[:1]].repeat(len(known)) % groups, 1, None, None, doc[known], pos[known])
            mark = (value[starts] & ~np.uint64(1)) | repeats.astype(np.uint64)
            yield _rows(block, (value[starts] >> np.uint64(32)).astype(np.int64) % groups, 0, mark, None,
                        doc[starts], pos[starts])
    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, mark, path, rid, pos) of each row of entries."""
    for batch in batches:
        for row in batch.to_pylist():
            rid = np.frombuffer(row["rid"], _RID)[np.frombuffer(row["doc"], "<u4")]
            mark = np.frombuffer(row["mark"] or b"", "<u8")
            path = np.frombuffer(row["path"] or b"", "<u2")
            yield row["kind"], mark, path, rid, np.frombuffer(row["pos"], "<u4")


def _replies(rid: np.ndarray, pos: np.ndarray, parts: int) -> pa.RecordBatch:
    """Places found, packed into one row for each part of the documents."""
    part = (mix(rid["key"].view(np.uint64) ^ rid["print"].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, rid, pos = part[order], rid[order], pos[order]
    begins = np.append(_starts(part), len(part))
    spans = list(zip(begins[:-1], begins[1:]))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[begins[:-1]].astype(np.int32)), pa.array([rid[a:b].tobytes() for a, b in spans], pa.binary()),
         pa.array([pos[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary())], ["part", "rid", "pos"])


_REPLY = "part int, rid binary, pos binary"
_FOUND = "key long, print long, found array<int>"


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of a part, with all places found in it."""
    rids, places = [], []
    for batch in batches:
        rids += [np.frombuffer(x, _RID) for x in batch.column("rid").to_pylist()]
        places += [np.frombuffer(x, "<u4") for x in batch.column("pos").to_pylist()]
    if not rids:
        return
    rid, pos = np.concatenate(rids), np.concatenate(places)
    order = np.lexsort((rid["print"], rid["key"]))
    rid, pos = rid[order], pos[order]
    starts = _starts(rid)
    ends = np.append(starts, len(rid)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos.astype(np.int32)))
    yield pa.RecordBatch.from_arrays([pa.array(rid["key"][starts]), pa.array(rid["print"][starts]), lists],
                                     ["key", "print", "found"])


def _answer_anchors(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Anchors that more than one text has."""
    marks, rids, places = [], [], []
    for kind, mark, _, rid, pos in _gather(batches):
        if kind == 1:
            yield _replies(rid, pos, parts)
        else:
            marks.append(mark)
            rids.append(rid)
            places.append(pos)
    if not marks:
        return
    mark = np.concatenate(marks)
    order = np.argsort(mark, kind="stable")  # by anchor, its known repeats last
    mark, rid, pos = mark[order], np.concatenate(rids)[order], np.concatenate(places)[order]
    starts = _starts(mark >> np.uint64(1))
    sizes = np.diff(np.append(starts, len(mark)))
    known = (mark & np.uint64(1)).astype(bool)
    asked = np.repeat((sizes > 1) | known[starts + sizes - 1], sizes) & ~known
    if asked.any():
        yield _replies(rid[asked], pos[asked], parts)


def _surviving(block: _Block, rows: pa.RecordBatch) -> np.ndarray:
    """Indexes into ``block.at`` of the windows whose anchor repeats."""
    grams = block.grams()
    found = rows.column("found").to_pylist()
    places = [np.asarray(f or [], dtype=np.int64) + a for f, a in zip(found, block.first[:-1])]
    # An anchor counts in the documents for which it was found, at each of its places there.
    marks = [np.unique(grams[p]) for p in places]
    anchor = grams[block.anchors()] if len(block.at) else np.zeros(0, np.uint64)
    doc = block.doc[block.at]
    bounds = np.searchsorted(doc, np.arange(len(marks) + 1))
    keep = np.zeros(len(block.at), bool)
    for m, a, b in zip(marks, bounds[:-1], bounds[1:]):
        if len(m) and b > a:
            i = np.minimum(np.searchsorted(m, anchor[a:b]), len(m) - 1)
            keep[a:b] = m[i] == anchor[a:b]
    return np.flatnonzero(keep)


class _Suffixes:
    """A block's distinct surviving windows: who has each first, and which copies can go at once."""

    def __init__(self, block: _Block, rows: pa.RecordBatch) -> None:
        alive = _surviving(block, rows)
        value, pos = block.whole[alive], block.at[alive]
        key = block.rid["key"][block.doc[pos]]
        order = np.lexsort((pos, key, value))
        self.value, self.pos, key = value[order], pos[order], key[order]
        self.doc = block.doc[self.pos]
        starts = _starts(self.value)
        sizes = np.diff(np.append(starts, len(self.value)))
        later = key > np.repeat(key[starts], sizes)
        self.later = np.flatnonzero(later)
        # One entry for each window and text among those with the smallest key.
        lead = ~later
        lead[1:] &= (self.value[1:] != self.value[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.lead = np.flatnonzero(lead)


def _lengths(window: int) -> list[int]:
    return [n for n in LENGTHS if n < window] + [window]


def _count_prefixes(window: int, length: int, heavy: dict[int, np.ndarray]):
    """Counts of a block's prefixes of ``length`` words, of the suffixes whose shorter prefixes are all heavy."""
    shorter = [n for n in _lengths(window) if n < length]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches, window):
            s = _Suffixes(block, rows)
            pos = s.pos[s.lead]
            for n in shorter:
                pos = pos[np.isin(window_hashes(block.hash, n)[pos], heavy[n])]
            values, counts = np.unique(window_hashes(block.hash, length)[pos], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))],
                                             ["prefix", "n"])
    return run


def _plan_groups(suspects: DataFrame, window: int, bound: int, parts: int):
    """The prefixes by length that longer ones replace; the prefixes that have a group by name, in order, with their
    groups; how many groups the others are dealt to, whose numbers come first; how many groups there are.

    Counts are summed over all blocks before any is left out. What comes here has more than ``bound`` / 64 suffixes:
    at most 64 * suffixes / ``bound`` prefixes of each length."""
    heavy: dict[int, np.ndarray] = {}
    total, sizes, names = 0, [], []
    for n in _lengths(window):
        counts = cut_lineage(suspects.mapInArrow(_count_prefixes(window, n, heavy), "prefix long, n long")
                             .groupBy("prefix").agg(F.sum("n").alias("n")))
        if n == 1:
            total = counts.agg(F.sum("n")).first()[0] or 0
        many = counts.where(F.col("n") > bound // 64).toArrow()
        prefix, size = many["prefix"].to_numpy().view(np.uint64), many["n"].to_numpy()
        more = size > bound // 2 if n < window else np.zeros(len(size), bool)
        names.append(prefix[~more])
        sizes.append(size[~more])
        heavy[n] = np.sort(prefix[more])
        if not more.any():
            break
    light = max(parts, total // max(1, bound // 2) + 1)
    name, size = np.concatenate(names), np.concatenate(sizes)
    order = np.lexsort((name, -size))
    group, rooms = np.zeros(len(name), np.int64), []  # (suffixes, group) of the groups, the emptiest first
    for i in order.tolist():
        if rooms and rooms[0][0] + size[i] <= bound:
            held, at = heappop(rooms)
        else:
            held, at = 0, light + len(rooms)
        group[i] = at
        heappush(rooms, (held + int(size[i]), at))
    order = np.argsort(name, kind="stable")
    return heavy, name[order], group[order], light, light + len(rooms)


def _send_suffixes(window: int, heavy: dict[int, np.ndarray], names: np.ndarray, places: np.ndarray, light: int, groups: int):
    """Kind 0: a window's path and hash for its group; kind 1: a window that an earlier text here has too."""
    lengths = _lengths(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches, window):
            s = _Suffixes(block, rows)
            if len(s.later):
                yield _rows(block, s.pos[s.later[:1]].repeat(len(s.later)) % groups, 1, None, None, s.doc[s.later],
                            s.pos[s.later])
            if not len(s.lead):
                continue
            pos = s.pos[s.lead]
            route, open_ = np.zeros(len(pos), np.uint64), np.ones(len(pos), bool)
            for n in lengths:
                prefix = window_hashes(block.hash, n)[pos]
                route = np.where(open_, prefix, route)
                if not len(heavy.get(n, ())):
                    break
                open_ &= np.isin(prefix, heavy[n])
            path = np.stack([block.hash[pos + j].astype("<u2") for j in range(window)], axis=1)
            grp = (route >> np.uint64(8)).astype(np.int64) % light
            if len(names):
                i = np.minimum(np.searchsorted(names, route), len(names) - 1)
                grp = np.where(names[i] == route, places[i], grp)
            yield _rows(block, grp, 0, s.value[s.lead], path, s.doc[s.lead], pos)
    return run


def common_prefixes(path: np.ndarray) -> np.ndarray:
    """Entries that each row of a sorted matrix shares with the row before; 0 for the first."""
    same = path[1:] == path[:-1]
    depth = np.where(same.all(axis=1), path.shape[1], same.argmin(axis=1))
    return np.concatenate((np.zeros(min(1, len(path)), depth.dtype), depth))


def _subtrees(window: int, parts: int):
    """Windows that a text with a smaller key has too, from the deep nodes of the group's subtrees."""
    def tree(marks, paths, rids, places) -> Iterator[pa.RecordBatch]:
        path, mark = np.concatenate(paths), np.concatenate(marks)
        rid, pos = np.concatenate(rids), np.concatenate(places)
        order = np.lexsort((rid["key"], mark, *path.T[::-1]))
        path, mark, rid, pos = path[order], mark[order], rid[order], pos[order]
        # Neighbours in sorted order meet at an internal node as deep as their common prefix.
        deep = (common_prefixes(path) >= window) & np.concatenate(([False], mark[1:] == mark[:-1]))
        node = np.flatnonzero(~deep)  # the first leaf of each deep node, or a leaf alone
        least = np.repeat(rid["key"][node], np.diff(np.append(node, len(mark))))
        gone = rid["key"] > least
        if gone.any():
            yield _replies(rid[gone], pos[gone], parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [], [])
        for batch in batches:
            groups = batch.column("grp").to_pylist()
            for grp, (kind, mark, path, rid, pos) in zip(groups, _gather(iter([batch]))):
                if kind == 1:
                    yield _replies(rid, pos, parts)
                    continue
                if grp != last and held[0]:
                    yield from tree(*held)
                    held = ([], [], [], [])
                last = grp
                for own, x in zip(held, (mark, path.reshape(-1, window), rid, pos)):
                    own.append(x)
        if held[0]:
            yield from tree(*held)
    return run


def _cut(window: int):
    """Texts without the words of the found windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(False)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in slices(texts):
                words = hasher.words(texts[part])
                found = batch.column("found")[part].to_pylist()
                copy = batch.column("copy")[part].to_pylist()
                n_words, n_removed, kept = [], [], []
                for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                    n = int(b - a)
                    keep = np.ones(n, bool)
                    if copy[i] and n >= window:
                        keep[:] = False
                    elif found[i]:
                        every = window_hashes(words.hash[a:b], window)
                        at = np.flatnonzero(np.isin(every, every[np.asarray(found[i], dtype=np.int64)]))
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                        keep = np.cumsum(edge[:n]) == 0
                    start, end = words.start[a:b][keep].tolist(), words.end[a:b][keep].tolist()
                    n_words.append(n)
                    n_removed.append(n - len(start))
                    kept.append(b" ".join([words.data[x:y] for x, y in zip(start, end)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key")[part], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_words", "n_removed", "kept_text"])
    return run


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("").cast("binary")), 256))


def substring_dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                    group_suffixes: int = GROUP_SUFFIXES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, n_words, n_removed, kept_text) for each row of ``documents``.

    Words are runs other than space and 0x09-0x0D. A word goes if a window of ``window`` words that covers it also
    occurs in a text with a smaller key; windows are judged on the input. Kept words are joined by one
    space. NULL or blank texts have no words; shorter texts than a window lose nothing. A NULL key comes after
    all others, and rows with the same key (or NULL) take nothing from each other. Other columns are not
    looked at. An empty table gives no rows. ``window`` is 6 or more. There is a part for every ``part_bytes`` of text, and one for each
    shuffle partition at least, so what a task holds does not grow with the table.
    """
    if window < ANCHOR:
        raise ValueError(f"window must be {ANCHOR} or more")
    small_batches(documents.sparkSession)
    spark = documents.sparkSession
    rows = documents.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("key"),
                            F.col(f"`{text}`").cast("binary").alias("text"))
    rows = rows.withColumn("print", F.xxhash64(F.coalesce("text", F.lit("").cast("binary"))))

    # Of equal texts only the first takes part; the others lose every word that a window covers.
    ids = cut_lineage(rows.select("key", "print", _digest("text").alias("digest"), F.octet_length("text").alias("bytes")))
    total = ids.agg(F.sum(F.col("bytes").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // part_bytes + 1)
    first = ids.groupBy("digest").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
    copies = cut_lineage(ids.join(cut_lineage(first.select("digest", "least")), "digest").where("key > least")
                         .select("key", "print").distinct())
    near_copies = broadcast_if_small(copies, 24)
    single = rows.join(near_copies, ["key", "print"], "left_anti")

    asked = single.select("key", "print", "text").mapInArrow(_ask_anchors(window, parts), _ENTRY)
    answers = asked.repartitionById(parts, "grp").mapInArrow(lambda rows: _answer_anchors(rows, parts), _REPLY)
    repeated = cut_lineage(answers.repartitionById(parts, "part").mapInArrow(_by_document, _FOUND))
    near = broadcast_if_small(repeated.select("key", "print"), 24)
    suspects = cut_lineage(single.join(near, ["key", "print"], "left_semi").join(repeated, ["key", "print"])
                           .select("key", "print", "text", "found"))

    plan = _plan_groups(suspects, window, group_suffixes, parts)
    sent = suspects.mapInArrow(_send_suffixes(window, *plan), _ENTRY)
    replies = sent.repartitionById(parts, "grp").sortWithinPartitions("grp").mapInArrow(_subtrees(window, parts), _REPLY)
    gone = cut_lineage(replies.repartitionById(parts, "part").mapInArrow(_by_document, _FOUND))

    near_gone = broadcast_if_small(gone.select("key", "print"), 24)
    whole = (rows.join(near_gone, ["key", "print"], "left_anti")
             .join(near_copies.withColumn("copy", F.lit(True)), ["key", "print"], "left")
             .select("key", "text", F.lit(None).cast("array<int>").alias("found"),
                     F.coalesce("copy", F.lit(False)).alias("copy")))
    damaged = suspects.select("key", "print", "text").join(gone, ["key", "print"]).select(
        "key", "text", "found", F.lit(False).alias("copy"))
    schema = "key long, n_words long, n_removed long, kept_text string"
    done = whole.mapInArrow(_cut(window), schema).unionByName(damaged.mapInArrow(_cut(window), schema))
    return done.withColumn("key", F.when(F.col("key") != LAST, F.col("key")))
