"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidates.

1. Every text becomes its set of word shingles. Texts with equal sets are one node, named by the set's digest, so a
   group of copies is one row from here on. A signature of 128 bins gives 32 buckets of 4 rows: a pair of
   similarity 0.75 shares no bucket with probability 5e-6.
2. In a bucket the smallest node is joined to each other one: as many candidates as members. Candidates are confirmed on
   full sets, confirmed links give components.
3. What stars can miss are links between two members that the centre is not linked with. Only buckets that still
   hold several components are looked at again: members outside the largest component are compared with those of other
   components by a signature of 1024 bins inside tasks (in blocks of 512), pairs that look similar enough
   (estimate 0.05 below the limit or more: 3.7 standard deviations) are confirmed on full sets too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm.components import components
from siftrank.llm.shingles import Signer, counted_sets, first_by_bin, set_digest, shingle_sets
from siftrank.llm.tables import small_batches
from siftrank.llm.words import WordHasher, slices
from siftrank.session import broadcast_if_small, cut_lineage

SHINGLE_WORDS = 5
PERCENT = 75
WIDE_BINS = 1024
MARGIN = 0.05
BLOCK = 512
CELL = ["bucket", "i", "j"]


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value per row of a byte matrix."""
    rows = np.ascontiguousarray(rows)
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends.buffers()[1], pa.py_buffer(rows)])


def _longs(sets: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(sets) + 1, dtype=np.int32)
    np.cumsum([len(s) for s in sets], out=ends[1:])
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, signer = WordHasher(True), Signer()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for part in slices(texts):
                words, sets = counted_sets(hasher, texts[part], size)
                bands = signer.bands(signer.signatures(sets)).view(np.int64)
                bands = [b if len(s) else b[:0] for b, s in zip(bands, sets)]
                yield pa.RecordBatch.from_arrays(
                    [keys[part], pa.array(words, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_digest(s) for s in sets], pa.binary()), _longs(bands)],
                    ["key", "n_words", "n_shingles", "node", "bands"])
            pa.default_memory_pool().release_unused()
    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(True)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in slices(texts):
                sets = shingle_sets(hasher, texts[part], size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_digest(s) for s in sets], pa.binary()), _longs(sets)], ["node", "shingles"])
            pa.default_memory_pool().release_unused()
    return run


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signature of a node: the smallest hash of each of 1024 bins as one byte, 0 where the bin is empty."""
    for batch in batches:
        nodes, lists = batch.column(0), batch.column(1)
        for begin in range(0, len(nodes), 1000):
            sets = [np.asarray(x.values).view(np.uint64) for x in lists[begin : begin + 1000]]
            values, full = first_by_bin(sets, WIDE_BINS)
            signs = np.where(full, 1 + values % np.uint64(255), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([nodes[begin : begin + 1000], _binary(signs)], ["node", "wide"])


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one cell, a stray and a member, that look similar and lie in different components. Input is sorted by cell.

    Of the bins that are full on either side, those that agree estimate the similarity without bias. Two agreements are
    forgiven, as small sets have few bins to be estimated from."""
    close = percent / 100 - MARGIN
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        node, comp = np.array(rows.column("node").to_pylist(), dtype=object), rows.column("component").to_pylist()
        wide = np.frombuffer(b"".join(rows.column("wide").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        codes = {c: i for i, c in enumerate(dict.fromkeys(comp))}
        comp, stray, outside = np.array([codes[c] for c in comp]), rows.column("stray").to_numpy(), rows.column("outside").to_numpy()
        bands = np.array(rows.column("bands").to_pylist(), dtype=np.int64)
        bucket = rows.column("bucket")[0].as_py()
        member = np.flatnonzero(~stray)
        out_a, out_b = [], []
        for i in np.flatnonzero(stray):
            # A pair counts once: in the first bucket that it shares, and of two strays the smaller node looks for the other.
            j = member[(comp[member] != comp[i]) & (~outside[member] | (node[member] > node[i]))]
            same = bands[j] == bands[i]
            j = j[bands[i][same.argmax(axis=1)] == bucket]
            both, either = wide[j] & wide[i], wide[j] | wide[i]
            agree = ((wide[j] == wide[i]) & (both != 0)).sum(axis=1)
            for k in j[agree + 2 >= close * (either != 0).sum(axis=1)]:
                a, b = sorted((node[i], node[k]))
                out_a.append(a)
                out_b.append(b)
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    def cells() -> Iterator[pa.Table]:
        last = None
        for batch in batches:
            cell = list(zip(*(batch.column(c).to_pylist() for c in CELL)))
            begin = 0
            for i in range(1, len(cell) + 1):
                if i == len(cell) or cell[i] != cell[begin]:
                    if held and cell[begin] != last:
                        yield pa.Table.from_batches(held)
                        held.clear()
                    held.append(batch.slice(begin, i - begin))
                    last, begin = cell[begin], i
        if held:
            yield pa.Table.from_batches(held)
            held.clear()

    for table in cells():
        yield pairs(table)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return both.where(100 * shared >= percent * union).select("a", "b")


def leftover_cells(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns bucket, i, j, stray, outside, component and node: who is compared with whom in buckets of several components.

    Members outside a bucket's largest component are strays; ``outside`` says who is one, ``stray`` for whom the row stands as one. Each stray meets each member: cell (i, j) has the strays of block i and
    the members of block j. So a bucket of n members and s strays gives about n * (1 + s / BLOCK) + s * n / BLOCK rows, and a single
    stray among a million members little more than a million. Pairs inside the largest component are never formed."""
    placed = cut_lineage(members.join(labels.select("node", "component"), "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")))
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("components"))
    mixed = cut_lineage(mixed.where("components > 1").select(
        "bucket", F.col("top.component").alias("largest"), F.ceil(F.col("n") / BLOCK).cast("int").alias("member_blocks"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("stray_blocks")))
    rows = placed.join(mixed, "bucket")

    def block(blocks: str):
        return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")

    def every(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    out = [(F.col("component") != F.col("largest")).alias("outside"), "component", "node"]
    strays = rows.where("component <> largest").select(
        "bucket", block("stray_blocks").alias("i"), every("member_blocks").alias("j"), F.lit(True).alias("stray"), *out)
    others = rows.select("bucket", every("stray_blocks").alias("i"), block("member_blocks").alias("j"), F.lit(False).alias("stray"), *out)
    return strays.unionByName(others)


def _leftover(members: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of buckets that hold several components, by wide signatures of their members only."""
    cells = cut_lineage(leftover_cells(members, labels))
    wide = sets.join(cells.select("node").distinct(), "node", "left_semi").mapInArrow(_wide, "node binary, wide binary")
    signs = cut_lineage(wide.join(nodes.select("node", "bands"), "node"))
    laid = cells.join(signs, "node").repartition(*CELL).sortWithinPartitions(*CELL)
    return laid.mapInArrow(lambda rows: _compare(rows, percent), "a binary, b binary").distinct()


def near_dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
               percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, n_words, component_id, kept) for each row of ``documents``.

    Texts link when 100 * intersection >= percent * union of their sets of ``shingle_words``-word shingles
    (lower-cased A-Z; a text with fewer words is one shingle). ``component_id`` is the smallest key reachable
    over links, ``kept`` says that it is the row's own. A NULL, empty or blank text has no shingles and links with
    nothing. A row with a NULL key links with nothing, has component_id NULL and is kept. Rows that repeat a key
    with the same text share a component. Other columns are not looked at. An empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    signed = cut_lineage(rows.mapInArrow(_sign(shingle_words),
                                         "key long, n_words long, n_shingles long, node binary, bands array<long>"))
    linked = signed.where("n_shingles > 0 and key is not null")
    nodes = linked.groupBy("node").agg(F.min("key").alias("key"), F.first("bands").alias("bands"))
    nodes = cut_lineage(nodes)
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    centres = (placed.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n"))
               .where("n > 1").select("bucket", "centre"))
    members = cut_lineage(placed.join(cut_lineage(centres), "bucket"))
    stars = cut_lineage(members.where("centre <> node")
                        .select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())

    wanted = cut_lineage(members.select("node").distinct().join(nodes.select("node", "key"), "node"))
    near = broadcast_if_small(wanted.select("key").distinct(), 16)
    found = rows.join(near, "key", "left_semi").select("text").mapInArrow(
        _full_sets(shingle_words), "node binary, shingles array<long>")
    sets = cut_lineage(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    links = cut_lineage(_confirmed(stars, sets, percent))
    labels = components(links)
    more = _leftover(members.select("bucket", "node"), nodes, labels, sets, percent).join(stars, ["a", "b"], "left_anti")
    more = cut_lineage(_confirmed(more, sets, percent))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = cut_lineage(nodes.select("node", "key").join(labels, "node").select("node", "component", "key"))
    least = named.groupBy("component").agg(F.min("key").alias("component_id"))
    named = cut_lineage(named.join(least, "component").select("node", "component_id"))
    own = nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "key").alias("component_id"))
    return (signed.select("key", "n_words", "n_shingles", F.when(F.col("key").isNotNull() & (F.col("n_shingles") > 0),
                                                      F.col("node")).alias("node"))
            .join(cut_lineage(own), "node", "left")
            .select("key", "n_shingles", "n_words", F.coalesce("component_id", "key").alias("component_id"))
            .withColumn("kept", F.col("key").eqNullSafe(F.col("component_id"))))
