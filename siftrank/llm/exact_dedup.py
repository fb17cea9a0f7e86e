"""Exact dedup with a cuckoo-filter index of live digests.

The index holds, per live text, a 16-bit fingerprint in one of two buckets of four slots, and beside it the full
digest and its live row ("bucketed content"). A lookup reads two buckets; a hit of the filter counts only if
the full digest stored in the same slot agrees. Live digests can be deleted. When an insertion finds no
slot, the filter doubles and is filled again from the stored digests.

On Spark the index is used twice: every map task folds its own rows into one entry per text, so a text that
a third of all rows share sends one row per task through the shuffle; then shards by digest fold these entries.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 4
MAX_KICKS = 200
SHARD_KEYS = 500_000
_BATCH = 20_000


class CuckooIndex:
    """Cuckoo filter over digests (bytes, 16 or more, evenly spread) with the content of each slot.

    ``find``, ``insert`` and ``delete`` are exact: the fingerprint finds slots, the stored digest decides.
    """

    def __init__(self, buckets: int = 1024) -> None:
        self.moves = random.Random(7)
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[list[list]] = [[] for _ in range(buckets)]
        self.size = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[0:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> list | None:
        """The live entry [digest, value] or None."""
        mark, *places = self._places(digest)
        for b in places:
            if mark in self.prints[b]:
                for entry in self.content[b]:
                    if entry[0] == digest:
                        return entry
        return None

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that is not live."""
        entry = [digest, value]
        while (entry := self._place(entry)) is not None:
            self._double()

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it isn't live."""
        mark, *places = self._places(digest)
        for b in places:
            for i, entry in enumerate(self.content[b]):
                if self.prints[b][i] == mark and entry[0] == digest:
                    del self.prints[b][i], self.content[b][i]
                    self.size -= 1
                    return True
        return False

    def _place(self, entry: list) -> list | None:
        """None when placed, else the entry that is left without a slot."""
        mark, first, second = self._places(entry[0])
        for b in (first, second):
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(mark)
                self.content[b].append(entry)
                self.size += 1
                return None
        b = self.moves.choice((first, second))
        for _ in range(MAX_KICKS):
            i = self.moves.randrange(SLOTS)
            mark, self.prints[b][i] = self.prints[b][i], mark
            entry, self.content[b][i] = self.content[b][i], entry
            b = self._other(b, mark)
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(mark)
                self.content[b].append(entry)
                self.size += 1
                return None
        return entry

    def _double(self) -> None:
        old = [e for bucket in self.content for e in bucket]
        buckets = 2 * (self.mask + 1)
        while True:
            self._empty(buckets)
            if all(self._place(e) is None for e in old):
                return
            buckets *= 2

    def entries(self) -> Iterator[list]:
        for bucket in self.content:
            yield from bucket


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (digest, keep_id, group_size) to one entry per digest. The live entry of a text is deleted when
    a row with a larger id comes, and the newer row is inserted in its place."""
    index = CuckooIndex()
    for batch in batches:
        for digest, key, size in zip(*(c.to_pylist() for c in batch.columns)):
            live = index.find(digest)
            if live is None:
                index.insert(digest, (key, size))
                continue
            old_key, old_size = live[1]
            if key is not None and (old_key is None or key > old_key):
                index.delete(digest)
                index.insert(digest, (key, old_size + size))
            else:
                live[1] = (old_key, old_size + size)
    rows: list[list] = []
    for entry in index.entries():
        rows.append(entry)
        if len(rows) == _BATCH:
            yield _entries(rows)
            rows = []
    yield _entries(rows)


def _entries(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1][0] for r in rows], pa.int64()),
         pa.array([r[1][1] for r in rows], pa.int64())], ["digest", "keep_id", "group_size"])


def live_digests(rows: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Fold ``rows`` (digest binary, keep_id long, group_size long) to one row per digest: the largest
    keep_id (NULL only if all are NULL) and the sum of group_size.

    Shards hold about ``shard_keys`` digests at most, whatever the session's number of shuffle partitions."""
    spark = rows.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // shard_keys + 1)
    schema = "digest binary, keep_id long, group_size long"
    return (rows.mapInArrow(_fold, schema)
            .repartition(shards, "digest").mapInArrow(_fold, schema))


def exact_dedup(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``documents`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their bytes are. Of equal texts the row with the largest key stays. NULL text counts as
    empty. A row with a NULL key is never kept unless all keys of its text are NULL (then ``keep_id`` is
    NULL and all rows stay). Rows that repeat key and text are one document: they share ``kept``, and each counts
    in ``group_size``. Other columns, also ones with these names, pass through inside ``row``: the result is
    (row struct, keep_id, group_size, kept, text_sha256). An empty table gives no rows.
    """
    hashed = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("text_sha256"))
    ids = documents.select(
        F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("digest"),
        F.col(f"`{key}`").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    live = live_digests(ids).select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size")
    return hashed.join(live, "text_sha256").select(
        "row", "keep_id", "group_size",
        F.col(f"row.`{key}`").cast("long").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
