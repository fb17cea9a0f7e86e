"""Best-fit packing of texts into sequences, with conflicts.

Texts are cut into pieces of at most ``capacity`` tokens. A bin takes pieces while they fit and do not conflict: never two
of the same duplicate cluster, and at most ``same_source`` of the same source. Open bins are kept in the order of the room
they have left and carry bitmaps of their sources and clusters. A piece starts at the first bin with room enough and
goes on to the next larger until one is compatible, so it gets the tightest compatible bin, or a new one.

Pieces are dealt by hash to shards of a few thousand, each packed on its own, largest piece first; what is lost against
one packing of all is less than a bin's filling for each shard. No source or cluster is gathered anywhere.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.session import cut_lineage

CAPACITY = 2048
SHARD_PIECES = 4096
SAME_SOURCE = 4


def count_words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x09-\\x0D ]+")), F.lit(0)).cast("long")


class Packer:
    """Open bins of one shard."""

    def __init__(self, capacity: int, same_source: int) -> None:
        self.capacity, self.same_source = capacity, same_source
        self.order: list[tuple[int, int]] = []  # (room left, bin), sorted
        self.clusters: list[int] = []  # bitmaps by bin
        self.sources: list[list[int]] = []  # by bin: the sources that occur once or more, twice or more, ...
        self.filled: list[int] = []
        self.bits: dict[tuple[str, object], int] = {}

    def _bit(self, kind: str, value: object) -> int:
        return 1 << self.bits.setdefault((kind, value), len(self.bits))

    def place(self, size: int, source: object, cluster: object) -> tuple[int, int]:
        """The piece's bin and its place in it. NULL sources and clusters conflict with nothing."""
        source_bit = 0 if source is None else self._bit("source", source)
        cluster_bit = 0 if cluster is None else self._bit("cluster", cluster)
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, number = self.order[at]
            if not (self.clusters[number] & cluster_bit or self.sources[number][-1] & source_bit):
                del self.order[at]
                break
            at += 1
        else:
            room, number = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.same_source)
            self.filled.append(0)
        self.clusters[number] |= cluster_bit
        for level, seen in enumerate(self.sources[number]):
            self.sources[number][level] = seen | source_bit
            if not seen & source_bit:
                break
        insort(self.order, (room - size, number))
        self.filled[number] += 1
        return number, self.filled[number] - 1


_PACKED = "key {kind}, piece long, start long, n_tokens long, bin string, slot long"


def _pack(capacity: int, same_source: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packer = None, None
        for batch in batches:
            bins, slots = [], []
            for own, size, source, cluster in zip(*(batch.column(c).to_pylist() for c in (
                    "shard", "n_tokens", "source", "cluster"))):
                if packer is None or own != shard:
                    shard, packer = own, Packer(capacity, same_source)
                number, slot = packer.place(size, source, cluster)
                bins.append(f"{shard}-{number}")
                slots.append(slot)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "piece", "start", "n_tokens")), pa.array(bins, pa.string()),
                 pa.array(slots, pa.int64())], ["key", "piece", "start", "n_tokens", "bin", "slot"])
    return run


def pack(documents: DataFrame, tokens: Column, cluster: Column, key: str = "doc_id", source: str = "source",
         capacity: int = CAPACITY, same_source: int = SAME_SOURCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(key, piece, start, n_tokens, bin, slot) for each piece of each row of ``documents``.

    ``tokens`` is a row's length, ``cluster`` its duplicate cluster. Piece i holds the tokens from i * capacity on. A row
    without tokens (or NULL) is one piece of size 0. NULL sources and clusters conflict with nothing. Ties go by
    key, source, cluster; rows that repeat are pieces of their own and, as they share a cluster, never meet in a
    bin. Other columns are not looked at. An empty table gives no rows.
    """
    room = F.lit(capacity).cast("long")
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"),
                            cluster.cast("string").alias("cluster"),
                            F.coalesce(tokens.cast("long"), F.lit(0).cast("long")).alias("all"))
    # Written once: lengths are counted once, and the numbers that part repeated rows stay what they are.
    rows = cut_lineage(rows.withColumn("n", F.monotonically_increasing_id()))
    last = F.greatest(F.ceil(F.col("all") / room) - 1, F.lit(0)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        "n", "key", "source", "cluster", F.col("piece").cast("long").alias("piece"), (F.col("piece") * room).alias("start"),
        F.least(room, F.col("all") - F.col("piece") * room).alias("n_tokens"))
    full = rows.agg(F.sum(F.greatest(F.ceil(F.col("all") / room), F.lit(1)))).first()[0] or 0
    shards = int(full) // shard_pieces + 1
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("n", "piece"), F.lit(shards)).cast("int"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = dealt.repartition(parts, "shard").sortWithinPartitions(
        "shard", F.desc("n_tokens"), "key", "source", "cluster")
    kind = rows.schema["key"].dataType.simpleString()
    return laid.mapInArrow(_pack(capacity, same_source), _PACKED.format(kind=kind))
