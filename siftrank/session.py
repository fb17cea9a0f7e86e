"""Session helpers: checkpoint folder, size estimates and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
SPLIT_BYTES = 128 << 20
_written: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only on a local master."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="siftrank-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new place in the checkpoint folder for files of one run. ``lineage_scope`` removes it with the tables."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut_lineage(df: DataFrame, by: Sequence[str] = (), rows_per_file: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and continue from that table. ``by`` gives each value of these columns
    a folder of its own, ``rows_per_file`` bounds its files.

    Unlike a checkpointed RDD the table is columnar, so later steps read only the columns they need, and
    its size is known to the optimizer. It outlives executors. ``lineage_scope`` removes it again.
    """
    path = scratch_folder(df.sparkSession, "siftrank")
    writer = df.write.option("maxRecordsPerFile", rows_per_file or 0)
    writer.partitionBy(*by).parquet(path) if by else writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def lineage_scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, what ``cut_lineage`` and ``scratch_folder`` write inside. Results have to be used or written inside, too."""
    begin = len(_written)
    try:
        yield
    finally:
        for path in _written[begin:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _written[begin:]


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables ``df`` is computed from, as far as the optimizer knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for costly work per row, when the input has few splits for its cluster. A large
    table is read in enough tasks and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = input_bytes(df) // SPLIT_BYTES + 1
    return df.repartition(cores) if splits * 4 <= cores else df


def broadcast_if_small(df: DataFrame, row_bytes: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when a count proves that ``df`` stays below ``max_bytes``; otherwise ``df`` as
    it is, to be joined by shuffle. ``df`` should be cheap to count, e.g. a checkpointed result."""
    allowed = max_bytes // row_bytes
    return F.broadcast(df) if df.limit(allowed + 1).count() <= allowed else df


def broadcast_texts_if_small(df: DataFrame, text: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for keys with a ``text`` when their bytes, summed up, stay below ``max_bytes``."""
    size = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64).alias("bytes")).first()
    return F.broadcast(df) if (size.bytes or 0) <= max_bytes else df
