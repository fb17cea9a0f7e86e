"""Tables that tasks read themselves, file by file: a nested loop over shared files.

A side that is too large to send to every executor, or that grows, is written once under the checkpoint folder, in files of bounded
size. Tasks get the files' names and read them one after the other, so neither the driver nor a task ever holds the whole side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.functions.vectors import to_matrix
from siftrank.session import cut_lineage


def block_files(rows: DataFrame, vector: str, max_bytes: int, by: Sequence[str] = ()) -> tuple[list[str], int]:
    """Write ``rows`` (numbers, the array column ``vector`` and carried columns) in files of at most ``max_bytes`` each, one row at least.
    The files' names and the number of rows. ``by`` gives each value of these columns files of its own."""
    extra = [f.name for f in rows.schema.fields if f.name != vector and f.dataType.simpleString() not in ("bigint", "int", "double")]
    numbers = len(rows.columns) - len(extra) - 1
    row_bytes = F.lit(8 * numbers) + F.lit(8) * F.coalesce(F.size(vector), F.lit(0))
    if extra:
        row_bytes = row_bytes + F.coalesce(F.octet_length(F.to_json(F.struct(*extra))), F.lit(0))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(row_bytes.cast("bigint")).alias("most"), F.sum(row_bytes.cast("bigint")).alias("all")).first()
    if not size.n:
        return [], 0
    most = max(1, max_bytes // max(size.most, 1))
    parts = math.ceil(size.all / max_bytes)
    dealt = rows.repartition(max(1, min(parts, size.n)), *by) if by else rows.repartition(max(1, min(parts, size.n)))
    return sorted(cut_lineage(dealt, by, most).inputFiles()), size.n


def dealt_files(rows: DataFrame, vector: str, max_bytes: int) -> tuple[dict[int, list[str]], int]:
    """``rows`` (``_id``, a number, and ``vector``) in files of at most about ``max_bytes``, each row in the part that a hash of its ``_id`` names, so
    that a key is looked for in one part only. The files of each part and the number of parts. Rows without ``_id`` are left out."""
    rows = rows.where(F.col("_id").isNotNull())
    row_bytes = F.lit(16) + F.lit(8) * F.coalesce(F.size(vector), F.lit(0))
    total = rows.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0
    parts = max(1, math.ceil(total / max_bytes))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int"))
    files, _ = block_files(dealt, vector, 2 * max_bytes, by=["_part"])
    of_part: dict[int, list[str]] = {}
    for f in files:
        of_part.setdefault(int(unquote(f).rsplit("_part=", 1)[1].split("/")[0]), []).append(f)
    return of_part, parts


def text_files(rows: DataFrame, text: str, max_bytes: int) -> tuple[dict[int, list[str]], int]:
    """``rows`` (``_id``, a number that does not repeat, and ``text``) in parts of about ``max_bytes``, each row in the part that a hash of its ``_id``
    names. The files of each part and the number of parts."""
    rows = rows.select("_id", F.col(text).alias("_text")).where("_id is not null and _text is not null")
    total = rows.agg(F.sum(F.octet_length("_text").cast("bigint") + 16)).first()[0] or 0
    parts = max(1, math.ceil(total / max_bytes))
    if parts == 1:
        return {0: sorted(cut_lineage(rows).inputFiles())}, 1
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int")).repartition(parts, "_part")
    of_part: dict[int, list[str]] = {}
    for f in sorted(cut_lineage(dealt, ["_part"]).inputFiles()):
        of_part.setdefault(int(unquote(f).rsplit("_part=", 1)[1].split("/")[0]), []).append(f)
    return of_part, parts


def _sorted_texts(uris: tuple[str, ...]) -> tuple[np.ndarray, pa.Array]:
    """Keys of some files in ascending order and their texts."""
    table = pa.Table.from_batches([_read(u) for u in uris]) if uris else pa.table({"_id": pa.array([], pa.int64()), "_text": pa.array([], pa.string())})
    ids = table.column("_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], pa.concat_arrays(table.column("_text").cast(pa.large_string()).chunks or [pa.array([], pa.large_string())]).take(pa.array(order))


@lru_cache(maxsize=1)
def read_texts(uris: tuple[str, ...]) -> tuple[np.ndarray, pa.Array]:
    return _sorted_texts(uris)


@lru_cache(maxsize=1)
def read_other_texts(uris: tuple[str, ...]) -> tuple[np.ndarray, pa.Array]:
    """As ``read_texts``, for the other side, so that each side keeps its last part."""
    return _sorted_texts(uris)


def _sorted_vectors(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a file in ascending order, their vectors (zeros where there is none) and whether there is one."""
    block = _read(uri)
    ids, vectors = block.column("_id").to_numpy(zero_copy_only=False), block.column("_vec")
    order = np.argsort(ids, kind="stable")
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    present = to_matrix(vectors.drop_null())
    matrix = np.zeros((len(ids), present.shape[1]))
    matrix[known] = present
    return ids[order], matrix[order], known[order]


@lru_cache(maxsize=1)
def read_vectors(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _sorted_vectors(uri)


@lru_cache(maxsize=1)
def read_other_vectors(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``read_vectors``, for the other side, so that each side keeps its last file."""
    return _sorted_vectors(uri)


@lru_cache(maxsize=4)
def read_part(uri: str) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Keys of a file in ascending order, their vectors, of which none is missing, and the carried columns."""
    block = _read(uri)
    order = np.argsort(block.column("_id").to_numpy(zero_copy_only=False), kind="stable")
    sorted_rows = block.take(pa.array(order))
    carried = [sorted_rows.column(i) for i, name in enumerate(block.schema.names) if name not in ("_id", "_vec")]
    return sorted_rows.column("_id").to_numpy(zero_copy_only=False), to_matrix(sorted_rows.column("_vec")), carried


@lru_cache(maxsize=1)
def read_block(uri: str) -> pa.RecordBatch:
    """One file as one batch. The last one read stays, as it is often the only one."""
    return _read(uri)


def _read(uri: str) -> pa.RecordBatch:
    for hadoop, plain in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = plain + uri[len(hadoop):] if uri.startswith(hadoop) else uri
    filesystem, path = fs.FileSystem.from_uri(uri)
    table = pq.ParquetFile(filesystem.open_input_file(path)).read().combine_chunks()
    arrays = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]
    return pa.RecordBatch.from_arrays(arrays, names=table.column_names)


def buffered(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive batches together, each list of about ``max_bytes`` or of one batch."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > max_bytes:
            yield held
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield held
