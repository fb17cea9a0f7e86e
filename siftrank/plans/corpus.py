"""From documents to a chunk store that can be extended and resumed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftrank.functions import fixed_values as fv
from siftrank.operators.chunking import chunk_paragraphs
from siftrank.operators.models import Encoder, Retry, encode
from siftrank.session import broadcast_if_small
from siftrank.sources.readers import read_store
from siftrank.sources.writers import append_rows

CHUNK_SCHEMA = "file_name string, pos int, text string, num_tokens int, embedding array<float>, attempt string"
FILES_SCHEMA = "file_name string, attempt string"
COMMIT_SCHEMA = "batch_id string, committed timestamp, attempt string"


def pending_files(docs: DataFrame, progress: DataFrame) -> DataFrame:
    """Documents that no earlier run has finished."""
    return docs.join(progress.select("file_name"), "file_name", "left_anti")


def build_chunks(docs: DataFrame, make_encoder: Callable[[], Encoder],
                 min_tokens: int = fv.STORE_MIN_TOKENS, **encode_options) -> DataFrame:
    """``(file_name, pos, text, num_tokens, embedding)`` of the documents, chunked and encoded in one stage."""
    return encode(chunk_paragraphs(docs, min_tokens), "text", make_encoder, **encode_options)


class ChunkStore:
    """Chunks, the files they come from, and one commit row for each finished batch.

    A batch is written under the name of its attempt: chunks, then the names of its files (those without a chunk, too), then one
    row that commits both. Readers see committed attempts only, so what a killed run leaves behind is never read. Two
    writers may add at the same time: of a file that both have added, the earlier commit counts (by the clocks of the
    writers, then by name) and the other's chunks are left out.
    """

    def __init__(self, spark, folder: str):
        self.spark = spark
        folder = folder.rstrip("/")
        self.chunk_path, self.file_path, self.commit_path = f"{folder}/chunks", f"{folder}/files", f"{folder}/commits"

    def commits(self, missing_ok: bool = True) -> DataFrame:
        """``(batch_id, committed, attempt)``, one row per finished batch."""
        return read_store(self.spark, self.commit_path, COMMIT_SCHEMA, missing_ok)

    def _files(self) -> DataFrame:
        """``(file_name, attempt, place)`` of the committed attempts; place 1 is the one that counts."""
        files = read_store(self.spark, self.file_path, FILES_SCHEMA, missing_ok=True)
        committed = files.join(broadcast_if_small(self.commits(), 128), "attempt")
        first = W.partitionBy("file_name").orderBy("committed", "attempt")
        return committed.select("file_name", "attempt", F.row_number().over(first).alias("place"))

    def chunks(self, missing_ok: bool = False) -> DataFrame:
        """The chunks of all finished batches. Commits and files added twice are few, so chunks are not shuffled for them."""
        commits = self.commits(missing_ok).select("attempt", "batch_id")
        chunks = read_store(self.spark, self.chunk_path, CHUNK_SCHEMA, missing_ok=True)
        later = self._files().where("place > 1").select("file_name", "attempt")
        columns = [*(c for c in chunks.columns if c != "attempt"), "batch_id"]
        return chunks.join(broadcast_if_small(commits, 256), "attempt").join(
            broadcast_if_small(later, 256), ["file_name", "attempt"], "left_anti").select(columns)

    def progress(self) -> DataFrame:
        """Names of the files that are done."""
        return self._files().where("place = 1").select("file_name")

    def add(self, docs: DataFrame, make_encoder: Callable[[], Encoder], batch_id: str,
            min_tokens: int = fv.STORE_MIN_TOKENS,
            retry: Retry = Retry(attempts=fv.EMBED_ATTEMPTS), **encode_options) -> None:
        """Chunk, encode and append the documents that are not in the store yet."""
        attempt = f"attempt=by-{uuid.uuid4().hex}"  # no name that a reader could take for a number
        todo = pending_files(docs.dropDuplicates(["file_name"]), self.progress())
        chunks = build_chunks(todo, make_encoder, min_tokens, retry=retry, **encode_options)
        # Folders of their own, as writers in one folder would remove each other's temporary files.
        append_rows(chunks, f"{self.chunk_path}/{attempt}")
        append_rows(todo.select("file_name"), f"{self.file_path}/{attempt}")
        self._commit(attempt, batch_id)

    def _commit(self, attempt: str, batch_id: str) -> None:
        """One row in one file: it is there or it is not."""
        row = self.spark.range(0, 1, numPartitions=1).select(
            F.lit(batch_id).alias("batch_id"), F.current_timestamp().alias("committed"))
        append_rows(row, f"{self.commit_path}/{attempt}")
