"""Chunk store fed by a stream of new document files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from siftrank.functions import fixed_values as fv
from siftrank.operators.models import Encoder
from siftrank.plans.corpus import ChunkStore
from siftrank.sources.readers import CORPUS_SCHEMA


def ingest_stream(spark: SparkSession, source: str, store: ChunkStore, make_encoder: Callable[[], Encoder],
                  checkpoint: str, min_tokens: int = fv.STORE_MIN_TOKENS, files_per_batch: int = 1000,
                  **encode_options) -> StreamingQuery:
    """Add the JSON-lines files that appear in ``source`` to the store, then stop.

    The stream checkpoint knows the files it has read. A batch that is repeated after a failure adds
    nothing, because the store skips documents it already holds.
    """
    docs = spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source)

    def add(batch, batch_id: int) -> None:
        store.add(batch, make_encoder, f"stream-{batch_id}", min_tokens, **encode_options)

    return (docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
