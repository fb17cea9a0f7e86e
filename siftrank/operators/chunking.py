"""Paragraph chunking and chunk statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.functions import fixed_values as fv
from siftrank.functions.text import strip
from siftrank.session import spread


#: Texts that a task has as Python objects at one time.
ROWS_AT_ONCE = 64


def paragraph_groups(text: str | None, min_tokens: int) -> Iterator[tuple[str, int]]:
    """Chunks of one text with their token counts: non-blank lines are gathered until they hold
    ``min_tokens`` tokens; the last chunk may be short. One pass, linear in the text."""
    lines, tokens = [], 0
    for line in (text or "").split("\n"):
        words = len(line.split())
        if words:
            lines.append(line.strip())
            tokens += words
            if tokens >= min_tokens:
                yield " ".join(lines), tokens
                lines, tokens = [], 0
    if lines:
        yield " ".join(lines), tokens


def chunk_array(text, min_tokens: int):
    """Array of ``(text, num_tokens)`` chunks of a text column."""

    @F.arrow_udf("array<struct<text:string,num_tokens:int>>")
    def split(texts: pa.Array) -> pa.Array:
        return split_texts(texts, min_tokens)

    return split(text)


def split_texts(texts: pa.Array, min_tokens: int) -> pa.Array:
    """The chunks of each text. A few texts at a time become Python objects, however many rows or bytes a batch has."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("num_tokens", pa.int32())]))
    parts = [pa.array([[{"text": c, "num_tokens": n} for c, n in paragraph_groups(t, min_tokens)]
                       for t in texts.slice(at, ROWS_AT_ONCE).to_pylist()], type=kind) for at in range(0, len(texts), ROWS_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=kind)


def chunk_paragraphs(docs: DataFrame, min_tokens: int = fv.CHUNK_MIN_TOKENS, file: str = "file_name",
                     text: str = "text_data") -> DataFrame:
    """``(file, pos, text, num_tokens)``: the chunks of each document in order."""
    return spread(docs.select(file, text)).select(file, F.posexplode(chunk_array(F.col(text), min_tokens)).alias("pos", "_chunk")).select(
        file, "pos", "_chunk.text", "_chunk.num_tokens")


def chunk_size_sweep(docs: DataFrame, candidates: Sequence[int] = fv.CHUNK_SIZE_CANDIDATES,
                     text: str = "text_data") -> DataFrame:
    """``(min_tokens, avg_tokens, num_chunks)`` per candidate. The token count of every paragraph is
    taken once; each candidate then only needs counts, so no chunk text is built or shuffled."""
    sizes = list(candidates)

    @F.arrow_udf("array<struct<min_tokens:int,chunks:bigint,tokens:bigint>>")
    def measure(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("min_tokens", pa.int32()), ("chunks", pa.int64()), ("tokens", pa.int64())]))
        return pa.array([_count_chunks(t, sizes) for t in texts.to_pylist()], type=kind)

    per_doc = spread(docs.select(text)).select(F.explode(measure(F.col(text))).alias("_m")).select("_m.*")
    return per_doc.groupBy("min_tokens").agg(
        F.coalesce(F.try_divide(F.sum("tokens"), F.sum("chunks")), F.lit(0.0)).alias("avg_tokens"),
        F.sum("chunks").alias("num_chunks"))


def _count_chunks(text: str | None, sizes: Sequence[int]) -> list[dict]:
    words = [n for n in (len(line.split()) for line in (text or "").split("\n")) if n]
    total, out = sum(words), []
    for size in sizes:
        chunks = pending = 0
        for n in words:
            pending += n
            if pending >= size:
                chunks, pending = chunks + 1, 0
        out.append({"min_tokens": size, "chunks": chunks + (pending > 0), "tokens": total})
    return out


def chunks_per_file(chunks: DataFrame, file: str = "file_name") -> DataFrame:
    return chunks.groupBy(file).agg(F.count(F.lit(1)).alias("num_chunks"))


def call_batch_plan(per_file: DataFrame, rate: int = fv.CALLS_PER_MINUTE) -> DataFrame:
    """Texts per model call and number of calls for each file: one call up to ``rate`` chunks, above
    it batches that keep the number of calls within the rate."""
    n = F.col("num_chunks")
    size = F.when(n <= rate, n).otherwise(F.ceil(n / rate))
    return per_file.withColumn("batch_size", size.cast("bigint")).withColumn(
        "num_calls", F.ceil(n / F.col("batch_size")).cast("bigint"))


def empty_files(docs: DataFrame, file: str = "file_name", text: str = "text_data") -> DataFrame:
    """Documents without any chunk: no line holds a character that is not white space."""
    return docs.where(F.coalesce(strip(text), F.lit("")) == "").select(file)
