"""Exact search: every query against every document, in matrix blocks.

The all-pairs product never becomes rows unless the caller asks for the full score table. Queries, with what they carry, are
written once as a table of files of a byte budget (``blocks``). Each task streams these files past the documents it reads: documents are
never shuffled, the driver sees file names and counts only, and a task holds one block, one buffer of documents and one tile of scores. For a
top-k a partial result leaves each task and a second step merges them; for the full table tiles leave as they are made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.functions.text import seeded_order
from siftrank.functions.vectors import dot, to_matrix
from siftrank.operators.blocks import block_files, buffered, dealt_files, read_block, read_other_texts, read_other_vectors, read_part, read_texts, read_vectors, text_files
from siftrank.session import BROADCAST_BYTES, SPLIT_BYTES, broadcast_if_small, cut_lineage, input_bytes, spread


@dataclass(frozen=True)
class SearchBudget:
    """Bounds of the block product."""

    query_bytes: int = BROADCAST_BYTES      # queries, with their carried columns, in one file
    document_bytes: int = BROADCAST_BYTES   # documents that a task keeps while files of queries go past, if there are several
    block_scores: int = 1 << 21             # scores held at once inside a task
    split_bytes: int = SPLIT_BYTES          # document bytes per task, to foresee the number of partials
    partials_per_query: int = 256           # partial results per query that one merge step takes
    held_hits: int = 1 << 18                # best documents that a task holds, of as many queries at a time as that allows
    part_bytes: int = 1 << 24               # vectors of documents in one part of the labelled product
    share_scores: int = 1 << 21             # scores of a share of the queries with a part, or, to rank them, with all documents
    ranked_documents: int = 1 << 22         # documents up to which a task ranks them for a query


BUDGET = SearchBudget()

SCORED = pa.schema([("qid", pa.int64()), ("did", pa.int64()), ("score", pa.float64()),
                    ("bucket", pa.int32())])


class _BestPerQuery:
    """Best k documents of every query over the blocks seen so far, ties by document id.

    Candidates above a query's floor are collected and cut back to k per query whenever they have
    doubled, so sorting stays a small part of the work.
    """

    def __init__(self, k: int, num_queries: int):
        self.k = k
        self.floor = np.full(num_queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.limit = 1 << 20

    def add(self, start: int, scores: np.ndarray, dids: np.ndarray) -> None:
        """Scores of the queries from number ``start`` on (rows) for some documents (columns). A score that is
        not finite neither sets a floor nor is kept."""
        finite = np.isfinite(scores)
        if not finite.all():
            scores = np.where(finite, scores, -np.inf)
        floor = self.floor[start:start + len(scores)]
        if scores.shape[1] > self.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        rows, cols = np.nonzero((scores >= floor[:, None]) & finite)
        if len(rows):
            self.parts.append((rows + start, dids[cols], scores[rows, cols]))
            self.held += len(rows)
        if self.held > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, d, s = (np.concatenate(columns) for columns in zip(*self.parts))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        counts = np.diff(np.r_[starts, len(q)])
        keep = np.arange(len(q)) - np.repeat(starts, counts) < self.k
        full = starts[counts >= self.k]
        self.floor[q[full]] = s[full + self.k - 1]
        best = q[keep], d[keep], s[keep]
        self.parts, self.held = [best], int(keep.sum())
        self.limit = max(1 << 20, 2 * self.held)
        return best


def _blocks(qmat: np.ndarray, dmat: np.ndarray, digits: int | None, block_scores: int):
    """``(first query, first document, scores)`` of tiles of at most ``block_scores`` scores."""
    docs = min(len(dmat), max(512, block_scores // max(1, len(qmat))))
    rows = max(1, block_scores // max(1, docs))
    for d in range(0, len(dmat), docs):
        for q in range(0, len(qmat), rows):
            scores = qmat[q:q + rows] @ dmat[d:d + docs].T
            if digits is not None:
                scores = np.round(scores, digits) + 0.0
            yield q, d, scores


def _rows(qids: np.ndarray, dids: np.ndarray, scores: np.ndarray, bucket: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qids, pa.int64()), pa.array(dids, pa.int64()), pa.array(scores, pa.float64()),
         pa.array(np.full(len(qids), bucket, np.int32))], schema=SCORED)


def _best_documents(qids, qmat, doc_batches, k, digits, block_scores, bucket):
    """Record batches with the best k documents per query."""
    best = _BestPerQuery(k, len(qids))
    for dids, dmat in doc_batches:
        for q, d, scores in _blocks(qmat, dmat, digits, block_scores):
            best.add(q, scores, dids[d:d + scores.shape[1]])
    q, d, s = best.cut()
    for start in range(0, len(q), 1 << 18):
        part = slice(start, start + (1 << 18))
        yield _rows(qids[q[part]], d[part], s[part], bucket)


def _all_documents(queries: pa.RecordBatch, qmat, doc_batches, digits, block_scores, schema):
    """Record batches with the score of every query and document, and the columns either side carries.
    Both sides have columns id, vector, then the carried ones."""
    for batch in doc_batches:
        for q, d, scores in _blocks(qmat, to_matrix(batch.column(1)), digits, min(block_scores, 1 << 18)):
            rows, cols = scores.shape
            of_query = pa.array(np.repeat(np.arange(q, q + rows), cols))
            of_doc = pa.array(np.tile(np.arange(d, d + cols), rows))
            yield pa.RecordBatch.from_arrays(
                [queries.column(0).take(of_query), batch.column(0).take(of_doc), pa.array(scores.ravel()),
                 *[c.take(of_query) for c in queries.columns[2:]],
                 *[c.take(of_doc) for c in batch.columns[2:]]], names=schema)


def _multiply(queries: pa.RecordBatch, qmat, doc_batches, k, digits, block_scores, bucket, names):
    filled = (b for b in doc_batches if b.num_rows)
    if queries.num_rows == 0:
        return
    if k is None:
        yield from _all_documents(queries, qmat, filled, digits, block_scores, names)
    else:
        matrices = ((b.column(0).to_numpy(zero_copy_only=False), to_matrix(b.column(1))) for b in filled)
        yield from _best_documents(queries.column(0).to_numpy(zero_copy_only=False), qmat, matrices, k, digits,
                                   block_scores, bucket)


def _multiply_shares(queries: pa.RecordBatch, held, k, digits, budget: SearchBudget, bucket, names):
    """``_multiply``, for a top-k by as many queries at a time as ``held_hits`` allows."""
    matrix = to_matrix(queries.column(1))
    share = max(1, queries.num_rows if k is None else budget.held_hits // k)
    for start in range(0, queries.num_rows, share):
        yield from _multiply(queries.slice(start, share), matrix[start:start + share], held, k, digits, budget.block_scores, bucket, names)


def _clean(df: DataFrame, key: str, vector: str, carry: Sequence[str] = ()) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("_id"), F.col(vector).alias("_vec"), *carry).dropna(
        subset=["_id", "_vec"])


def _scored_pairs(queries: DataFrame, docs: DataFrame, k: int | None, digits: int | None,
                  budget: SearchBudget, buckets: int = 1) -> DataFrame:
    """Partial top-k with bucket, or with ``k`` None all scores with the carried columns."""
    carried = queries.schema.fields[2:] + docs.schema.fields[2:]
    schema = T.StructType(
        [T.StructField("qid", T.LongType()), T.StructField("did", T.LongType()), T.StructField("score", T.DoubleType())]
        + ([T.StructField("bucket", T.IntegerType())] if k is not None else carried))
    files, n = block_files(queries, "_vec", budget.query_bytes)
    docs = spread(docs)
    if k is not None and n:
        # Partial results, k rows for each query and task, should not outgrow the documents that were read.
        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, input_bytes(docs) // (24 * k * n))
        docs = docs.coalesce(tasks) if tasks < 1 << 16 else docs
    names = schema.fieldNames()

    several = len(files) > 1 or k is not None and n > max(1, budget.held_hits // k)

    def multiply(batches):
        bucket = TaskContext.get().partitionId() % buckets
        # With one file, and few queries, the task's documents pass them as they come; else they are buffered and all files and shares pass them.
        for held in buffered(batches, budget.document_bytes) if several else [batches]:
            for file in files:
                yield from _multiply_shares(read_block(file), held, k, digits, budget, bucket, names)

    return docs.mapInArrow(multiply, schema)


def score_all(queries: DataFrame, docs: DataFrame, qid: str = "qid", did: str = "did",
              query_vector: str = "embedding", doc_vector: str = "embedding",
              digits: int | None = None, query_columns: Sequence[str] = (),
              doc_columns: Sequence[str] = (), budget: SearchBudget = BUDGET) -> DataFrame:
    """``(qid, did, score)`` of every query and document: as many rows as pairs. ``query_columns`` and
    ``doc_columns`` come along, so no attribute has to be joined to the product."""
    scored = _scored_pairs(_clean(queries, qid, query_vector, query_columns),
                           _clean(docs, did, doc_vector, doc_columns), None, digits, budget)
    return scored.withColumnsRenamed({"qid": qid, "did": did})


def score_labelled(queries: DataFrame, docs: DataFrame, labels: DataFrame, label: str, qid: str = "qid", did: str = "did",
                   query_vector: str = "embedding", doc_vector: str = "embedding", digits: int | None = None,
                   query_columns: Sequence[str] = (), doc_columns: Sequence[str] = (), rank: str | None = None,
                   budget: SearchBudget = BUDGET) -> DataFrame:
    """``(qid, did, score, label, …)`` of every query and document, with the carried columns. ``label`` is that of the listed pair, NULL where
    ``labels(qid, did, label)`` has none; a pair listed several times has a row for each. ``rank`` names a column of ranks as ``rank_all`` gives them.

    The product is neither shuffled nor written. Queries and labels are dealt by shares of the queries, labels in the order of the documents'
    parts; documents are files, and a task reads these part by part past the queries and labels of one share at a time. Ranks need the scores of a query
    with all documents in one task, so with more documents than ``ranked_documents`` the product is ranked by ``rank_all``.
    """
    own = cut_lineage(_clean(queries, qid, query_vector, query_columns))
    of_docs = cut_lineage(_clean(docs, did, doc_vector, doc_columns))
    number = own.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("ids"), F.max("n").alias("most")).first()
    files, parts = dealt_files(of_docs, "_vec", budget.part_bytes)
    rows = of_docs.count()
    ranked = rank is not None and rows * (number.most or 1) <= budget.ranked_documents
    per_share = max(1, budget.share_scores // max(1, rows if ranked else rows // parts))
    conf = queries.sparkSession
    tasks = max(int(conf.conf.get("spark.sql.shuffle.partitions")), 4 * conf.sparkContext.defaultParallelism)
    shares = max(1, min(number.ids, max(tasks, -(-number.ids // per_share))))
    groups = 1 if ranked else min(parts, -(-tasks // shares))  # of parts, where there are fewer queries than tasks

    share, part = (F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int") for c, n in (("_id", shares), ("_did", parts)))
    group = F.explode(F.when(F.col("_part") < 0, F.sequence(F.lit(0), F.lit(groups - 1))).otherwise(F.array(F.col("_part") % groups)))
    listed = labels.select(F.col(qid).cast("bigint").alias("_id"), F.col(did).cast("bigint").alias("_did"), F.col(label).alias("_label"))
    listed = listed.dropna(subset=["_id", "_did"]).withColumn("_part", part)
    sent = own.withColumn("_part", F.lit(-1)).unionByName(listed, allowMissingColumns=True).withColumn("_group", group)
    sent = sent.withColumn("_share", share * groups + F.col("_group")).drop("_group")
    used = min(shares * groups, tasks)
    laid = sent.withColumn("_task", F.col("_share") % used).repartitionById(used, "_task").sortWithinPartitions(
        "_share", "_part", "_id")

    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("did", T.LongType()), T.StructField("score", T.DoubleType()),
                           T.StructField("_label", labels.schema[label].dataType)]
                          + ([T.StructField("_rank", T.LongType())] if ranked else []) + own.schema.fields[2:] + of_docs.schema.fields[2:])
    carried, names = own.columns[2:], schema.fieldNames()

    def multiply(batches):
        for found in _shares(batches, files, groups):
            if ranked:
                yield from _ranked_share(*found, carried, digits, names)
            else:
                yield from _plain_share(*found, carried, digits, names)

    made = laid.mapInArrow(multiply, schema).withColumnsRenamed({"qid": qid, "did": did, "_label": label})
    if rank is None:
        return made
    return made.withColumn(rank, F.col("_rank").cast("int")).drop("_rank") if ranked else rank_all(made, qid, did, name=rank)


def _runs(batches):
    """``(share, part, rows)``: consecutive rows of one share and part together."""
    held, key = [], None
    for batch in batches:
        share, part = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_share", "_part"))
        keys = share << 32 | part + 1
        begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
        for begin, end in zip(begins, np.r_[begins[1:], len(keys)]):
            if held and keys[begin] != key:
                yield key >> 32, (key & 0xFFFFFFFF) - 1, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = int(keys[begin])
            held.append(batch.slice(begin, end - begin))
    if held:
        yield key >> 32, (key & 0xFFFFFFFF) - 1, pa.Table.from_batches(held).combine_chunks()


def _shares(batches, files, groups):
    """For each share its queries and an iterator over ``(listed pairs, document ids, matrix, carried columns)`` of the files of its group, part by part."""
    runs = _runs(batches)
    ahead = [next(runs, None)]

    def parts_of(share):
        for part in sorted(p for p in files if p % groups == share % groups):
            own = None
            while ahead[0] and ahead[0][0] == share and ahead[0][1] <= part:
                own = ahead[0][2] if ahead[0][1] == part else None
                ahead[0] = next(runs, None)
            for file in files[part]:
                yield own, *read_part(file)

    while ahead[0]:
        share, part, rows = ahead[0]
        ahead[0] = next(runs, None)
        if part < 0:  # else labels of a share without queries
            yield rows, parts_of(share)
            while ahead[0] and ahead[0][0] == share:
                ahead[0] = next(runs, None)


def _rounded_product(qmat: np.ndarray, dmat: np.ndarray, digits: int | None) -> np.ndarray:
    scores = qmat @ dmat.T
    return scores if digits is None else np.round(scores, digits) + 0.0


def _listed_places(qids: np.ndarray, dids: np.ndarray, own) -> tuple[np.ndarray, np.ndarray]:
    """Places in the product (row times columns plus column) of the listed pairs, ascending, and the number of each one's label. Both ids ascend."""
    if own is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    q, d = (own.column(c).to_numpy() for c in ("_id", "_did"))
    q_low, d_low = np.searchsorted(qids, q), np.searchsorted(dids, d)
    q_n, d_n = np.searchsorted(qids, q, "right") - q_low, np.searchsorted(dids, d, "right") - d_low
    pair = np.repeat(np.arange(len(q)), q_n * d_n)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(q_n * d_n) - q_n * d_n, q_n * d_n)
    places = (q_low[pair] + step // d_n[pair]) * len(dids) + d_low[pair] + step % d_n[pair]
    order = np.argsort(places, kind="stable")
    return places[order], pair[order]


def _with_labels(begin: int, end: int, places: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places from ``begin`` to ``end``, those listed several times as often, and the number of each one's label, -1 for none."""
    low, high = np.searchsorted(places, (begin, end))
    often = np.bincount(places[low:high] - begin, minlength=end - begin)
    rows = np.repeat(np.arange(end - begin), np.maximum(often, 1))
    of_row = np.full(len(rows), -1)
    of_row[often[rows] > 0] = numbers[low:high]
    return rows + begin, of_row


def _labels(own, of_row: np.ndarray, kind: pa.DataType) -> pa.Array:
    if own is None:
        return pa.nulls(len(of_row), kind)
    return own.column("_label").combine_chunks().take(pa.array(of_row, mask=of_row < 0))


def _plain_share(queries, found, carried, digits, names):
    """Record batches of a share's product, made as its parts go past."""
    qids, qmat = queries.column("_id").to_numpy(), to_matrix(queries.column("_vec"))
    for own, dids, dmat, of_docs in found:
        places, numbers = _listed_places(qids, dids, own)
        rows = max(1, (1 << 18) // len(dids))
        for q in range(0, len(qids), rows):
            scores = _rounded_product(qmat[q:q + rows], dmat, digits).ravel()
            for begin in range(0, len(scores), 1 << 18):
                at, of_row = _with_labels(q * len(dids) + begin, q * len(dids) + min(begin + (1 << 18), len(scores)), places, numbers)
                of_query, of_doc = at // len(dids), at % len(dids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[of_query]), pa.array(dids[of_doc]), pa.array(scores[at - q * len(dids)]), _labels(own, of_row, queries.schema.field("_label").type),
                     *[queries.column(c).combine_chunks().take(pa.array(of_query)) for c in carried],
                     *[c.take(pa.array(of_doc)) for c in of_docs]], names=names)


def _ranked_share(queries, found, carried, digits, names):
    """Record batches of a share's product in the order of the ranks: by query, score descending, document."""
    qids, qmat = queries.column("_id").to_numpy(), to_matrix(queries.column("_vec"))
    columns, attributes, labels, docs, listed = [], [], [], 0, 0
    for own, dids, dmat, of_docs in found:
        at, of_row = _with_labels(0, len(qids) * len(dids), *_listed_places(qids, dids, own))
        scores = _rounded_product(qmat, dmat, digits).ravel()[at]
        columns.append((at // len(dids), dids[at % len(dids)], scores, at % len(dids) + docs, np.where(of_row < 0, -1, of_row + listed)))
        attributes.append(of_docs)
        docs += len(dids)
        if own is not None:
            labels.append(own.column("_label").combine_chunks())
            listed += own.num_rows
    if not columns:
        return
    of_query, did, score, of_doc, of_row = (np.concatenate(c) for c in zip(*columns))
    of_docs = [pa.concat_arrays(c) for c in zip(*attributes)]
    own = pa.table({"_label": pa.concat_arrays(labels)}) if labels else None
    group = qids[of_query]
    order = np.lexsort((did, -score, group))
    group = group[order]
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    rank = np.arange(len(group)) - np.repeat(begins, np.diff(np.r_[begins, len(group)])) + 1
    for begin in range(0, len(order), 1 << 18):
        at = order[begin:begin + (1 << 18)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(qids[of_query[at]]), pa.array(did[at]), pa.array(score[at]), _labels(own, of_row[at], queries.schema.field("_label").type),
             pa.array(rank[begin:begin + (1 << 18)]),
             *[queries.column(c).combine_chunks().take(pa.array(of_query[at])) for c in carried],
             *[c.take(pa.array(of_doc[at])) for c in of_docs]], names=names)


def top_k(queries: DataFrame, docs: DataFrame, k: int, qid: str = "qid", did: str = "did",
          query_vector: str = "embedding", doc_vector: str = "embedding",
          digits: int | None = None, budget: SearchBudget = BUDGET) -> DataFrame:
    """``(qid, did, score, rank)`` of the k best documents per query; fewer when there are fewer.

    Only finite scores count: NULL vectors, and pairs whose product is NaN or infinite, are never hits
    (``quality.unclean_vectors`` lists the vectors that cause them). Keys are integers; equal scores rank by document key. Every document task leaves k rows per query;
    when many tasks are expected these are merged in two steps.
    """
    tasks = input_bytes(docs) // budget.split_bytes + 1
    buckets = min(4096, math.isqrt(tasks)) if tasks > budget.partials_per_query else 1
    partial = _scored_pairs(_clean(queries, qid, query_vector), _clean(docs, did, doc_vector), k,
                            digits, budget, buckets)
    best_first = [F.desc("score"), F.asc("did")]
    if buckets > 1:
        first = W.partitionBy("qid", "bucket").orderBy(*best_first)
        partial = partial.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k)
    ranked = partial.select(
        "qid", "did", "score", F.row_number().over(W.partitionBy("qid").orderBy(*best_first)).alias("rank")
    ).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(qid), F.col("did").alias(did), "score", "rank")


#: Bands of scores, and rows of a (query, band) above which it is cut further.
BANDS_PER_DEVIATION = 64
MOST_BANDS = 4096
DENSE_ROWS = 1 << 20
DENSE_CUTS = 4096


def rank_all(run: DataFrame, qid: str = "qid", did: str = "did", score: str = "score",
             name: str = "rank_full", dense_rows: int = DENSE_ROWS) -> DataFrame:
    """Rank of every document of every query, ties by document. ``run`` is written once, as a product should be made once.

    Ranks come from counts: scores are cut into bands (shares of their deviation, the same for all queries), counts per (query, band) say how many
    documents lie in better bands, and only the order inside a band is worked out on rows. A (query, band) of more than ``dense_rows`` rows is
    cut further, by score or, if all its scores are equal, by document; there are at most a millionth as many of these as pairs, so
    their table is small. The product is shuffled once, by (query, band, cut); no ranges of it are sampled. Ranks descend as Spark
    orders scores: NULL scores come first, NaN last.
    """
    numbers = F.when(~F.isnan(score), F.col(score).cast("double"))
    laid = cut_lineage(run)
    shape = laid.agg(F.avg(numbers).alias("mean"), F.stddev_pop(numbers).alias("width"), F.min(did).alias("low"), F.max(did).alias("high"),
                     F.count(F.lit(1)).alias("n")).first()
    mean, width = shape.mean or 0.0, shape.width or 1.0
    if not (math.isfinite(mean) and math.isfinite(width)):
        mean, width = 0.0, 1.0  # infinite scores: any bands will do
    place = F.floor(F.greatest(F.least((numbers - mean) / width * BANDS_PER_DEVIATION, F.lit(MOST_BANDS)), F.lit(-MOST_BANDS)))
    band = F.when(F.col(score).isNull(), MOST_BANDS + 1).when(F.isnan(score), -MOST_BANDS - 1).otherwise(place.cast("int"))
    banded = laid.withColumn("_band", -band)  # ascending from the best
    sizes = banded.groupBy(qid, "_band").agg(F.count(F.lit(1)).alias("_n"), F.min(score).alias("_low"), F.max(score).alias("_high"))
    dense = cut_lineage(sizes.where(F.col("_n") > max(dense_rows, shape.n // 1_000_000)))
    if dense.isEmpty():
        banded = banded.withColumn("_cut", F.lit(0))
    else:
        cuts = F.broadcast(dense.select(F.col(qid).alias("_q"), F.col("_band").alias("_b"), "_low", "_high"))  # a millionth of the pairs
        step = F.when(F.col("_low") < F.col("_high"), (F.col("_high") - F.col(score)) / (F.col("_high") - F.col("_low"))).otherwise(
            (F.col(did) - shape.low) / max(shape.high - shape.low, 1))
        banded = banded.join(cuts, F.col(qid).eqNullSafe(F.col("_q")) & (F.col("_band") == F.col("_b")), "left").select(
            *run.columns, "_band", F.when(F.col("_b").isNotNull() & step.isNotNull(), F.floor(step * DENSE_CUTS)).otherwise(0).cast("int").alias("_cut"))
    better = W.partitionBy(qid).orderBy("_band", "_cut").rowsBetween(W.unboundedPreceding, -1)
    counts = banded.groupBy(qid, "_band", "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(qid).alias("_q"), F.col("_band").alias("_b"), F.col("_cut").alias("_c"),
                           F.coalesce(F.sum("_n").over(better), F.lit(0)).alias("_before"))
    same = F.col(qid).eqNullSafe(F.col("_q")) & (F.col("_band") == F.col("_b")) & (F.col("_cut") == F.col("_c"))
    inside = W.partitionBy(qid, "_band", "_cut").orderBy(F.desc_nulls_first(score), F.asc(did))
    # NaN is above all numbers for Spark; it has a band of its own, so that only ties among NaN are ordered here.
    return banded.join(before, same).select(*run.columns, (F.col("_before") + F.row_number().over(inside)).alias(name))


def score_candidates(pairs: DataFrame, queries: DataFrame, docs: DataFrame, qid: str = "qid",
                     did: str = "did", vector: str = "embedding", digits: int | None = None,
                     name: str = "score", budget: SearchBudget = BUDGET) -> DataFrame:
    """Score of the listed pairs only; the rest of the product is never formed.

    Where keys are numbers no vector moves with a pair. Both sides are written once in files of a byte budget, dealt by a hash of the key, and a
    task reads the files its pairs need. If each side is one file, pairs stay where they are, else they are shuffled once, by the files of both
    sides. A pair that several vectors answer has a row for each combination, as in a join.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    if not all(df.schema[c].dataType.simpleString() in whole for df, c in ((pairs, qid), (pairs, did), (queries, qid), (docs, did))):
        joined = pairs.join(docs.select(did, F.col(vector).alias("_dv")), did).join(queries.select(qid, F.col(vector).alias("_qv")), qid)
        scored = joined.select(*pairs.columns, dot("_qv", "_dv").alias(name))
    else:
        q_files, q_parts = dealt_files(queries.select(F.col(qid).cast("bigint").alias("_id"), F.col(vector).alias("_vec")), "_vec", budget.query_bytes)
        d_files, d_parts = dealt_files(docs.select(F.col(did).cast("bigint").alias("_id"), F.col(vector).alias("_vec")), "_vec", budget.document_bytes)

        @F.arrow_udf("array<double>")
        def products(q_part: pa.Array, q: pa.Array, d_part: pa.Array, d: pa.Array) -> pa.Array:
            return _listed_products(q_part, q, d_part, d, q_files, d_files)

        left, right = (F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(n)).cast("int") for c, n in ((qid, q_parts), (did, d_parts)))
        laid = pairs
        if q_parts * d_parts > 1:
            # Few cells of files are dealt on to several tasks each; a task meets each cell's pairs together.
            shares = max(1, 2 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // (q_parts * d_parts))
            laid = laid.repartition(left, right, F.pmod(F.xxhash64(qid, did), F.lit(shares))).sortWithinPartitions(left, right)
        of_pair = products(left, F.col(qid).cast("bigint"), right, F.col(did).cast("bigint"))
        scored = laid.select(*pairs.columns, F.explode(of_pair).alias(name))
    return scored if digits is None else scored.withColumn(name, F.round(name, digits))


def _listed_products(q_part: pa.Array, q: pa.Array, d_part: pa.Array, d: pa.Array, q_files, d_files) -> pa.Array:
    """For each pair the products of the vectors with its keys: none, one, or as many as keys repeat. NULL where a vector is NULL."""
    known = pc.and_(q.is_valid(), d.is_valid()).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(known)
    qs, ds = (x.take(pa.array(at)).to_numpy(zero_copy_only=False) for x in (q, d))
    qp, dp = (x.take(pa.array(at)).to_numpy(zero_copy_only=False) for x in (q_part, d_part))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cells = qp.astype(np.int64) << 32 | dp
    for cell in np.unique(cells):
        mine = np.flatnonzero(cells == cell)
        for q_file in q_files.get(int(cell) >> 32, ()):
            for d_file in d_files.get(int(cell) & 0xFFFFFFFF, ()):
                (q_ids, q_mat, q_known), (d_ids, d_mat, d_known) = read_vectors(q_file), read_other_vectors(d_file)
                q_low, d_low = np.searchsorted(q_ids, qs[mine]), np.searchsorted(d_ids, ds[mine])
                q_n, d_n = np.searchsorted(q_ids, qs[mine], "right") - q_low, np.searchsorted(d_ids, ds[mine], "right") - d_low
                pair = np.repeat(np.arange(len(mine)), q_n * d_n)
                step = np.arange(len(pair)) - np.repeat(np.cumsum(q_n * d_n) - q_n * d_n, q_n * d_n)
                left, right = q_low[pair] + step // d_n[pair], d_low[pair] + step % d_n[pair]
                both = q_known[left] & d_known[right]
                if both.any() and q_mat.shape[1] != d_mat.shape[1]:
                    raise ValueError(f"vectors differ in length: {q_mat.shape[1]} and {d_mat.shape[1]}")
                values = np.full(len(pair), np.nan)
                for begin in range(0, len(pair), 1 << 13):
                    part = slice(begin, begin + (1 << 13))
                    if both[part].any():
                        values[part] = np.einsum("ij,ij->i", q_mat[left[part]], d_mat[right[part]])
                found.append((at[mine[pair]], values, both))
    rows, values, sound = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0), np.empty(0, bool))
    order = np.argsort(rows, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(q)))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order], mask=~sound[order]))


def with_texts(pairs: DataFrame, queries: DataFrame, docs: DataFrame, qid: str = "qid", did: str = "did", question: str = "question",
               chunk: str = "chunk_text", budget: SearchBudget = BUDGET) -> DataFrame:
    """``(qid, did)`` of each pair that has both texts, with these. Keys are numbers that do not repeat in ``queries`` or ``docs``.

    No text is shuffled with a pair: both sides are written once in files of a byte budget, as ``score_candidates`` writes vectors, and texts are looked up
    in the task that uses them.
    """
    q_files, q_parts = text_files(queries.select(F.col(qid).cast("bigint").alias("_id"), question), question, budget.query_bytes)
    d_files, d_parts = text_files(docs.select(F.col(did).cast("bigint").alias("_id"), chunk), chunk, budget.document_bytes)
    left, right = (F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(n)).cast("int") for c, n in ((qid, q_parts), (did, d_parts)))
    laid = pairs.select(F.col(qid).cast("bigint"), F.col(did).cast("bigint"), left.alias("_q"), right.alias("_d"))
    if q_parts * d_parts > 1:
        shares = max(1, 2 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // (q_parts * d_parts))
        laid = laid.withColumn("_share", F.pmod(F.xxhash64(qid, did), F.lit(shares))).repartition("_q", "_d", "_share").sortWithinPartitions(
            "_q", "_d").drop("_share")

    def look_up(batches):
        for batch in batches:
            q, d, qp, dp = (c.to_numpy(zero_copy_only=False) for c in batch.drop_null().columns)
            cells = qp.astype(np.int64) << 32 | dp
            for cell in np.unique(cells):
                mine = np.flatnonzero(cells == cell)
                q_ids, q_texts = read_texts(tuple(q_files.get(int(cell) >> 32, ())))
                d_ids, d_texts = read_other_texts(tuple(d_files.get(int(cell) & 0xFFFFFFFF, ())))
                mine = mine[np.isin(q[mine], q_ids) & np.isin(d[mine], d_ids)]
                for begin in range(0, len(mine), 512):
                    at = mine[begin:begin + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q[at]), pa.array(d[at]), q_texts.take(pa.array(np.searchsorted(q_ids, q[at]))).cast(pa.string()),
                         d_texts.take(pa.array(np.searchsorted(d_ids, d[at]))).cast(pa.string())], names=[qid, did, question, chunk])

    return laid.mapInArrow(look_up, f"`{qid}` bigint, `{did}` bigint, `{question}` string, `{chunk}` string")


def with_context(hits: DataFrame, chunks: DataFrame, context: int = 1, file: str = "file_name",
                 pos: str = "pos", text: str = "text") -> DataFrame:
    """Add to each hit the text of the chunks around it in its file, joined without separator.

    A hit asks for at most ``2 * context + 1`` chunks by (file, position), so no file is ever
    gathered in one task. When a count shows the hits to be few they are broadcast.
    """
    hits = cut_lineage(hits.withColumn("_hit", F.monotonically_increasing_id()))
    wanted = hits.select(
        "_hit", F.col(file).alias("_file"),
        F.explode(F.sequence(F.col(pos) - context, F.col(pos) + context)).alias("_pos"))
    texts = chunks.select(F.col(file).alias("_file"), F.col(pos).cast("bigint").alias("_pos"),
                          F.col(text).alias("_text"))
    # Only numbers and file names travel to the texts; what the hits carry is joined to the result.
    found = texts.join(broadcast_if_small(wanted, row_bytes=256), ["_file", "_pos"])
    near = found.groupBy("_hit").agg(F.array_sort(F.collect_list(F.struct("_pos", "_text"))).alias("_near"))
    return hits.join(near, "_hit").drop("_hit").withColumn("context", F.array_join(F.col("_near._text"), "")).drop("_near")


def sample_outside_top(queries: DataFrame, docs: DataFrame, top: DataFrame, k: int, n: int, seed: int,
                       qid: str = "qid", ord_col: str = "d_ord", num_docs: int | None = None) -> DataFrame:
    """``n`` seeded random documents per query that are not among its ``top`` hits, fewer if there are fewer.

    ``docs`` is numbered densely from 0 and ``top`` has ``(qid, d_ord)`` with at most ``k`` rows per
    query. Each draw is a digest of (seed, query, draw number), all 60 bits of it, modulo the number of documents;
    repeats and hits are rejected and the first ``n`` that are left are taken. The draws of all queries together grow with
    queries times (n + k), whatever the corpus size. A corpus of less than four times (n + k) documents is ordered by digest.
    """
    total = docs.count() if num_docs is None else num_docs
    if total >= 4 * (n + k):
        # Each draw is new with probability 3/4 or more: twice as many and 40 more fall short once in 1e9 or less.
        asked = queries.select(qid, F.explode(F.sequence(F.lit(0), F.lit(2 * (n + k) + 39))).alias("step"))
        number = F.conv(F.substring(seeded_order(seed, qid, "step"), 1, 15), 16, 10).cast("bigint") % total
        drawn = asked.select(qid, number.alias(ord_col), "step").groupBy(qid, ord_col).agg(F.min("step").alias("step"))
    else:
        every = queries.select(qid, F.explode(F.sequence(F.lit(0), F.lit(max(total, 1) - 1))).alias("_at")).where(
            F.col("_at") < total)
        drawn = every.select(qid, F.col("_at").cast("bigint").alias(ord_col), seeded_order(seed, qid, "_at").alias("step"))
    free = drawn.join(top.select(qid, ord_col), [qid, ord_col], "left_anti")
    chosen = free.withColumn("draw", F.row_number().over(W.partitionBy(qid).orderBy("step")))
    return chosen.where(F.col("draw") <= n).select(qid, ord_col, "draw")
