"""An evaluation index that grows by batches of judged rows; ids once given never move."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.functions.text import content_key, strip_long
from siftrank.operators.index import EvaluationIndex, TextTables, _first_texts, _id, _Numbered, _numbered_rows, _small, clean_pairs
from siftrank.operators.prefix import positions
from siftrank.operators.quality import require_columns
from siftrank.session import broadcast_if_small, cut_lineage, lineage_scope
from siftrank.sources.readers import read_store

_TEXTS = "text_key string, ord bigint, text string, batch int"
_JUDGED = "q_ord bigint, d_ord bigint, relevant int, top_label int, first_label int, first_row bigint, batch int"


def _summed(narrow: DataFrame, *keys: str) -> DataFrame:
    """One row per pair of a batch."""
    return narrow.groupBy(*keys).agg(
        F.max((F.col("label") == 1).cast("int")).alias("relevant"), F.max("label").alias("top_label"),
        F.min_by("label", "row_no").alias("first_label"), F.min("row_no").alias("first_row"))


class GrowingIndex:
    """Dictionaries of questions and of texts, and judged pairs summed up by batch, as tables with a folder per batch.

    Batches are numbered from 0. A batch reads its own rows and the digests in the dictionaries, no rows of earlier batches. New texts
    are numbered after the known ones, in the order of their first row, whatever their labels are, as a later batch may
    make a question relevant. The judged pairs are written last; a batch counts from then on, and the last batch, or one that failed, can
    be added again in place of itself.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        return read_store(self.spark, f"{self.folder}/{name}", schema, missing_ok=True)

    def batches(self) -> int:
        """Number of the batches added."""
        last = self._table("judged", _JUDGED).agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def add(self, df: DataFrame | TextTables, row_no: str, batch: int, query_col: str = "Question", doc_col: str = "chunk_text",
            label_col: str = "relevance_label") -> None:
        """Add judged rows. Row numbers order the rows of one batch. Of ``TextTables`` no text, and no digest, is joined to a row."""
        require_columns(df.rows if isinstance(df, TextTables) else df,
                        [label_col, row_no] + ([*df.question_on, *df.chunk_on] if isinstance(df, TextTables) else [query_col, doc_col]))
        if not max(0, self.batches() - 1) <= batch <= self.batches():
            raise ValueError(f"batch {batch} is not the next one, {self.batches()}, or the last one again")
        with lineage_scope(self.spark):  # what the batch needs on its way
            if isinstance(df, TextTables):
                self._add_numbered(df, row_no, batch, query_col, doc_col, label_col)
            else:
                self._add_rows(df, row_no, batch, query_col, doc_col, label_col)

    def _add_numbered(self, df: TextTables, row_no: str, batch: int, query_col: str, doc_col: str, label_col: str) -> None:
        pairs, questions, chunks = _numbered_rows(df, row_no, query_col, doc_col, label_col)
        narrow = cut_lineage(pairs)
        for name, side in (("queries", questions), ("docs", chunks)):
            self._learn_numbered(name, narrow, side, batch)
        pairs = _summed(narrow, "q_no", "d_no")
        for name, side, number in (("queries", questions, "q_ord"), ("docs", chunks, "d_ord")):
            known = self._known(name, batch).select(F.col("text_key").alias("_key"), F.col("ord").alias(number))
            ids = cut_lineage(side.keys.select("_key", side.no).join(known, "_key").select(side.no, number))
            pairs = pairs.join(_small(ids), side.no).drop(side.no)
        pairs.write.mode("overwrite").parquet(f"{self.folder}/judged/batch={batch}")

    def _add_rows(self, df: DataFrame, row_no: str, batch: int, query_col: str, doc_col: str, label_col: str) -> None:
        narrow = cut_lineage(clean_pairs(df, query_col, doc_col, label_col, row_no).select(
            content_key("question").alias("q_key"), content_key("chunk_text").alias("d_key"), "label", "row_no"))
        rows = df.dropna(subset=[query_col, doc_col, label_col]).withColumn("first_row", F.col(row_no).cast("bigint"))
        for name, key, text in (("queries", "q_key", query_col), ("docs", "d_key", doc_col)):
            self._learn(name, narrow.select(F.col(key).alias("text_key"), "row_no"), rows.select(text, "first_row"), text, batch)
        pairs = _summed(narrow, "q_key", "d_key")
        for name, key, number in (("queries", "q_key", "q_ord"), ("docs", "d_key", "d_ord")):
            known = self._known(name, batch).select(F.col("text_key").alias(key), F.col("ord").alias(number))
            pairs = pairs.join(known, key).drop(key)
        pairs.write.mode("overwrite").parquet(f"{self.folder}/judged/batch={batch}")

    def _known(self, name: str, last: int) -> DataFrame:
        return self._table(name, _TEXTS).where(F.col("batch") <= last)

    def _learn(self, name: str, keys: DataFrame, rows: DataFrame, text: str, batch: int) -> None:
        """Write the texts of a batch that no earlier batch has."""
        known = self._known(name, batch - 1)
        begin = known.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
        firsts = keys.groupBy("text_key").agg(F.min("row_no").alias("first_row")).join(
            known.select("text_key"), "text_key", "left_anti")
        numbered = cut_lineage(positions(firsts, ["first_row", "text_key"], "ord", start=begin))
        found = _first_texts(rows, text, content_key(strip_long(text)), numbered.withColumnRenamed("text_key", "_key"), "ord")
        found.select(F.col("_own").alias("text_key"), "ord", strip_long(text).alias("text")).write.mode("overwrite").parquet(
            f"{self.folder}/{name}/batch={batch}")

    def _learn_numbered(self, name: str, narrow: DataFrame, side: _Numbered, batch: int) -> None:
        """``_learn`` by the numbers of the texts."""
        known = self._known(name, batch - 1)
        begin = known.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
        firsts = narrow.groupBy(side.no).agg(F.min("row_no").alias("first_row")).join(
            side.keys.select(side.no, F.col("_key").alias("text_key")), side.no).join(known.select("text_key"), "text_key", "left_anti")
        numbered = cut_lineage(positions(firsts, ["first_row", "text_key"], "ord", start=begin))
        side.fetch(numbered.select(side.no, "text_key", "ord")).select("text_key", "ord", F.col(side.text).alias("text")).write.mode(
            "overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def index(self, positive_rule: str = "eq1") -> EvaluationIndex:
        """The index of all batches: as of ``build_index`` over their rows in order of arrival, but for the numbers, which
        count all texts. ``first_row`` is a row of the first batch that has the pair."""
        top = {"eq1": F.col("top_label") == 1, "ge1": F.col("top_label") >= 1}[positive_rule]
        arrival = F.struct("batch", "first_row")
        merged = cut_lineage(self._table("judged", _JUDGED).groupBy("q_ord", "d_ord").agg(
            F.max("relevant").alias("relevant"), F.max("top_label").alias("top_label"),
            F.min_by("first_label", arrival).alias("first_label"), F.min(arrival).alias("at")))
        kept = cut_lineage(merged.groupBy("q_ord").agg(F.max("top_label").alias("top_label")).where(top).select("q_ord"))
        judged = cut_lineage(merged.join(broadcast_if_small(kept, 16), "q_ord").select(
            "q_ord", "d_ord", _id("Q", "q_ord").alias("qid"), _id("D", "d_ord").alias("did"),
            "relevant", "first_label", F.col("at.first_row").alias("first_row")))
        return EvaluationIndex(self._texts("queries", kept, "q_ord", "Q", "qid", "question"),
                               self._texts("docs", judged.select("d_ord").distinct(), "d_ord", "D", "did", "chunk_text"), judged)

    def _texts(self, name: str, kept: DataFrame, number: str, letter: str, id_name: str, text: str) -> DataFrame:
        every = self._table(name, _TEXTS).withColumnRenamed("ord", number)
        return every.join(broadcast_if_small(kept, 16), number, "left_semi").select(
            number, _id(letter, number).alias(id_name), F.col("text").alias(text))
