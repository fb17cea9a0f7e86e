"""Readers. Every cell is read as text unless the file carries types (Parquet)."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.functions.text import content_key
from siftrank.session import cut_lineage
from siftrank.sources.records import csv_records, json_records, worth_splitting

CORPUS_SCHEMA = "file_name string, text_data string"
CACHE_SCHEMA = "pair_key string, thought string, response string"


def probe_csv(spark: SparkSession, path: str) -> tuple[str, bool, bool]:
    """Encoding, whether cells hold line breaks, and whether lines end in CR and LF, in one pass over the lines. UTF-8 when
    every line is valid UTF-8, else ISO-8859-1, which decodes any byte. A line with an odd number of quotes breaks inside a cell."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    row = spark.read.option("lineSep", "\n").text(path).agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("bytes"), F.bool_or(quotes % 2 == 1).alias("breaks"),
        F.bool_or(F.endswith("value", F.lit("\r"))).alias("returns")).first()
    return "ISO-8859-1" if row.bytes else "UTF-8", bool(row.breaks), bool(row.returns)


def detect_encoding(spark: SparkSession, path: str) -> str:
    return probe_csv(spark, path)[0]


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, empty_as_null: bool = True,
             multi_line: bool | None = None, partitions: int | None = None, split: bool | None = None) -> DataFrame:
    """CSV with a header, all columns text. ``encoding`` and ``multi_line`` (line breaks inside quotes) are found by a
    scan unless given. Files without such breaks split over tasks. With them a file is one task, unless ``split``, by default
    where a file is longer than one task should read or CR ends its lines, too, which the plain reader leaves in the last cell:
    then its records are put together from lines read by many tasks. A gzip file is read by one task: ``partitions`` spreads
    its rows after the scan."""
    if encoding is None or multi_line is None:
        found, breaks, returns = probe_csv(spark, path)
        split = split if split is not None else returns or None
        encoding, multi_line = encoding or found, breaks if multi_line is None else multi_line
    options = {"encoding": encoding, "multiLine": multi_line, "quote": '"', "escape": '"', "emptyValue": "",
               "nullValue": "" if empty_as_null else "\x00"}
    if multi_line and worth_splitting(spark, path, split):
        df = _split_csv(spark, path, encoding, options)
    else:
        df = spark.read.options(header=True, inferSchema=False, **options).csv(path)
    # A byte order mark belongs to the file, not to the name of its first column.
    df = df.toDF(*[c.lstrip("﻿").removeprefix("ï»¿").strip('"') if i == 0 else c
                   for i, c in enumerate(df.columns)])
    df = df if empty_as_null else fill_text(df)
    return df.repartition(partitions) if partitions else df


def _split_csv(spark: SparkSession, path: str, encoding: str, options: Mapping) -> DataFrame:
    """The rows of CSV files by records. The first record of each file is its header, the same in all."""
    records = cut_lineage(csv_records(spark, path, encoding))
    headers = records.groupBy("file").agg(F.min(F.struct("block", "no")).alias("at")).select("file", "at.*")
    place = ["file", "block", "no"]
    header = records.join(headers.orderBy("file").limit(1), place).select("text").first()
    if header is None:
        return spark.createDataFrame([], T.StructType([]))
    columns = _column_names(next(csv.reader(io.StringIO(header.text))))
    schema = ", ".join("`{}` string".format(c.replace("`", "``")) for c in columns)
    texts = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "encoding"}
    return records.join(headers, place, "left_anti").select(F.from_csv("text", schema, texts).alias("row")).select("row.*")


def _column_names(cells: list[str]) -> list[str]:
    """Names of header cells: empty ones by their place, repeated ones with their place added."""
    often = Counter(c.lower() for c in cells)
    return [f"_c{i}" if not c else f"{c}{i}" if often[c.lower()] > 1 else c for i, c in enumerate(cells)]


def fill_text(df: DataFrame) -> DataFrame:
    """Missing text becomes the empty text."""
    return df.fillna("", subset=[f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])


def read_table(spark: SparkSession, path: str, empty_as_null: bool = True, **options) -> DataFrame:
    """Table by file extension: .csv, .csv.gz, .json (array), .jsonl, .parquet."""
    name = path.rstrip("/").lower()
    if name.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, empty_as_null=empty_as_null, **options)
    if name.endswith((".jsonl", ".jsonl.gz")):
        df = spark.read.option("primitivesAsString", True).json(path)
    elif name.endswith(".json"):
        df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    elif name.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported file: {path}")
    return df if empty_as_null else fill_text(df)


def read_models(spark: SparkSession, specs: Mapping[str, str] | list[str], **options) -> DataFrame:
    """Score tables of several models as one table with a ``model`` column. ``specs`` maps names to
    paths, or lists ``name=path`` texts."""
    if not isinstance(specs, Mapping):
        specs = dict(spec.split("=", 1) for spec in specs)
    tables = [read_table(spark, path, **options).withColumn("model", F.lit(name))
              for name, path in specs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_corpus(spark: SparkSession, path: str, lines: bool | None = None, split: bool | None = None) -> DataFrame:
    """``(file_name, text_data)`` from JSON lines, which split over tasks, or from a JSON array, which a path that ends
    in .json is taken for unless ``lines`` says otherwise. An array is read by one task, unless ``split``, by default where a
    file is longer than one task should read."""
    if lines is None:
        lines = not path.rstrip("/").lower().endswith((".json", ".json.gz"))
    if not lines and worth_splitting(spark, path, split):
        return json_records(spark, path).select(F.from_json("text", CORPUS_SCHEMA).alias("row")).select("row.*")
    return spark.read.schema(CORPUS_SCHEMA).option("multiLine", not lines).json(path)


def read_store(spark: SparkSession, path: str, schema: str | None = None, missing_ok: bool = False) -> DataFrame:
    """Chunk store, progress, reply cache or earlier output; an absent one is an error, or empty."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" and "UNABLE_TO_INFER_SCHEMA" not in (error.getCondition() or ""):
            raise
        if not missing_ok:
            raise FileNotFoundError(f"no store at {path}") from error
        return spark.createDataFrame([], schema)


def read_reply_cache(spark: SparkSession, path: str) -> DataFrame:
    return read_store(spark, path, CACHE_SCHEMA, missing_ok=True)


def _json_replies(spark: SparkSession, path: str) -> DataFrame:
    """(key, thought, response) of files with one JSON object ``{key: [thought, reply]}`` each. A key that repeats in a file
    keeps its last entry. Each entry is read on its own, so a large file takes many tasks."""
    one = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,array<string>>")
    entries = json_records(spark, path).select("file", "block", "no", F.explode(one))
    last = entries.groupBy("file", F.sha2("key", 256).alias("digest")).agg(
        F.max_by(F.struct("key", "value"), F.struct("block", "no")).alias("entry"))
    return last.select("entry.key", F.col("entry.value")[0].alias("thought"), F.col("entry.value")[1].alias("response"))


def count_json_entries(spark: SparkSession, path: str) -> int:
    """Entries of JSON object files ``{key: [thought, reply]}``."""
    return _json_replies(spark, path).count()


def read_json_reply_cache(spark: SparkSession, path: str) -> DataFrame:
    """Reply cache kept as JSON objects ``{"[question, chunk]": [thought, reply]}``."""
    pair = F.from_json("key", "array<string>")
    return _json_replies(spark, path).select(content_key(pair[0], pair[1]).alias("pair_key"), "thought", "response")
