"""Tables of a folder, read by Spark alone."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.session import broadcast_if_small


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches between Spark and Python by bytes: rows of long texts make the default of 10,000 rows
    a matter of hundreds of MB in each task. A setting that the session's owner has made stays."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)),):
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


def with_flag(df: DataFrame, ids: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """``df`` with a boolean column: is its key in ``ids``? Ids are broadcast if a count shows that they are few. Otherwise rows are
    joined by shuffle; those without a key, which match nothing, are spread over 1,000 places of their own."""
    ids = ids.where(F.col(key).isNotNull()).select(F.col(key).alias("_id")).distinct().select("_id", F.lit(0).alias("_at"), F.lit(True).alias(name))
    at = F.when(F.col(key).isNull(), 1 + F.floor(F.rand(7) * 1000).cast("int")).otherwise(0)
    ids = broadcast_if_small(ids, 24)
    joined = df.withColumn("_at", at).alias("a").join(ids.alias("b"), (F.col(f"a.{key}") == F.col("b._id")) & (F.col("a._at") == F.col("b._at")), "left")
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], F.coalesce(F.col(f"b.{name}"), F.lit(False)).alias(name))
