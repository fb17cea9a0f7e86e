"""Quality rules: plain counts, and a log-likelihood ratio of hashed n-grams. DataFrame functions only.

Words and pairs of neighbouring words are hashed into ``buckets`` numbers. Two multinomials over them are counted in one
pass over all texts: one of the whole corpus (raw), one of the documents that the labels call good (trusted). A document's score
is the mean of log(p_trusted / p_raw) over its n-grams, so its length doesn't matter. A document passes if
its score is at least the mean of the trusted documents less ``DEVIATIONS`` standard deviations; by Cantelli's inequality
that rejects at most one in 1 + DEVIATIONS ** 2 of them, however their scores are spread. Weights and scores are whole millionths, so
sums, threshold and verdicts are the same on any partitioning.

NULL counts as an empty text: no words, all counts 0, no score, failed by rule. Rows with the same id, and equal rows, are judged each.
Without trusted documents, or without scores among them, there is no verdict and the rules alone decide. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.llm.tables import with_flag
from siftrank.session import cut_lineage

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
#: Percent of words in repeated windows of three, above which a text fails.
MAX_REPEATED = 50
#: A power of two.
BUCKETS = 1 << 14
DEVIATIONS = 6
UNIT = 1_000_000


def words_of(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once and not at each element of an array it is used in."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """How many words lie in a window of three that the text has twice or more. Windows are sorted with their places, so
    equal ones are neighbours; the places of those, in order, cover three words each less what overlaps."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
                           lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    def places(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return _bind(ordered, lambda s: F.sort_array(F.transform(
            F.filter(F.transform(s, lambda x, j: F.struct(
                x["i"].alias("i"),
                (F.get(s, j - 1)["w"].eqNullSafe(x["w"]) | F.get(s, j + 1)["w"].eqNullSafe(x["w"])).alias("twice"))),
                lambda x: x["twice"]), lambda x: x["i"])))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _bind(hashes, lambda h: _bind(windows(h), lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_bind(places(w), covered))))


def grams(hashes: Column, buckets: int) -> Column:
    """Buckets of all words and pairs of neighbouring words."""
    def place(h: Column) -> Column:
        return h.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")

    return _bind(hashes, lambda h: F.concat(
        F.transform(h, place),
        F.transform(F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))),
                    lambda x, i: place(F.xxhash64(F.get(h, i), x)))))


def _hashed(texts: DataFrame) -> DataFrame:
    return texts.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def rule_counts(documents: DataFrame) -> DataFrame:
    """Columns ``doc_id``, ``_hashes`` of the words and the counts that the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = documents.select(
        "doc_id", text.alias("text"), words_of(F.col("text")).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    return _hashed(lines).select(
        "doc_id", "_hashes", F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_hashes")).alias("n_repeat_words"))


def fit(documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``weights``, the log ratio of each bucket in millionths, add-one smoothed. ``trusted`` has column ``doc_id``.
    Every text is counted; what is shuffled is at most ``buckets`` rows a task."""
    texts = with_flag(documents.select("doc_id", "text"), trusted, "trusted")
    hashed = _hashed(texts.select("trusted", words_of(F.col("text")).alias("_words")))
    each = hashed.select("trusted", F.explode(grams(F.col("_hashes"), buckets)).alias("bucket"))
    counts = each.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("target"))
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = cut_lineage(every.join(counts, "bucket", "left").na.fill(0))
    sums = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    ratio = (F.log((F.col("target") + 1) / (F.col("all_target") + buckets))
             - F.log((F.col("raw") + 1) / (F.col("all_raw") + buckets)))
    weight = F.round(ratio * UNIT).cast("long")
    row = F.sort_array(F.collect_list(F.struct("bucket", weight.alias("weight"))))
    totals = counts.crossJoin(F.broadcast(sums))  # one row
    return cut_lineage(totals.agg(F.transform(row, lambda x: x["weight"]).alias("weights"),
                                  (F.max("all_target") > 0).alias("taught")))


def quality_rules(documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS,
                  deviations: float = DEVIATIONS) -> DataFrame:
    """One row per row of ``documents`` (``doc_id``, ``text``): the counts of ``rule_counts``, ``base_failed``, ``score`` (the mean
    log ratio, NULL without words or without trusted documents), ``threshold`` and ``kept``."""
    model = fit(documents, trusted, buckets)
    row = model.first()  # ``buckets`` numbers, whatever the corpus
    weights = F.split(F.lit(",".join(map(str, row.weights))), ",").cast("array<long>")  # folded into one constant
    taught = F.lit(row.taught)
    total = F.aggregate(grams(F.col("_hashes"), buckets), F.lit(0).cast("long"), lambda a, g: a + F.get(weights, g))
    counted = rule_counts(documents).withColumn("_n", F.greatest(2 * F.col("n_words") - 1, F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    scored = cut_lineage(counted.select(
        *[c for c in counted.columns if not c.startswith("_")], failed.alias("base_failed"),
        F.when(taught & (F.col("_n") > 0), F.round(total / F.col("_n")).cast("long")).alias("millionths")))

    good = with_flag(scored, trusted, "trusted").where(F.col("trusted") & ~F.col("base_failed") & F.col("millionths").isNotNull())
    m = F.col("millionths").cast("decimal(38,0)")  # whole sums: the same in any order
    sums = good.agg(F.count(F.lit(1)).alias("n"), F.sum(m).alias("s"), F.sum(m * m).alias("q"))
    n, s, q = (F.col(c).cast("double") for c in "nsq")
    spread = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    cut = cut_lineage(sums.select(F.when(n > 0, F.floor(s / n - deviations * spread)).cast("long").alias("cut")))
    passes = F.coalesce(F.col("millionths") >= F.col("_cut"), F.lit(True))
    return scored.withColumn("_cut", cut.scalar()).select(
        *[c for c in scored.columns if c != "millionths"], (F.col("millionths") / UNIT).alias("score"),
        (F.col("_cut") / UNIT).alias("threshold"), (~F.col("base_failed") & passes).alias("kept"))
