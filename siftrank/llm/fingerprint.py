"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only.

A text's paragraphs (its non-blank lines) become a set of 64-bit digests. The sketch has three rows of cells; a digest
falls into one cell of each row, and a cell holds how many digests it has, their exclusive or, and that of a
check number of each. Subtracting two sketches cell by cell leaves only digests that one text has and the other
hasn't. A cell with a single one shows it; taking that out of its other cells ("peeling") shows more, until
all cells are zero. If peeling gets stuck, the sketches are made again with four times as many cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS = 3
#: Cells of a row in the fingerprint, and how often a stuck comparison is tried again with four times as many.
CELLS = 8
RETRIES = 3
#: Peeling rounds; each takes out all single digests at once. Sketches of enough cells need about ten.
ROUNDS = 24


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of the non-blank lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _cell(digest: Column, row: int, cells: int) -> Column:
    """The number of a digest's cell in a row; rows follow each other."""
    return F.pmod(F.xxhash64(digest, F.lit(row)), F.lit(cells)).cast("int") + row * cells


def _placed(digests: Column, cells: int) -> Column:
    """Digests with their check number and cells, worked out once."""
    return F.transform(digests, lambda d: F.struct(
        d.alias("d"), _check(d).alias("c"), *[_cell(d, r, cells).alias(f"p{r}") for r in range(ROWS)]))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, as the only entry of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _xor(cell: Column, sign: Column | int, x: Column) -> Column:
    return F.struct((cell["n"] + sign).alias("n"), cell["d"].bitwiseXOR(x["d"]).alias("d"),
                    cell["c"].bitwiseXOR(x["c"]).alias("c"))


def _in_cell(placed: Column, i: Column) -> Column:
    return F.filter(placed, lambda x: (x["p0"] == i) | (x["p1"] == i) | (x["p2"] == i))


def sketch(digests: Column, cells: int) -> Column:
    """Cells (n, d, c) of a set of digests, row after row."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("c"))
    numbers = F.sequence(F.lit(0), F.lit(ROWS * cells - 1))
    return _bind(_placed(digests, cells), lambda placed: F.transform(
        numbers, lambda i: F.aggregate(_in_cell(placed, i), zero, lambda s, x: _xor(s, 1, x))))


def subtract(one: Column, other: Column) -> Column:
    """The cells of one sketch less those of another of the same size."""
    return F.zip_with(one, other, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["d"].bitwiseXOR(y["d"]).alias("d"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, width: int) -> Column:
    """(left, right): the digests that only the first and only the second set has; NULL if peeling gets stuck.
    ``cells`` is the difference of two sketches with ``width`` cells in a row."""
    none = F.array().cast("array<bigint>")
    begin = F.struct(cells.alias("cells"), none.alias("left"), none.alias("right"), F.lit(False).alias("done"))

    def round_(state, _):
        single = F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["d"])))
        found = F.array_distinct(F.transform(single, lambda x: F.struct(
            x["n"].alias("n"), x["d"].alias("d"), x["c"].alias("c"),
            *[_cell(x["d"], r, width).alias(f"p{r}") for r in range(ROWS)])))

        def take(found):
            only = lambda n: F.transform(F.filter(found, lambda x: x["n"] == n), lambda x: x["d"])
            return F.struct(
                F.transform(state["cells"], lambda cell, i: F.aggregate(
                    _in_cell(found, i), cell, lambda s, x: _xor(s, -x["n"], x))).alias("cells"),
                F.concat(state["left"], only(1)).alias("left"), F.concat(state["right"], only(-1)).alias("right"),
                (F.size(found) == 0).alias("done"))

        return F.when(state["done"], state).otherwise(_bind(found, take))

    empty = lambda s: F.forall(s["cells"], lambda x: (x["n"] == 0) & (x["d"] == 0) & (x["c"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, round_, lambda s: F.when(
        empty(s), F.struct(s["left"].alias("left"), s["right"].alias("right"))))


def difference(one: Column, other: Column, cells: int = CELLS, retries: int = RETRIES) -> Column:
    """(left, right) for two sets of digests, from their sketches. Each retry is made only where the sketch before got
    stuck. Sets that differ in more than about ``cells * 4**retries`` * 2 digests are compared directly."""
    tries = [peel(subtract(sketch(one, n), sketch(other, n)), n) for n in (cells * 4**i for i in range(retries + 1))]
    direct = F.struct(F.array_except(one, other).alias("left"), F.array_except(other, one).alias("right"))
    return F.coalesce(*tries, direct)


def likeness(one: Column, other: Column) -> Column:
    """Shared digests in those of both sets, 0 to 1, by ``difference``; 1 for two empty sets."""
    apart = _bind(difference(one, other), lambda x: F.size(x["left"]) + F.size(x["right"]))
    both = F.size(one) + F.size(other)
    return F.when(both == 0, F.lit(1.0)).otherwise(_bind(apart, lambda x: (both - x) / (both + x)))


def fingerprint(digests: Column, cells: int = CELLS) -> Column:
    """The sketch as text: for each cell 8 hex digits of n, 16 of d, 8 of c. Equal texts have equal fingerprints."""
    digit = lambda x, size: F.lpad(F.hex(x), size, "0")
    return F.array_join(F.transform(sketch(digests, cells), lambda x: F.concat(
        digit(x["n"].cast("long"), 8), digit(x["d"], 16), digit(x["c"], 8))), "")


def with_next(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, next_text) for each row of ``documents``: the text of the row that follows in descending order of the key,
    after the last that of the first.

    Keys are cut into four ranges of like bytes for each shuffle partition, one exchange brings the rows of a range together, and the first row
    of each range goes to the range before it, too. The plan has one size for any number of ranges. No range depends on how often one key occurs, unless rows repeat
    a key: those follow each other by their text's hash, and NULL keys come last.
    """
    spark = documents.sparkSession
    least = F.lit(-(1 << 63)).cast("long")
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("key", "text", F.coalesce("key", least).alias("_o"), F.xxhash64("text").alias("_t"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.split(F.lit(",".join(str(i / (2 * ranges)) for i in range(1, 2 * ranges))), ",").cast("array<double>")
    cuts = rows.agg(F.percentile_approx("_o", shares, 4 * ranges).alias("cuts")).first().cuts
    cuts = sorted(set(cuts or []))
    fine = rows.withColumn("_b", _below(F.col("_o"), cuts))
    found = fine.groupBy("_b").agg(F.max(F.struct("_o", "_t")).alias("top"), F.sum(F.octet_length("text") + 1).alias("bytes")).orderBy("_b").collect()
    most, bounds, tops, held = sum(r.bytes for r in found) / ranges, [], [], 0
    for r in found:  # at most 2 * ranges rows
        if tops and held + r.bytes <= most:
            held, tops[-1] = held + r.bytes, r.top
        else:
            if tops:
                bounds.append(last)
            tops.append(r.top)
            held = r.bytes
        last = cuts[r._b] if r._b < len(cuts) else None
    # The first row of each range goes also to the range before it; the first range of all follows the last.
    heads = [(i, t._o, t._t, (i + 1) % len(tops)) for i, t in enumerate(tops)]
    heads = F.broadcast(spark.createDataFrame(heads, "_b int, _ho long, _ht long, _before int"))  # one row a range
    ranged = rows.withColumn("_b", _below(F.col("_o"), bounds)).join(heads, "_b")
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("head"))
    both = F.array(own, F.struct(F.col("_before").alias("b"), F.lit(True).alias("head")))
    first = (F.col("_o") == F.col("_ho")) & (F.col("_t") == F.col("_ht"))
    dealt = ranged.withColumn("_s", F.explode(F.when(first, both).otherwise(F.array(own)))).select(
        "key", "text", "_o", "_t", "_s.b", "_s.head")
    order = W.partitionBy("b").orderBy("head", F.desc("_o"), F.desc("_t"))
    return dealt.withColumn("next_text", F.lead("text").over(order)).where(~F.col("head")).select(
        "key", "text", "next_text")


def _below(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below ``value``, by bisection. The bounds are one constant of the plan."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    begin = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        return F.when(s["low"] >= s["high"], s).otherwise(F.when(
            F.get(held, middle) < value, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), middle.alias("high"))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), begin, halve, lambda s: s["low"])


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many, or all, of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, edited_text, digests, edited_digests, next_digests, fingerprint, edited_fingerprint) for each row.

    NULL texts are empty; a text without non-blank lines has the fingerprint of the empty set. Repeated rows stay, each with
    a next row of its own; NULL keys come last in the order. Other columns are not looked at. A table of one row
    follows itself, an empty table gives no rows.
    """
    rows = with_next(documents, key, text).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("key", "text", "edited_text", paragraph_digests(F.col("text")).alias("digests"),
                       paragraph_digests(F.col("edited_text")).alias("edited_digests"),
                       paragraph_digests(F.col("next_text")).alias("next_digests"))
    return rows.withColumns({"fingerprint": fingerprint(F.col("digests")),
                             "edited_fingerprint": fingerprint(F.col("edited_digests"))})
