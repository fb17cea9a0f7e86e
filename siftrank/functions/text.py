"""Column expressions for text clean-up, labels, flags and keys. All of them stay in the JVM."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftrank.functions import fixed_values as fv

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """Remove Unicode white space from both ends."""
    return F.trim(_col(c), F.lit(fv.WHITESPACE))


def strip_long(name: str) -> Column:
    """``strip`` for a column of long texts. Trimming walks and copies the whole text, so it is left to
    the texts that begin or end with white space."""
    text, blanks = F.col(name), F.lit(fv.WHITESPACE)
    ends = reduce(lambda a, b: a | b, [text.endswith(blank) for blank in fv.WHITESPACE])
    outer = blanks.contains(F.substring(text, 1, 1)) | ends
    return F.when(outer, F.trim(text, blanks)).otherwise(text)


def is_blank(c: ColumnOrName) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def token_count(c: ColumnOrName) -> Column:
    """Number of white-space separated tokens."""
    spaced = F.translate(_col(c), fv.WHITESPACE, " " * len(fv.WHITESPACE))
    return F.size(F.array_remove(F.split(spaced, " "), ""))


def to_number(c: ColumnOrName) -> Column:
    """Text to double, NULL where it is not a number (a trailing Java type letter is not one)."""
    text = strip(_col(c).cast("string"))
    return F.when(~text.rlike(r"[0-9.][dDfF]$"), text.try_cast("double"))


def to_int(c: ColumnOrName) -> Column:
    """Text to int, truncated; anything that is not a number becomes 0."""
    return F.coalesce(to_number(c).try_cast("int"), F.lit(0))


def to_label(c: ColumnOrName) -> Column:
    """Label synonyms to 1 and 0, other numbers truncated, the rest NULL."""
    word = F.lower(strip(_col(c).cast("string")))
    return (
        F.when(word.isin(*fv.POSITIVE_WORDS), 1)
        .when(word.isin(*fv.NEGATIVE_WORDS), 0)
        .otherwise(to_number(word).try_cast("int"))
    )


def clip01(c: ColumnOrName) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(1), _col(c)))


#: Letters whose caseless form is not their lower case: by one letter, and by several. Worked out from the Unicode tables that Python has.
_FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if c.casefold() != c}
_ONE_TO_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
_ONE_TO_MANY = {c: f for c, f in _FOLDED.items() if len(f) > 1}


def fold_case(c: ColumnOrName) -> Column:
    """Full Unicode case folding, as for caseless comparison: each code point by itself, some by several (ß to ss). Texts of plain
    ASCII, which most are, only become lower case."""
    text = _col(c)
    several = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), _ONE_TO_MANY.items(),
                     F.translate(text, "".join(_ONE_TO_ONE), "".join(_ONE_TO_ONE.values())))
    ascii_letters = F.translate(several, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_letters)


def facet_key(c: ColumnOrName, null_label: str = "nan") -> Column:
    """Grouping key of a facet value: stripped, caseless, NULL under its own label."""
    text = F.coalesce(_col(c).cast("string"), F.lit(null_label))
    return fold_case(strip(text))


def title_case(c: ColumnOrName) -> Column:
    """Upper-case the first letter of every run of letters."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def yes_no(c: ColumnOrName, null_label: str = "nan") -> Column:
    """true/1 to yes, false/0 to no; other values are kept in lower case."""
    word = F.lower(strip(F.coalesce(_col(c).cast("string"), F.lit(null_label))))
    return (
        F.when(word.isin("true", "1"), "yes").when(word.isin("false", "0"), "no").otherwise(word)
    )


def is_finite(c: ColumnOrName) -> Column:
    value = _col(c)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def finite_or_null(c: ColumnOrName) -> Column:
    """Double score, NULL where missing, not a number or infinite."""
    value = to_number(c)
    return F.when(is_finite(value), value)


def zero_if_missing(c: ColumnOrName) -> Column:
    """Double score: missing or NaN counts as 0.0, infinite becomes NULL."""
    value = F.coalesce(F.nanvl(to_number(c), F.lit(0.0)), F.lit(0.0))
    return F.when(is_finite(value), value)


def content_key(*columns: ColumnOrName) -> Column:
    """Digest that stands in for long texts as a join key; the bytes are used as they are."""
    parts = [_col(c) for c in columns]
    joined = parts[0] if len(parts) == 1 else reduce(
        lambda a, b: F.concat(a, F.lit(fv.PAIR_SEPARATOR), b), parts
    )
    return F.sha2(joined, 256)


def seeded_order(seed: int, *keys: ColumnOrName) -> Column:
    """Reproducible shuffle key of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]))


def source_tag(filename: ColumnOrName, tags: tuple[str, str] = fv.SOURCE_TAGS) -> Column:
    """Tag of a chunk by whether it carries a file name."""
    return F.when(is_blank(filename), tags[1]).otherwise(tags[0])


def query_with_instruction(question: ColumnOrName, instruction: str = "") -> Column:
    ins = instruction or fv.DEFAULT_QUERY_INSTRUCTION
    return F.concat(F.lit(fv.INSTRUCT_HEAD + ins + fv.QUERY_HEAD), _col(question))


def rerank_text(question: ColumnOrName, chunk: ColumnOrName) -> Column:
    return F.concat(
        F.lit(fv.INSTRUCT_HEAD + fv.RERANK_INSTRUCTION + fv.QUERY_HEAD),
        _col(question),
        F.lit(fv.DOCUMENT_HEAD),
        _col(chunk),
    )


def annotation_text(question: ColumnOrName, chunk: ColumnOrName) -> Column:
    return F.concat(
        F.lit(fv.QUESTION_HEAD), _col(question),
        F.lit(fv.PARAGRAPH_HEAD), _col(chunk),
        F.lit("\n" + fv.ANNOTATION_PROMPT_TAIL),
    )


def needs_query_prompt(model_name: str | None) -> bool:
    """Whether a model of this name expects the retrieval prompt in front of its queries."""
    return "bge-" in (model_name or "").lower()


def prompted_query(question: ColumnOrName, model_name: str | None,
                   prompt: str = fv.BGE_QUERY_PROMPT) -> Column:
    text = _col(question)
    return F.concat(F.lit(prompt), text) if needs_query_prompt(model_name) else text
