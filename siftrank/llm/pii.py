"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton finds anchors: at-signs, plus-digit, digit-dot-digit, digit pairs, "://" and cue
words. At each anchor a parser of its kind reads left and right as far as the form allows and checks what it
has read (number ranges, digit counts, check digits). Text without anchors costs nothing but that pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.llm.tables import small_batches

#: Base kinds, in the order of the spans, then the kinds that this method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "account", "secret", "national")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USER_AT = re.compile(r"[^\s/@:\"'<>]+(?::[^\s/@\"'<>]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_CUED = re.compile(r"(?:\s*(?:no|nr|number|num)\b\.?)?[\s:=#]{1,3}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?|[0-9][0-9 -]{6,22}[0-9])(?![A-Za-z0-9])",
                   re.I)
_SECRET = re.compile(r"(?:[_-]?(?:key|token|id))?[\"'`]?\s{0,4}(?:=>|:=|[:=])\s{0,4}(?:bearer\s+)?([\"'`]?)([A-Za-z0-9_./+~-]{16,256}={0,2})", re.I)
_PASSWORD = re.compile(r"[\"'`]?\s{0,4}(?:=>|:=|[:=])\s{0,4}([\"'`])([^\s\"'`]{6,128})\1", re.I)
_SOCIAL = re.compile(r"(?:\s*(?:no|nr|number|num)\b\.?)?[\s:=#]{1,3}([0-9]{3})([ -]?)([0-9]{2})\2([0-9]{4})(?![0-9])", re.I)
_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
_TOKENS = ("token", "secret", "api_key", "api-key", "apikey", "access_key", "private_key", "auth_key", "secret_key")
_PASSWORDS = ("password", "passwd", "passphrase", "pwd")
_SOCIALS = ("ssn", "social security")
#: Bits a character that a token has at least; hexadecimal digits come near 4, words and names stay below or lack digits.
TOKEN_BITS = 3.0


def luhn(digits: str) -> bool:
    """Whether the last digit is the right check digit."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether an account number with country and check digits has remainder 1 modulo 97."""
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def entropy(text: str) -> float:
    """Bits a character, by how often each occurs in the text."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


class Finder:
    """Spans of one text after another. Make one per task."""

    def __init__(self) -> None:
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        add = self.anchors.add_word
        add("@", ("email", 1))
        add("://", ("address", 3))
        for a in "0123456789":
            add("+" + a, ("phone", 2))
            for b in "0123456789":
                add(f"{a}.{b}", ("ip", 3))
                add(a + b, ("card", 2))
                add(f"{a} {b}", ("card", 3))
                add(f"{a}-{b}", ("card", 3))
        for kind, cues in (("account", _CUES), ("secret", _TOKENS + _PASSWORDS), ("national", _SOCIALS)):
            for cue in cues:
                for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                    add(form, (kind, len(form)))
        self.anchors.make_automaton()
        self.parsers = {"email": self._email, "ip": self._ip, "card": self._card, "phone": self._phone,
                        "address": self._address, "account": self._account, "secret": self._secret,
                        "national": self._national}

    # A parser takes the text, the anchor's place and the end of what its kind has read so far. It returns what
    # is read now and the span, or None where the form fails or is not valid.

    def _email(self, text: str, at: int, done: int):
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _DOMAIN.match(text, at + 1) if begin < at else None
        return (host.end(), (begin, host.end())) if host else (done, None)

    def _ip(self, text: str, at: int, done: int):
        begin = at
        while begin > done and text[begin - 1] in _DIGITS:
            begin -= 1
        form = _DOTTED.match(text, begin)
        if not form:
            return _CHAIN.match(text, begin).end(), None
        valid = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in form.group().split("."))
        return form.end(), (begin, form.end()) if valid else None

    def _card(self, text: str, at: int, done: int):
        form = _CARD.match(text, at)
        digits = form.group().replace(" ", "").replace("-", "")
        return form.end(), form.span() if 16 <= len(digits) <= 19 and luhn(digits) else None

    def _phone(self, text: str, at: int, done: int):
        form = _PHONE.match(text, at)
        if not form:
            return done, None
        return form.end(), form.span() if 8 <= sum(c in _DIGITS for c in form.group()) <= 15 else None

    def _address(self, text: str, at: int, done: int):
        """A scheme with a user before the host."""
        begin = at
        while begin > done and text[begin - 1].isascii() and text[begin - 1].isalpha():
            begin -= 1
        rest = _USER_AT.match(text, at + 3) if begin < at else None
        return (rest.end(), (begin, rest.end())) if rest else (done, None)

    def _account(self, text: str, at: int, done: int):
        """The number after a cue: an IBAN with right check digits, or 8 to 18 digits."""
        cue = next(len(c) for c in _CUES if text[at : at + len(c)].lower() == c)
        if at and text[at - 1].isalnum():
            return done, None
        form = _CUED.match(text, at + cue)
        if not form:
            return done, None
        number = form.group(1).replace(" ", "").replace("-", "")
        valid = 8 <= len(number) <= 18 if number.isdigit() else iban(number.upper())
        return form.end(1), form.span(1) if valid else None

    def _secret(self, text: str, at: int, done: int):
        """The value set after a cue: a quoted password, or a token of letters and digits without a pattern to them."""
        if at and text[at - 1].isalnum():
            return done, None
        cue = max((c for c in _TOKENS + _PASSWORDS if text[at : at + len(c)].lower() == c), key=len)
        if cue in _PASSWORDS:
            form = _PASSWORD.match(text, at + len(cue))
            return (form.end(), form.span(2)) if form else (done, None)
        form = _SECRET.match(text, at + len(cue))
        if not form:
            return done, None
        value, after = form.group(2), text[form.end() : form.end() + 1]
        mixed = any(c in _DIGITS for c in value) and any(c.isalpha() for c in value)
        closed = after == form.group(1) if form.group(1) else after not in ("(", "[", "{") or not after
        valid = mixed and closed and entropy(value) >= TOKEN_BITS
        return (form.end(), form.span(2)) if valid else (done, None)

    def _national(self, text: str, at: int, done: int):
        """A social security number after its cue; areas 000, 666 and from 900 on, group 00 and serial 0000 do not exist."""
        cue = next(len(c) for c in _SOCIALS if text[at : at + len(c)].lower() == c)
        form = _SOCIAL.match(text, at + cue) if not (at and text[at - 1].isalnum()) else None
        if not form:
            return done, None
        area, _, group, serial = form.groups()
        valid = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
        return form.end(), (form.start(1), form.end()) if valid else None

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by kind as listed, then start."""
        done = dict.fromkeys(self.parsers, 0)
        found: dict[str, list] = {k: [] for k in (*BASE, *ADDED)}
        for last, (kind, length) in self.anchors.iter(text):
            at = last - length + 1
            if at >= done[kind]:
                done[kind], span = self.parsers[kind](text, at, done[kind])
                if span:
                    found[kind].append((kind, *span))
        return [s for kind in found for s in found[kind]]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = Finder()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = [[{"kind": k, "start": a, "end": b} for k, a, b in finder.spans(t or "")]
               for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, kind)], ["key", "spans"])


def find_pii(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans) for each row of ``documents``; spans is an array of (kind, start, end) in code points, end exclusive,
    by kind (email, ip, card, phone, address, account, secret, national), then start. Spans of one kind do not overlap, those of
    different kinds may. A NULL text is empty and has no spans. NULL keys and repeated rows pass through,
    other columns are not looked at, an empty table gives no rows."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_find, f"key {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with [KIND] in the place of each span; a span that begins inside an earlier one goes with it."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(state, s):
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        new = F.concat(state["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(s["start"] >= state["at"], new).otherwise(state["out"]).alias("out"),
                        F.greatest(state["at"], s["end"]).alias("at"))

    return F.aggregate(ordered, empty, step, lambda s: F.concat(
        s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
