"""Chat formatting in windows of a token budget.

Turns of a conversation are cut into spans along the running sum of their tokens: a window takes turns while the sum
since its first new turn, with what it repeats, stays within the budget. A system turn at the head of a conversation
is repeated in every window; before the new turns come the last turns of the window before, as many as the history
limits allow. Only assistant turns that are new carry loss, so every target counts once.

Rows of a conversation are read in order and one window is held at a time: a conversation of any length needs the
memory of one window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's own marks.
TURN, END = "<|turn|>", "<|end|>"
#: Strings that must not stand in a text unescaped: the template's marks and those of common other templates.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|endoftext|>")
BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
MARK_TOKENS = 4
TARGET = "assistant"

_CONTROL_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"((?:\\.|[^\\\n])*)\n", re.S)
_TOKENS = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    """Double each backslash and put one after the first character of each control string."""
    return _CONTROL_STARTS.sub(r"\1" + "\\\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def count_tokens(text: str) -> int:
    """Words and marks. Any other counter can be given instead, such as a tokenizer's."""
    return len(_TOKENS.findall(text))


@dataclass
class _Turn:
    role: str
    form: str  # as it stands in the window
    target: tuple[int, int]  # the text's place in it
    tokens: int


def _formed(role: str, text: str, count: Callable[[str], int]) -> _Turn:
    head = TURN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return _Turn(role, head + body + END + "\n", (len(head), len(head) + len(body)), count(text) + MARK_TOKENS)


class Windows:
    """The windows of one conversation, as its turns come."""

    def __init__(self, budget: int, history_turns: int, history_tokens: int, count: Callable[[str], int]) -> None:
        self.budget, self.history_turns, self.history_tokens, self.count = budget, history_turns, history_tokens, count
        self.system: list[_Turn] = []
        self.repeated: list[_Turn] = []
        self.new: list[_Turn] = []
        self.total = self.begin = 0  # tokens of all turns so far, and before the first new one
        self.number = 0

    def add(self, role: str, text: str) -> dict | None:
        """Take a turn; the window that it doesn't fit into any more, if there is one."""
        turn, out = _formed(role, text, self.count), None
        room = self.budget - sum(t.tokens for t in self.repeated)
        if self.new and self.total + turn.tokens - self.begin > room:
            out = self.close(turn.tokens)
        self.new.append(turn)
        self.total += turn.tokens
        return out

    def close(self, next_tokens: int = 0) -> dict | None:
        """The window so far. The next one repeats what the limits, and a first turn of ``next_tokens``, allow."""
        if not self.new:
            return None
        turns, parts, loss, at = self.repeated + self.new, [], [], 0
        for i, t in enumerate(turns):
            parts.append(t.form)
            if i >= len(self.repeated) and t.role == TARGET:
                loss.append({"start": at + t.target[0], "end": at + t.target[1]})
            at += len(t.form)
        out = {"window": self.number, "text": "".join(parts), "loss": loss, "n_turns": len(turns),
               "n_repeated": len(self.repeated), "tokens": sum(t.tokens for t in turns)}
        if self.number == 0 and self.new[0].role == "system":
            self.system = self.new[:1]
        history: list[_Turn] = []
        held, fixed = 0, sum(t.tokens for t in self.system)
        later = turns[len(self.system):]
        for t in reversed(later[-self.history_turns:] if self.history_turns else []):
            if held + t.tokens > self.history_tokens or fixed + held + t.tokens + next_tokens > self.budget:
                break
            history.insert(0, t)
            held += t.tokens
        self.repeated, self.new, self.begin, self.number = self.system + history, [], self.total, self.number + 1
        return out


_SCHEMA = ("conv_id {kind}, window long, text string, loss array<struct<start: bigint, end: bigint>>, n_turns long, "
           "n_repeated long, tokens long")
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _batch(ids: list, rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    names = ["window", "text", "loss", "n_turns", "n_repeated", "tokens"]
    kinds = [pa.int64(), pa.string(), _LOSS, pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), *[pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)]], ["conv_id", *names])


def _format(make: Callable[[], Windows]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, windows, ids, rows, chars, kind = object(), None, [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                out = []
                if windows is None or conv != current:
                    out.append((current, windows.close() if windows else None))
                    current, windows = conv, make()
                out.append((conv, windows.add(role, text)))
                for owner, window in out:
                    if window:
                        ids.append(owner)
                        rows.append(window)
                        chars += len(window["text"])
                if chars > 4 << 20:
                    yield _batch(ids, rows, kind)
                    ids, rows, chars = [], [], 0
        if windows is not None:
            window = windows.close()
            yield _batch(ids + [current] * bool(window), rows + [window] * bool(window), kind)
    return run


def format_chat(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
                history_tokens: int = HISTORY_TOKENS, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """Windows (conv_id, window, text, loss, n_turns, n_repeated, tokens) of ``conversations`` (conv_id, turn, role, text).

    ``text`` is the formatted window, ``loss`` the places in it that carry loss (code points), ``n_repeated`` how many
    of its turns stood in an earlier window. Turns are ordered by turn, then role, then text; NULL turns come
    first, repeated rows stay, NULL texts and roles are empty, rows with NULL conv_id are one conversation. A turn
    larger than the budget is a window of its own (with the system turn). Windows of a conversation come in order, in one
    partition. Other columns are not looked at. An empty table gives no rows.
    """
    rows = conversations.select(
        "conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    laid = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return laid.select("conv_id", "role", "text").mapInArrow(
        _format(lambda: Windows(budget, history_turns, history_tokens, count)), _SCHEMA.format(kind=kind))


def parse(window: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    out, at = [], 0
    while at < len(window):
        if not window.startswith(TURN, at):
            raise ValueError(f"no turn begins at {at}")
        role = _ROLE.match(window, at + len(TURN))
        end = window.index(END + "\n", role.end())
        out.append((unescape(role.group(1)), unescape(window[role.end():end])))
        at = end + len(END) + 1
    return out


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.windows = 0

    def add(self, text: str, loss: list[dict], repeated: int) -> None:
        for role, body in parse(text)[repeated:]:
            self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for span in loss:
            target = unescape(text[span["start"]:span["end"]])
            self.loss.update(target.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(target)
        self.chars += len(text)
        self.windows += 1

    def row(self) -> tuple:
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows)


_READ = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, digest, kind = None, None, None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], list(_READ))

    for batch in batches:
        kind, done = batch.column(0).type, []
        for conv, number, text, loss, repeated in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "window", "text", "loss", "n_repeated"))):
            if digest is None or number == 0:
                if digest is not None:
                    done.append((current, *digest.row()))
                current, digest = conv, _Digest()
            digest.add(text, loss, repeated)
        yield rows(done)
    if digest is not None:
        yield rows([(current, *digest.row())])


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of ``format_chat`` say, one row per conversation: turns, their digest, the text under the loss mask,
    its digest, the characters of all windows. Works on the partitions and the order that ``format_chat`` gives."""
    kind = windows.schema["conv_id"].dataType.simpleString()
    return windows.mapInArrow(_read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long, n_windows long")
