"""Chat formatting: roles by a hidden Markov model, then canonical turns.

Each row of a conversation is cut into lines. A line may carry a speaker marker (a spelled
one such as `User:`, `### Response`, `<|im_start|>user`; with `role_marks` also the row's
role column) and has features of its own: the first line those of its row, its length class
and whether it asks something, every other line the same of itself. The model's transitions
and emissions are counted from rows whose role is known. Viterbi finds the likeliest roles
of a whole conversation: its rows, put in order over all tasks, are cut into blocks of at
most BLOCK rows by their place, blocks are first folded into small max-plus matrices, the
blocks' end states are settled from those, and each block is then decoded between its end
states. So a conversation of any length is decoded exactly, and no task ever holds more of
it than a block, or than one matrix for each block.

Defined results: null and empty texts are turns without text; rows of a null conversation
form one conversation; null turns come first, equal turns in the order of their text, and
repeated rows stay repeated. With no row whose role is known the built-in prior alone
decides. Of equally likely paths the one with the earlier states of ROLES is taken. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.bytewords import lean
from loomline.llm.spool import Spool

ROLES = ("system", "user", "assistant", "tool")
# Names that chat logs give the roles.
ALIASES = {
    "system": "system", "sys": "system", "developer": "system", "context": "system",
    "user": "user", "human": "user", "prompter": "user", "customer": "user", "question": "user", "q": "user", "instruction": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "chatbot": "assistant", "gpt": "assistant", "model": "assistant", "agent": "assistant", "answer": "assistant", "a": "assistant", "response": "assistant",
    "tool": "tool", "function": "tool", "observation": "tool", "ipython": "tool",
}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_NAME = "|".join(sorted(ALIASES, key=len, reverse=True))
_MARKER = re.compile(rf"\s*(?:<\|(?:im_start|start_header_id)\|>\s*({_NAME})\b(?:<\|end_header_id\|>)?\s*:?|<\|({_NAME})\|>|#+\s*({_NAME})\s*:?\s*$|\[({_NAME})\]\s*:?|(?:[*_]{{0,2}})({_NAME})(?:[*_]{{0,2}})\s*:(?:[*_]{{0,2}}))", re.I)
#: Rows of a conversation that are decoded together.
BLOCK = 256
LENGTHS = (40, 160, 640, 2560)
LINE_LENGTHS = (20, 80, 320)


@dataclass
class Hmm:
    start: np.ndarray  # log P(role of the first line)
    turn: np.ndarray  # log P(role | role before) where a row begins
    look: np.ndarray  # log P(length class, asks | role) of a row
    line: np.ndarray  # the same of each further line of a row
    #: How sure a marker is: the chance that it names another role than the speaker's.
    wrong: float = 0.02
    #: The chance that a speaker changes inside a row, without and with a marker there.
    shift: float = 0.002

    def inside(self, marked: bool) -> np.ndarray:
        p = 0.5 if marked else self.shift
        return np.log(np.where(np.eye(len(ROLES), dtype=bool), 1 - p, p / (len(ROLES) - 1)))

    def marker(self, role: int | None) -> np.ndarray:
        if role is None:
            return np.zeros(len(ROLES))
        out = np.full(len(ROLES), self.wrong / (len(ROLES) - 1))
        out[role] = 1 - self.wrong
        return np.log(out)


def look_of(text: str) -> int:
    """The class of a row by its length and whether a line of it ends in a question mark."""
    return 2 * int(np.searchsorted(LENGTHS, len(text), "right")) + ("?\n" in text or text.rstrip().endswith("?"))


def look_of_line(line: str) -> int:
    """The class of one line."""
    return 2 * int(np.searchsorted(LINE_LENGTHS, len(line), "right")) + line.endswith("?")


def role_number(name: str | None) -> int | None:
    known = ALIASES.get((name or "").strip().lower())
    return None if known is None else ROLES.index(known)


def lines_of(role: str | None, text: str | None) -> list[tuple[int | None, str]]:
    """(marked role, line without its marker) of each line; the first line takes the row's role if it has no marker of its own."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        m = _MARKER.match(line)
        mark = role_number(next(x for x in m.groups() if x)) if m else None
        line = (line[m.end() :] if m else line).replace(CLOSE, "")
        out.append((role_number(role) if mark is None and k == 0 else mark, line.lstrip() if m else line))
    return out


def steps_of(hmm: Hmm, rows: list[tuple[str | None, str | None]]) -> tuple[list[np.ndarray], list[np.ndarray], list[list[tuple[int | None, str]]]]:
    """Of every line of the rows: log transition into it, log emission; and the lines by row."""
    moves, says, lines = [], [], []
    for role, text in rows:
        own = lines_of(role, text)
        lines.append(own)
        for k, ((mark, _), line) in enumerate(zip(own, (text or "").split("\n"), strict=True)):
            moves.append(hmm.turn if k == 0 else hmm.inside(mark is not None))
            says.append(hmm.marker(mark) + (hmm.look[:, look_of(text or "")] if k == 0 else hmm.line[:, look_of_line(line)]))
    return moves, says, lines


def fold(moves: list[np.ndarray], says: list[np.ndarray], first: np.ndarray | None) -> np.ndarray:
    """Best log probability from the state before (row) to the state at the end (column). first: the start of a conversation."""
    best = None
    for move, say in zip(moves, says, strict=True):
        step = (np.tile(first, (len(ROLES), 1)) if best is None and first is not None else move) + say[None]
        best = step if best is None else (best[:, :, None] + step[None]).max(1)
    return best


def decode(moves: list[np.ndarray], says: list[np.ndarray], first: np.ndarray | None, before: int | None, end: int) -> list[int]:
    """The likeliest states between the state before the block and its last state."""
    score = (first if before is None else moves[0][before]) + says[0]
    back = []
    for move, say in zip(moves[1:], says[1:], strict=True):
        by = score[:, None] + move
        back.append(by.argmax(0))
        score = by.max(0) + say
    path = [end]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def settle(matrices: list[np.ndarray]) -> list[int]:
    """The last state of each block on the likeliest path; the first matrix starts a conversation."""
    score, back = matrices[0][0], []
    for m in matrices[1:]:
        by = score[:, None] + m
        back.append(by.argmax(0))
        score = by.max(0)
    path = [int(score.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def turns_of(lines: list[list[tuple[int | None, str]]], states: list[int]) -> Iterator[tuple[int, int, str, str, bool]]:
    """(row, part, role, text, whether a marker says so) of each turn; a new one begins with each row, marker and change of role."""
    at = 0
    for row, own in enumerate(lines):
        parts: list[tuple[int, list[str], bool]] = []
        for k, (mark, line) in enumerate(own):
            state = states[at]
            at += 1
            if k == 0 or mark is not None or parts[-1][0] != state:
                parts.append((state, [], mark == state))
            parts[-1][1].append(line)
        for part, (state, texts, marked) in enumerate(parts):
            yield row, part, ROLES[state], "\n".join(texts).strip(), marked


def render(role: str, text: str) -> str:
    """The canonical turn; the frame's own signs are broken up inside the text."""
    for sign in (OPEN, CLOSE):
        text = text.replace(sign, f"{sign[:2]} {sign[2:]}")
    return f"{OPEN}{role}\n{text}{CLOSE}\n"


def fit(talks: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Hmm:
    """Counts over all rows whose role is known, added to a prior; the driver gets counts of fixed number only."""
    n = len(ROLES)
    name = F.lower(F.trim(talks[role_col].cast("string")))
    number = F.coalesce(*[F.when(name.isin([a for a, r in ALIASES.items() if r == role]), k) for k, role in enumerate(ROLES)])
    text = F.coalesce(talks[text_col].cast("string"), F.lit(""))
    size = sum(F.when(F.length(text) >= x, 1).otherwise(0) for x in LENGTHS)
    look = 2 * size + F.when(text.contains("?\n") | F.rtrim(text).endswith("?"), 1).otherwise(0)
    rows = talks.select(talks[conv_col].alias("conv"), talks[turn_col].cast("long").alias("turn"), number.alias("role"), look.alias("look")).where("role is not null")
    each = F.explode(F.slice(F.split(text, "\n"), 2, 2**31 - 1))
    lines = talks.select(number.alias("role"), each.alias("line")).where("role is not null")
    line_look = 2 * sum(F.when(F.length("line") >= x, 1).otherwise(0) for x in LINE_LENGTHS) + F.when(F.col("line").endswith("?"), 1).otherwise(0)
    line = np.ones((n, 2 * len(LINE_LENGTHS) + 2))
    for r in lines.groupBy("role", line_look.alias("look")).count().collect():
        line[r.role, r["look"]] += r["count"]
    start, turn, looks = np.array([0.3, 0.65, 0.03, 0.02]) * 20, np.ones((n, n)), np.ones((n, 2 * len(LENGTHS) + 2))
    turn += 10 * np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0.2], [0, 0, 1, 0]])
    for r in rows.groupBy("role", "look").count().collect():
        looks[r.role, r["look"]] += r["count"]
    # the row before is found by its turn, so that a long conversation isn't gathered in one task
    after = rows.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    for r in rows.join(after, ["conv", "turn"]).groupBy("role", "next").count().collect():
        turn[r.role, r.next] += r["count"]
    firsts = rows.groupBy("conv").agg(F.min(F.struct("turn", "role")).alias("f")).groupBy("f.role").count()
    for r in firsts.collect():
        start[r.role] += r["count"]
    return Hmm(np.log(start / start.sum()), np.log(turn / turn.sum(1, keepdims=True)), np.log(looks / looks.sum(1, keepdims=True)), np.log(line / line.sum(1, keepdims=True)))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with the same first `keys` columns."""
    held, key = [], None
    for batch in batches:
        names = batch.schema.names
        for row in batch.to_pylist():
            k = tuple(row[c] for c in names[:keys])
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(row)
    if held:
        yield key, held


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def parse(talks: DataFrame, hmm: Hmm, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", role_marks: bool = True) -> DataFrame:
    """(conv, turn, part, role, text, rendered, marked): one row a recovered turn. Without `role_marks` the role column isn't read."""
    kind = talks.schema[conv_col].dataType.simpleString()
    role = talks[role_col].cast("string") if role_marks else F.lit(None).cast("string")
    rows = talks.select(talks[conv_col].alias("conv"), talks[turn_col].cast("long").alias("turn"), role.alias("role"), talks[text_col].cast("string").alias("text"))
    spool = Spool(talks.sparkSession, "transcripts")
    # all rows in order over the tasks; a block is BLOCK rows in a row of one task, so equal turns are cut as well
    order = ["conv", "turn", "text", "role"]
    rows = rows.withColumn("source", F.monotonically_increasing_id()).repartitionByRange(*order, "source").sortWithinPartitions(*order, "source").drop("source")
    nth = F.col("nth")
    block = F.shiftleft(F.shiftright(nth, 33), 26) + F.floor(nth.bitwiseAND((1 << 33) - 1) / BLOCK)
    rows = spool.table("rows", rows.withColumn("nth", F.monotonically_increasing_id()).withColumn("block", block))
    firsts = rows.groupBy(F.col("conv").alias("c")).agg(F.min("block").alias("first_block"))
    arranged = rows.join(firsts, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "block", (F.col("block") == F.col("first_block")).alias("first"), "nth", "role", "text")
    arranged = arranged.repartition("conv", "block").sortWithinPartitions("conv", "block", "nth")

    def fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []
        for batch in _peek(batches):
            if schema is None:
                schema = pa.schema([("conv", batch[0].schema.field(0).type), ("block", pa.int64()), ("matrix", pa.list_(pa.float64()))])
            for (conv, block, first), own in _groups(iter(batch), 3):
                moves, says, _ = steps_of(hmm, [(r["role"], r["text"]) for r in own])
                out.append((conv, block, fold(moves, says, hmm.start if first else None).ravel().tolist()))
                if len(out) >= 4096:
                    yield _emit(out, schema)
                    out = []
        if out:
            yield _emit(out, schema)

    folded = arranged.mapInArrow(lean(fold_blocks), f"conv {kind}, block bigint, matrix array<double>")

    def settle_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []
        for batch in _peek(batches):
            schema = schema or pa.schema([("conv", batch[0].schema.field(0).type), ("block", pa.int64()), ("before", pa.int32()), ("end", pa.int32())])
            for (conv,), own in _groups(iter(batch), 1):
                ends = settle([np.array(r["matrix"]).reshape(len(ROLES), -1) for r in own])
                out += [(conv, r["block"], b, e) for r, b, e in zip(own, [None, *ends], ends, strict=False)]
                if len(out) >= 4096:
                    yield _emit(out, schema)
                    out = []
        if out:
            yield _emit(out, schema)

    ends = folded.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(settle_all, f"conv {kind}, block bigint, before int, end int")
    ends = ends.select(F.col("conv").alias("c"), F.col("block").alias("b"), "before", "end")
    both = rows.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv", "block", "before", "end", "nth", "turn", "role", "text")

    def decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, size = None, [], 0
        for batch in _peek(batches):
            schema = schema or pa.schema([("conv", batch[0].schema.field(0).type), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("rendered", pa.string()), ("marked", pa.bool_())])
            for (conv, _, before, end), own in _groups(iter(batch), 4):
                moves, says, lines = steps_of(hmm, [(r["role"], r["text"]) for r in own])
                states = decode(moves, says, hmm.start, before, end)
                for row, part, role, text, marked in turns_of(lines, states):
                    out.append((conv, own[row]["turn"], part, role, text, render(role, text), marked))
                    size += len(text)
                if size >= 4_000_000 or len(out) >= 4096:
                    yield _emit(out, schema)
                    out, size = [], 0
        if out:
            yield _emit(out, schema)

    decoded = both.repartition("conv", "block").sortWithinPartitions("conv", "block", "nth").mapInArrow(lean(decode_blocks), f"conv {kind}, turn bigint, part int, role string, text string, rendered string, marked boolean")
    return decoded.withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)


def _peek(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """All batches as one lazy run, so that groups may go over their borders."""
    first = next(batches, None)
    if first is None:
        return

    class Run:
        def __getitem__(self, _):
            return first

        def __iter__(self):
            yield first
            yield from batches

    yield Run()
