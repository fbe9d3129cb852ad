"""Chat formatting: speaker roles of transcripts by a hidden Markov model, then canonical turns.

A conversation is its rows in order of (turn, text, role); each row's text is split into lines. What is seen of a line is
a speaker marker (one written at its start, or on a row's first line the row's role), whether it asks, instructs, greets,
lists or codes, and its length. The hidden state is its true role. Scores are thousandths of natural logarithms as
whole numbers, so sums do not depend on their order, and Viterbi takes the first role in the order of ROLES among equals.

Conversations have no bound on their rows. Sorted rows are cut into blocks; over a block, Viterbi is one matrix of
best scores from role to role, and matrices combine by (max, +). One pass over a conversation's matrices (a few numbers for
each block) carries scores forward; every block is then decoded by itself, for each role it may end in; a pass backward picks
the one it does end in. The result is that of one Viterbi run over the whole conversation.

A null conv_id is a conversation of its own, a null turn comes first, null text is one empty line, a null or unknown role is no marker.
Repeated rows are repeated turns. Rows that tie are equal in all that counts. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialize, table

ROLES = ("system", "user", "assistant", "tool")
BLOCK = 512
#: Fixed names of speakers, lower-cased.
MARKERS = {
    "system": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "customer": "user", "prompter": "user", "question": "user", "q": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "gpt": "assistant", "model": "assistant", "answer": "assistant", "a": "assistant",
    "tool": "tool", "function": "tool", "observation": "tool", "result": "tool",
}
_MARKER = re.compile(r"^\s*(?:[#*>\[(-]{1,4}\s*|<\|?(?:im_start\|>)?)?(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")(?:\*{1,2}|[\])]|\|>)?\s*(?::|\|>|>)(?:\*{1,2})?\s*", re.IGNORECASE)
_GREETING = re.compile(r"^\s*(hi|hello|hey|dear|thanks|thank you|please)\b", re.IGNORECASE)
_INSTRUCTION = re.compile(r"^\s*(you are|your task|you will|always|never|act as)\b", re.IGNORECASE)
_CODE = re.compile(r"^\s*(```|\$ |>>> |\{|\[\{|import |def |[-*•] |\d+[.)] )")


def _log(p: float) -> int:
    return round(1000 * float(np.log(p)))


#: What each role's lines show: chance of each feature, in the order of ROLES.
MARKED, MISMARKED = 0.94, 0.02
CHANCES = {
    "asks": (0.02, 0.35, 0.08, 0.01),
    "greets": (0.01, 0.08, 0.03, 0.01),
    "instructs": (0.30, 0.03, 0.02, 0.01),
    "lists": (0.08, 0.03, 0.20, 0.40),
    "long": (0.30, 0.20, 0.40, 0.30),
}
#: From role to role between rows and between lines of a row; the last row is the start of a conversation.
BETWEEN_ROWS = ((0.10, 0.80, 0.09, 0.01), (0.02, 0.10, 0.83, 0.05), (0.01, 0.85, 0.10, 0.04), (0.01, 0.09, 0.85, 0.05), (0.30, 0.60, 0.08, 0.02))
WITHIN_ROW = ((0.88, 0.04, 0.04, 0.04), (0.04, 0.88, 0.04, 0.04), (0.04, 0.04, 0.88, 0.04), (0.04, 0.04, 0.04, 0.88), (0.25, 0.25, 0.25, 0.25))
N, START, NEVER = len(ROLES) + 1, len(ROLES), -(1 << 50)


def _steps(chances) -> np.ndarray:
    """(N, N) scores of going from a state to a role; none goes to the start."""
    out = np.full((N, N), NEVER, np.int64)
    out[:, :START] = [[_log(p) for p in row] for row in chances]
    return out


ROWS, LINES = _steps(BETWEEN_ROWS), _steps(WITHIN_ROW)
_YES = {k: np.array([_log(p) for p in v]) for k, v in CHANCES.items()}
_NO = {k: np.array([_log(1 - p) for p in v]) for k, v in CHANCES.items()}
#: Scores of the roles by what a line shows, bit i for the i-th of CHANCES; and by the marker it bears, the last for none.
_SHOWN = np.array([sum((_YES if bits >> i & 1 else _NO)[k] for i, k in enumerate(CHANCES)) for bits in range(1 << len(CHANCES))])
_SAID = np.array([[_log(MARKED if r == s else MISMARKED) for s in ROLES] for r in ROLES] + [[0] * len(ROLES)])
_NONE = len(ROLES)


def unmarked(line: str) -> str:
    """The line without its marker."""
    m = _MARKER.match(line)
    return line[m.end() :] if m else line


def row_scores(text: str | None, role: str | None) -> np.ndarray:
    """(lines, roles): the score of each role for each line of a row."""
    given = MARKERS.get((role or "").strip().lower())
    shown, said = [], []
    for i, line in enumerate((text or "").split("\n")):
        m = _MARKER.match(line)
        mark = MARKERS[m[1].lower()] if m else given if i == 0 else None
        rest = line[m.end() :] if m else line
        asks, greets, instructs, lists = rest.rstrip().endswith(("?", "？")), bool(_GREETING.match(rest)), bool(_INSTRUCTION.match(rest)), bool(_CODE.match(rest))
        shown.append(asks | greets << 1 | instructs << 2 | lists << 3 | (len(rest) > 200) << 4)
        said.append(ROLES.index(mark) if mark else _NONE)
    return _SHOWN[shown] + _SAID[said]


def steps(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(lines, N, N): scores of going from a state to a role that shows a line; first: whether a line is its row's first."""
    out = np.where(first[:, None, None], ROWS, LINES)
    out[:, :, :START] += scores[:, None, :]
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) products of matrices, or of rows of matrices."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(axis=-2), NEVER)


def product(matrices: np.ndarray) -> np.ndarray:
    """The (max, +) product of matrices in order, neighbours first: it does not depend on how they are bracketed."""
    while len(matrices) > 1:
        pairs = combine(matrices[: len(matrices) // 2 * 2 : 2], matrices[1::2])
        matrices = np.concatenate([pairs, matrices[-1:]]) if len(matrices) % 2 else pairs
    return matrices[0]


def viterbi(alpha: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores at the end, and for each last state the states from the entry on: (N, steps + 1). The first of equals wins."""
    back = []
    for step in steps:
        both = alpha[:, None] + step
        back.append(both.argmax(axis=0))
        alpha = np.maximum(both.max(axis=0), NEVER)
    paths = np.empty((N, len(steps) + 1), np.int8)
    paths[:, -1] = np.arange(N)
    for i in range(len(steps) - 1, -1, -1):
        paths[:, i] = back[i][paths[:, i + 1]]
    return alpha, paths


BLOCKS = "conv_id long, part int, block int, matrix array<long>, scores array<long>, lines array<int>, rows array<struct<turn: long, role: string, text: string>>"
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _first(lines: list[int]) -> np.ndarray:
    """Whether a line is its row's first, from the lines of each row."""
    out = np.zeros(sum(lines), bool)
    out[np.cumsum([0, *lines[:-1]])] = True
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    held: list[dict] = []
    conv, block, chars = None, 0, 0

    def done() -> pa.RecordBatch:
        each = [row_scores(r["text"], r["role"]) for r in held]
        lines, scores = list(map(len, each)), np.concatenate(each)
        matrix = product(steps(scores, _first(lines)))
        cols = ([conv], pa.int64()), ([part], pa.int32()), ([block], pa.int32()), ([matrix.ravel()], pa.list_(pa.int64())), ([scores.ravel()], pa.list_(pa.int64())), ([lines], pa.list_(pa.int32())), ([held], pa.list_(_ROW))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in cols], ["conv_id", "part", "block", "matrix", "scores", "lines", "rows"])

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv_id"] != conv or len(held) >= size or chars > most_chars):
                yield done()
                block += 1
                held, chars = [], 0
            conv = row["conv_id"]
            held.append({k: row[k] for k in ("turn", "role", "text")})
            chars += len(row["text"] or "")
    if held:
        yield done()


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices in order of (conv_id, part, block) to the scores before each block."""
    conv, alpha = object(), None
    for batch in batches:
        out = []
        for c, matrix in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if c != conv:
                conv, alpha = c, np.where(np.arange(N) == START, 0, NEVER)
            out.append(alpha.tolist())
            alpha = np.maximum((alpha[:, None] + np.array(matrix).reshape(N, N)).max(axis=0), NEVER)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int64()))], ["part", "block", "alpha"])


DECODED = "conv_id long, part int, block int, scores array<long>, entry array<int>, paths array<binary>"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv_id, part, block, scores, lines, alpha) to DECODED."""
    for batch in batches:
        for r in batch.to_pylist():
            each = np.array(r["scores"], np.int64).reshape(-1, START)
            scores, paths = viterbi(np.array(r["alpha"]), steps(each, _first(r["lines"])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["conv_id"]], pa.int64()), pa.array([r["part"]], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([scores.tolist()], pa.list_(pa.int64())), pa.array([paths[:, 0].tolist()], pa.list_(pa.int32())), pa.array([[p[1:].tobytes() for p in paths]], pa.list_(pa.binary()))],
                ["conv_id", "part", "block", "scores", "entry", "paths"],
            )


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the last to the first of each conversation to the state each ends in."""
    conv, state = object(), 0
    for batch in batches:
        out = []
        for c, scores, entry in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if c != conv:
                conv, state = c, int(np.argmax(scores))
            out.append(state)
            state = entry[state]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.int32())], ["part", "block", "end"])


TURNS = "conv_id long, turn long, part int, role_given string, role string, text string, rendered string"


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


def turns(row: dict, states: bytes) -> Iterator[tuple[int, str, str]]:
    """(part, role, text) of a row: lines in a row with one role make one turn; empty lines at its ends go."""
    lines = [unmarked(x) for x in (row["text"] or "").split("\n")]
    at = part = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or states[i] != states[at]:
            yield part, ROLES[states[at]], "\n".join(lines[at:i]).strip("\n")
            at, part = i, part + 1


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            states, at, out = r["path"], 0, []
            for row in r["rows"]:
                n = (row["text"] or "").count("\n") + 1
                out += [(r["conv_id"], row["turn"], part, row["role"], role, text, render(role, text)) for part, role, text in turns(row, states[at : at + n])]
                at += n
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "turn", "part", "role_given", "role", "text", "rendered"])


def chat_format(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv_id, turn, role, text) to canonical turns: conv_id, turn, part (of a row that holds several), role_given,
    role (recovered), text (without markers) and rendered."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").withColumn("_tie", F.rand(1))
    # The tie is drawn for rows that are equal otherwise, so that they too can be dealt to several tasks.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "conv_id", "turn", "text", "role", "_tie").sortWithinPartitions("conv_id", "turn", "text", "role")
    blocks = materialize(rows.drop("_tie").mapInArrow(lambda it: _blocks(it, block), BLOCKS), "chat-blocks")
    light = blocks.select("conv_id", "part", "block", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    alphas = light.mapInArrow(_forward, "part int, block int, alpha array<long>")
    decoded = blocks.select("conv_id", "part", "block", "scores", "lines").join(alphas, ["part", "block"]).select("conv_id", "part", "block", "scores", "lines", "alpha").mapInArrow(_decode, DECODED)
    decoded = materialize(decoded, "chat-decoded")
    light = decoded.select("conv_id", "part", "block", "scores", "entry").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    ends = light.mapInArrow(_backward, "part int, block int, end int")
    paths = decoded.join(ends, ["part", "block"]).select("part", "block", F.expr("paths[end]").alias("path"))
    return blocks.join(paths, ["part", "block"]).select("conv_id", "rows", "path").mapInArrow(_render, TURNS)


def op1_chat_format(spark, sf_dir):
    return chat_format(table(spark, sf_dir, "conversations"))
