"""Chat formatting: speaker roles of transcript lines by a hidden Markov model, then canonical rendering.

A row is a message or a transcript of several. Every line of a row is observed as one symbol made of its speaker
marker (User:, Assistant:, System: and their like) and line features (length, a closing question mark, being the
row's first line). The states are the three roles. A speaker may change where a row begins or a line bears a
marker (the probabilities of turns) and seldom changes otherwise (`STAY`). Start, turn and emission probabilities
are counted from rows with a known role; counting joins each turn with the one before it, so that no conversation
has to be in one task.

Viterbi without a sequential pass over a conversation: the lines of a row make one max-plus matrix, best score by
state before and after the row. Rows are sorted by conversation and place over all tasks, blocks of `BLOCK` rows
are multiplied up, the blocks of a conversation are joined, and each row is traced back between its border states.
The grouped kernels see matrices only, never texts, so what they hold is bounded by rows alone. Each run of lines
of one speaker is rendered as one turn; the role that a row is labelled with is taken for its first run.

Nulls: a null text is an empty line, a null turn number comes first, null conversations form one; rows with one
number are ordered by hash of text and role, identical rows each come out. A role other than the three known ones
counts as unknown. With nothing to learn from, all probabilities are equal up to smoothing and ties go to the
first state. Delimiters inside of a text are escaped (`<|` is written `<||`), so that no text can forge a turn.
Very long texts are whole; extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import settle, shared_folder, table

STATES = ("system", "user", "assistant")
MARKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "prompt", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent", "gpt", "response"),
}
#: The probability that a line without a marker has the speaker of the line before it.
STAY = 0.999
BLOCK = 1024
LENGTHS = (40, 100, 200, 400, 800)
SYMBOLS = 4 * 6 * 2 * 2
NO_STATE = -1


def marker_pattern(state: str) -> str:
    # delimiters of the canonical form are no markers: a text that holds some stays one turn, escaped
    return rf"[\s#*>\[]*(?:{'|'.join(MARKERS[state])})\b[\s*\]]*[:>]"


_MARK = re.compile("|".join(f"({marker_pattern(s)})" for s in STATES), re.IGNORECASE)


def mark_of(line: str) -> int:
    """0 without a marker, else 1 + the state that it names."""
    found = _MARK.match(line)
    return found.lastindex if found else 0


def symbols_of(text: str) -> list[int]:
    """The symbol of every line: ((marker, length), question mark, first line)."""
    out = []
    for k, line in enumerate(text.split("\n")):
        length = sum(len(line) > cut for cut in LENGTHS)
        out.append(((mark_of(line) * 6 + length) * 2 + line.rstrip().endswith("?")) * 2 + (k == 0))
    return out


def prepared(turns: DataFrame) -> DataFrame:
    """u (a number of the row), conv_id, conv, number, turn (a null number as -1), role (known or null), text and tie of every row."""
    role = F.lower(F.trim("role"))
    return turns.select(
        F.monotonically_increasing_id().alias("u"), F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("conv"),
        F.col("turn").cast("long").alias("number"), F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.when(role.isin(*STATES), role).alias("role"), F.col("text").alias("text"), F.xxhash64("text", "role").alias("tie"),
    )


def fit(seen: DataFrame, smoothing: float = 0.5) -> dict[str, np.ndarray]:
    """Log probabilities: start (S), move (S, S) between turns, stay (S, S) within a row, emit (S, SYMBOLS)."""
    known = seen.where("role is not null")

    def count(batches):
        for batch in batches:
            held = np.zeros((3, SYMBOLS), np.int64)
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(held[STATES.index(role)], symbols_of(text or ""), 1)
            state, symbol = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(state, pa.int32()), pa.array(symbol, pa.int32()), pa.array(held[state, symbol])], ["state", "symbol", "n"])

    before = known.select("conv", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before")).groupBy("conv", "turn").agg(F.min("before").alias("before"))
    moves = known.select("conv", "turn", "role").join(before, ["conv", "turn"], "left").groupBy("before", "role").count().collect()  # at most 4 x 3 rows
    emits = known.select("role", "text").mapInArrow(count, "state int, symbol int, n long").groupBy("state", "symbol").agg(F.sum("n").alias("n")).collect()  # at most 3 x SYMBOLS rows
    start, move, emit = np.full(3, smoothing), np.full((3, 3), smoothing), np.full((3, SYMBOLS), smoothing)
    for r in moves:
        if r.before is None:
            start[STATES.index(r.role)] += r["count"]
        else:
            move[STATES.index(r.before), STATES.index(r.role)] += r["count"]
    for r in emits:
        emit[r.state, r.symbol] += r.n
    # a marker names its speaker even where none was seen in training
    for state in range(3):
        emit[state, (state + 1) * 24 : (state + 2) * 24] += 100
    stay = np.where(np.eye(3, dtype=bool), STAY, (1 - STAY) / 2)
    return {"start": np.log(start / start.sum()), "move": np.log(move / move.sum(1, keepdims=True)), "stay": np.log(stay), "emit": np.log(emit / emit.sum(1, keepdims=True))}


def step_of(symbol: int, model: dict[str, np.ndarray]) -> np.ndarray:
    """How a line is entered: as a turn where the row begins or a marker stands, else from the same speaker."""
    return model["move"] if symbol & 1 or symbol >= 24 else model["stay"]


def row_matrix(symbols: list[int], model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best score from the state before the row to its last state, best score by last state from a start here)."""
    inner = model["move"] + model["emit"][None, :, symbols[0]]
    begin = model["start"] + model["emit"][:, symbols[0]]
    for s in symbols[1:]:
        step = step_of(s, model)
        inner = (inner[:, :, None] + step[None]).max(1) + model["emit"][None, :, s]
        begin = (begin[:, None] + step).max(0) + model["emit"][:, s]
    return inner, begin


def trace_row(symbols: list[int], model: dict[str, np.ndarray], before: int, last: int) -> list[int]:
    """The best states of a row's lines, entered from the state `before` (NO_STATE: a start) and left in `last`."""
    score = (model["start"] if before == NO_STATE else model["move"][before]) + model["emit"][:, symbols[0]]
    back = []
    for s in symbols[1:]:
        way = score[:, None] + step_of(s, model)
        back.append(way.argmax(0))
        score = way.max(0) + model["emit"][:, s]
    states = [last]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def segments(text: str, states: list[int], role: str | None) -> list[tuple[str, str]]:
    """(role, content) of each run of lines with one speaker; markers of that speaker are taken off."""
    lines, out = text.split("\n"), []
    cut = [0, *(k for k in range(1, len(lines)) if states[k] != states[k - 1]), len(lines)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        state = STATES.index(role) if role and not a else states[a]
        own = []
        for line in lines[a:b]:
            found = _MARK.match(line)
            own.append(line[found.end() :].lstrip() if found and found.lastindex == state + 1 else line)
        out.append((STATES[state], "\n".join(own).strip()))
    return out


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{content.replace('<|', '<||')}\n<|end|>\n" for role, content in turns)


def _runs(frame: pd.DataFrame, keys: list[str]):
    """(key values, begin, end) of the runs of equal keys in a sorted frame."""
    if not len(frame):
        return
    values = frame[keys].to_numpy()
    cut = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]).any(1), [True])))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield [int(v) for v in values[a]], a, b


def border_states(rows: DataFrame, model: dict[str, np.ndarray], folder: str, block: int = BLOCK, rows_per_call: int = 20_000) -> DataFrame:
    """u, before, last of every row: the best states before it (NO_STATE at a start) and at its end.

    Blocks are dealt to buckets of about rows_per_call rows, so that a call of a kernel decodes many of them.
    """
    total = rows.count()
    buckets = F.lit(total // rows_per_call + 1)

    def matrices(batches):
        for batch in batches:
            out = [np.concatenate([x.ravel() for x in row_matrix(symbols_of(t or ""), model)]).tolist() for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(out, pa.list_(pa.float64()))], ["u", "conv", "turn", "tie", "m"])

    scored = settle(rows.select("u", "conv", "turn", "tie", "text").mapInArrow(matrices, "u long, conv long, turn long, tie long, m array<double>"), folder, "matrices")

    def number(batches):
        from pyspark import TaskContext

        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            places = np.arange(seen, seen + len(batch.column(0)))
            seen += len(places)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places // block), pa.array(places), batch.column(4)], ["u", "conv", "block", "place", "m"])

    # rows in order over all tasks; a place is a task's number and the row's number there
    ordered = scored.repartitionByRange(max(1, total // (64 * block) + 1), "conv", "turn", "tie", "u").sortWithinPartitions("conv", "turn", "tie", "u")
    ordered = settle(ordered.mapInArrow(number, "u long, conv long, block long, place long, m array<double>").withColumn("bucket", F.pmod(F.xxhash64("block"), buckets)), folder, "ordered")

    def of(values) -> tuple[np.ndarray, np.ndarray]:
        m = np.stack(values.to_list())
        return m[:, :9].reshape(-1, 3, 3), m[:, 9:]

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values("place", ignore_index=True), []
        inner, begin = of(frame["m"])
        for (conv, block_no), a, b in _runs(frame, ["conv", "block"]):
            whole, start = inner[a], begin[a]
            for k in range(a + 1, b):
                whole = (whole[:, :, None] + inner[k][None]).max(1)
                start = (start[:, None] + inner[k]).max(0)
            out.append((conv, block_no, whole.ravel().tolist(), start.tolist()))
        return pd.DataFrame(out, columns=["conv", "block", "inner", "begin"])

    pieces = settle(ordered.select("conv", "block", "place", "m", "bucket").groupBy("bucket").applyInPandas(score, "conv long, block long, inner array<double>, begin array<double>"), folder, "pieces")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values(["conv", "block"], kind="stable", ignore_index=True), []
        numbers = frame["block"].to_numpy()
        for (conv,), a, b in _runs(frame, ["conv"]):
            inner = [np.array(frame["inner"].iloc[k]).reshape(3, 3) for k in range(a, b)]
            ends = [np.array(frame["begin"].iloc[a])]
            for m in inner[1:]:
                ends.append((ends[-1][:, None] + m).max(0))
            last = [int(ends[-1].argmax())]
            for k in range(len(inner) - 1, 0, -1):
                last.append(int((ends[k - 1] + inner[k][:, last[-1]]).argmax()))
            last.reverse()
            out += zip([conv] * len(last), numbers[a:b].tolist(), [NO_STATE, *last[:-1]], last, strict=True)
        return pd.DataFrame(out, columns=["conv", "block", "before", "last"])

    meeting = pieces.withColumn("bucket", F.pmod(F.xxhash64("conv"), buckets))
    borders = meeting.groupBy("bucket").applyInPandas(join, "conv long, block long, before int, last int").withColumn("bucket", F.pmod(F.xxhash64("block"), buckets))
    borders = settle(borders, folder, "borders")

    def states(frame: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["u", "before", "last"])
        frame = frame.sort_values("place", ignore_index=True)
        inner, begin = of(frame["m"])
        held = {(c, k): (e, s) for c, k, e, s in border[["conv", "block", "before", "last"]].itertuples(index=False)}
        before, last = np.full(len(frame), NO_STATE), np.zeros(len(frame), int)
        for key, a, b in _runs(frame, ["conv", "block"]):
            entry, last[b - 1] = held[tuple(key)]
            ends = [begin[a] if entry == NO_STATE else inner[a][entry]]
            for k in range(a + 1, b):
                ends.append((ends[-1][:, None] + inner[k]).max(0))
            for k in range(b - 1, a, -1):
                before[k] = last[k - 1] = int((ends[k - 1 - a] + inner[k][:, last[k]]).argmax())
            before[a] = entry
        return pd.DataFrame({"u": frame["u"], "before": before, "last": last})

    pair = ordered.select("u", "conv", "block", "place", "m", "bucket").groupBy("bucket").cogroup(borders.groupBy("bucket"))
    return settle(pair.applyInPandas(states, "u long, before int, last int"), folder, "states")


def format_chats(turns: DataFrame, train=None, folder: str | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, role, recovered (of the first line), n_turns and rendered of every row; `train` selects the rows to learn from."""
    folder = folder or shared_folder(turns.sparkSession)
    rows = settle(prepared(turns), folder, "rows")
    model = fit(rows if train is None else rows.where(train))
    states = border_states(rows, model, folder, block)

    def finish(batches):
        for batch in batches:
            out = []
            for role, text, before, last in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                text = text or ""
                found = trace_row(symbols_of(text), model, before, last)
                parts = segments(text, found, role)
                out.append((STATES[found[0]], len(parts), render(parts)))
            recovered, n, rendered = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(recovered, pa.string()), pa.array(n, pa.int64()), pa.array(rendered, pa.string())], ["conv_id", "turn", "role", "recovered", "n_turns", "rendered"])

    met = rows.join(states, "u").select("conv_id", F.col("number").alias("turn"), "role", "text", "before", "last")
    return met.mapInArrow(finish, "conv_id long, turn long, role string, recovered string, n_turns long, rendered string")


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Contract query: every row; learned from conversations whose crc32 modulo 7 is not 2."""
    rows = format_chats(table(spark, sf_dir, "conversations"), F.expr("crc32(cast(cast(conv_id AS string) AS binary)) % 7 <> 2"))
    return rows.withColumn("held_out", F.coalesce(F.expr("crc32(cast(cast(conv_id AS string) AS binary)) % 7 = 2"), F.lit(False)))
