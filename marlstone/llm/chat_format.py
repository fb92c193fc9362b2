"""Transcript parsing: a hidden Markov model recovers roles, then turns are rendered canonically.

A transcript is plain text. Its lines are observations: which speaker marker a
line begins with, whether a blank line stands before it, how long it is, and how
it ends. The hidden states are roles, each as the first line of a turn or one
that goes on. Viterbi finds the likeliest state sequence; a first-line state
opens a turn, whose marker is taken off. The probabilities of unmarked lines are
parameters that can be counted on transcripts with known roles (fit).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy

ROLES = ("system", "user", "assistant")
# Names that speakers go by, lower case.
NAMES = {
    "system": "system", "sys": "system", "instructions": "system",
    "user": "user", "human": "user", "question": "user", "q": "user", "customer": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant", "model": "assistant", "agent": "assistant",
}
MARKER = re.compile(r"\s{0,3}(?:<\|?|\[|\*\*|#{1,4} {0,2})?(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")(?:\|?>|\]|\*\*)?\s{0,2}(?:[:>]|(?<=[>\]*])(?!\S)|(?<=[>\]])) ?", re.I)
STATES = [(r, opening) for r in range(len(ROLES)) for opening in (True, False)]
SCHEMA = "n_turns long, n_parsed long, n_unknown long, n_same long, roles string, rendered string"
SHAPES = 16
FLOOR = 1e-3


def shape(line: str, blank_before: bool) -> int:
    """Which of SHAPES kinds of line it is: blank before, question mark, length."""
    text = line.strip()
    size = 0 if not text else 1 if len(text) < 60 else 2 if len(text) < 250 else 3
    return 8 * blank_before + 4 * text.endswith("?") + size


def marker(line: str) -> tuple[int, int]:
    """(role or -1, where the text after the marker begins)."""
    m = MARKER.match(line)
    return (ROLES.index(NAMES[m[1].lower()]), m.end()) if m else (-1, 0)


def defaults() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, transition, emission of shapes) as log probabilities, without any counts."""
    n = len(STATES)
    start, move = np.full(n, FLOOR), np.full((n, n), FLOOR)
    for s, (role, opening) in enumerate(STATES):
        if opening:
            start[s] = (0.3, 0.6, 0.1)[role]
        for t, (other, opens) in enumerate(STATES):
            if not opens:
                move[s, t] = 0.7 if other == role else 0
            else:
                move[s, t] = {(0, 1): 0.28, (1, 2): 0.28, (2, 1): 0.28}.get((role, other), 0.01)
    shapes = np.full((n, SHAPES), 1.0)
    shapes[0::2, 8:] = 2.0
    with np.errstate(divide="ignore"):
        return np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(shapes / shapes.sum(1, keepdims=True))


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, shapes: np.ndarray) -> None:
        self.start, self.move, self.shapes = start, move, shapes

    def emission(self, role: int, kind: int) -> np.ndarray:
        """A marked line opens a turn of its role but for noise; an unmarked one may open a turn too, rarely."""
        out = self.shapes[:, kind].copy()
        for s, (own, opening) in enumerate(STATES):
            if role < 0:
                out[s] += np.log(0.05 if opening else 1 - 3 * FLOOR)
            else:
                out[s] += np.log(0.9 if opening and own == role else FLOOR)
        return out

    def decode(self, lines: list[str]) -> list[tuple[int, bool, int]]:
        """(role, opens a turn, where its text begins) of each line, by Viterbi. Ties go to the first state."""
        if not lines:
            return []
        marks = [marker(x) for x in lines]
        score, back = None, np.empty((len(lines), len(STATES)), np.int8)
        blank = False
        for i, (line, (role, _)) in enumerate(zip(lines, marks, strict=True)):
            own = self.emission(role, shape(line, blank))
            if score is None:
                score = self.start + own
            else:
                paths = score[:, None] + self.move
                back[i] = paths.argmax(0)
                score = paths.max(0) + own
            blank = not line.strip()
        states = [int(score.argmax())]
        for b in back[:0:-1]:
            states.append(int(b[states[-1]]))
        states.reverse()
        return [(STATES[s][0], STATES[s][1], at if STATES[s][1] and role == STATES[s][0] else 0) for s, (role, at) in zip(states, marks, strict=True)]


def placed_turns(text: str, model: Model) -> tuple[list[dict], list[int]]:
    """The transcript's turns and the line that each begins at; text without lines has none. Turns of one role in a row stay apart."""
    lines = text.split("\n") if text else []
    roles: list[str] = []
    own: list[list[str]] = []
    first: list[int] = []
    for i, (line, (role, opens, at)) in enumerate(zip(lines, model.decode(lines), strict=True)):
        if opens or not roles or roles[-1] != ROLES[role]:
            roles.append(ROLES[role])
            own.append([line[at:]])
            first.append(i)
        else:
            own[-1].append(line)
    return [{"role": r, "text": "\n".join(x).strip("\n")} for r, x in zip(roles, own, strict=True)], first


def turns(text: str, model: Model) -> list[dict]:
    return placed_turns(text, model)[0]


def render(found: list[dict]) -> str:
    """Canonical form: a header line for each turn, its text, an end line."""
    return "".join(f"<|{t['role']}|>\n{t['text']}\n<|end|>\n" for t in found)


def line_shapes(conversations: DataFrame) -> DataFrame:
    """(role, opens, shape) of all lines of turns whose role is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, int] = {}
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blank = False
                for i, line in enumerate((text or "").split("\n")):
                    key = (role, i == 0, shape(line, blank))
                    total[key] = total.get(key, 0) + 1
                    blank = not line.strip()
            rows = [(*k, n) for k, n in total.items()]
            role, opens, kind, n = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(role, pa.string()), pa.array(opens, pa.bool_()), pa.array(kind, pa.int32()), pa.array(n, pa.int64())], names=["role", "opens", "shape", "n"])

    part = conversations.select("role", "text").mapInArrow(tidy(run), "role string, opens boolean, shape int, n long")
    return part.groupBy("role", "opens", "shape").agg(F.sum("n").alias("n"))


def parse(transcripts: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Each transcript (conv_id, given, lines), decoded as a whole: what came in, what came back, and how it is rendered.

    given are the roles of the turns put in, lines their texts with markers.
    n_unknown turns had no role that NAMES knows; of the others, n_same came back
    with their role from their first line on. Empty texts have no turns.
    """
    held = transcripts.sparkSession.sparkContext.broadcast(model or defaults())

    def decode(given: list[str | None], lines: list[str], own: Model) -> tuple:
        found, first = placed_turns("\n".join(lines), own)
        begins = np.cumsum([0] + [x.count("\n") + 1 for x in lines[:-1]]).tolist()
        back = dict(zip(first, (t["role"] for t in found), strict=True))
        known = [NAMES.get((r or "").strip().lower()) for r in given]
        same = sum(r is not None and back.get(b) == r for r, b in zip(known, begins, strict=True))
        return len(lines), len(found), known.count(None), same, ",".join(t["role"] for t in found), render(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [decode(g, x, own) for g, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["conv_id", *(x.split(" ")[0] for x in SCHEMA.split(", "))])

    schema = f"conv_id {transcripts.schema['conv_id'].dataType.simpleString()}"
    return transcripts.select("conv_id", "given", "lines").mapInArrow(tidy(run), f"{schema}, {SCHEMA}")


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as plain text, a string for each turn: (conv_id, given, lines).

    Null roles leave their turns unmarked; roles that NAMES doesn't know stand
    before theirs as any text; null texts are empty; null turns come first; ties
    go by role and text. A row without a conversation id is a conversation of its
    own. All turns of a conversation come to one row, as its rendered text does.
    """
    line = F.concat(F.coalesce(F.concat("role", F.lit(": ")), F.lit("")), F.coalesce("text", F.lit("")))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = conversations.select("conv_id", alone.alias("alone"), F.struct("turn", "role", line.alias("line")).alias("x")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return grouped.select("conv_id", F.transform("xs", lambda x: x["role"]).alias("given"), F.transform("xs", lambda x: x["line"]).alias("lines"))


def fit(shapes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions of line shapes from their counts (role, opens, shape, n); a few dozen rows reach the driver."""
    start, move, emit = defaults()
    counts = np.exp(emit) * 10
    for role, opens, kind, n in shapes.collect():
        if role in ROLES:
            counts[STATES.index((ROLES.index(role), bool(opens))), kind] += n
    return start, move, np.log(counts / counts.sum(1, keepdims=True))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: turns put in, recovered, of unknown role and recovered alike, roles and rendered text.

    Turns whose text holds lines that look like markers come back as more turns
    than were put in; n_parsed and n_same tell. Texts of any length are decoded
    whole. An empty table gives no rows. Other columns are ignored.
    """
    return parse(transcripts(conversations), model=fit(line_shapes(conversations)))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
