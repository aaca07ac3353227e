"""Operator 7: transcripts to chat turns by a hidden Markov model.

States are the speaker roles. A segment (a turn, or a line of a raw transcript) is seen through two kinds of features: the
speaker marker it starts with, if any, and line features (length class, question, code or list, opening of the
conversation). Start, transition and emission probabilities are counts over segments of known role, smoothed by one; the
tables they make have a fixed size. Viterbi recovers the roles of each conversation; markers are then cut and each turn is
rendered as ``<|role|>`` line, text, ``<|end|>`` line.

Long conversations are decoded in pieces of CHUNK segments: each piece is first summed up as a matrix (the best way
through it from each role before it to each role at its end), pieces of pieces likewise, and the roles at their borders
are fixed from the top down. No task holds more than about CHUNK segments or matrices of one conversation.

Null and empty texts are segments without features. A segment without ``conv_id`` or ``turn`` is a conversation of its own.
Segments that repeat (same conversation, turn, role and text) count as one. Of segments with the same turn, the order is that of
role and text. An unknown or null role teaches nothing. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Shelf, runs

ROLES = ["system", "user", "assistant", "tool"]
CHUNK = 256

# Words before a colon (or in brackets or after hashes) that name a speaker, by role.
SPEAKERS = {
    "system": "system|instructions?|context",
    "user": "user|human|question|customer|client|me|q",
    "assistant": "assistant|ai|bot|model|answer|agent|support|a",
    "tool": "tool|function|output|observation|result",
}
_MARKER = "^\\s*(?:[#>*\\-\\[(<|]+\\s*)?({names})(?:\\s*[\\])>|*]+)?\\s*[:：\\])>|]\\s*"


def marker_pattern(role: str | None = None) -> str:
    return "(?i)" + _MARKER.replace("{names}", SPEAKERS[role] if role else "|".join(SPEAKERS.values()))


def marker(text: Column) -> Column:
    """Number of the role whose speaker word the text starts with, -1 without one."""
    out = F.lit(-1)
    for i, role in reversed(list(enumerate(ROLES))):
        out = F.when(text.rlike(marker_pattern(role)), i).otherwise(out)
    return out


def line_feature(text: Column) -> Column:
    """One of 36: length class (6) by closing question (2) by kind (plain, list, code)."""
    size = F.length(text)
    length = F.when(size < 40, 0).when(size < 120, 1).when(size < 250, 2).when(size < 500, 3).when(size < 1000, 4).otherwise(5)
    asks = text.rlike("[?？]\\s*$").cast("int")
    kind = F.when(text.contains("```") | text.rlike("(?m)^\\s*(?:def |class |import |[{}]|#include)"), 2).when(
        text.rlike("(?m)^\\s*(?:[-*•]|\\d+[.)])\\s"), 1).otherwise(0)
    return length * 6 + asks * 3 + kind


MARKS, LINES = len(ROLES) + 1, 36


def segments_of(transcripts: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the lines of raw transcripts (conv_id, text), each a segment of unknown role."""
    return transcripts.select(F.col("conv_id"), F.posexplode(F.split("text", "\n")).alias("turn", "text")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), "text")


def observe(segments: DataFrame) -> DataFrame:
    """The different segments with their features and the number of their known role (-1 if none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.lower(F.trim("role"))) - 1, F.lit(-1)).cast("int")
    out = segments.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                          F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    single = F.col("conv_id").isNull() | F.col("turn").isNull()
    return out.select(
        "*", known.alias("known"), marker(text).cast("int").alias("mark"), line_feature(text).cast("int").alias("line"),
        # A segment without a place is keyed by its own content.
        F.when(single, F.xxhash64("conv_id", "turn", "role", "text")).otherwise(F.col("conv_id")).alias("k"),
        single.alias("single"), F.coalesce(F.floor(F.when(single, 0).otherwise(F.col("turn")) / CHUNK), F.lit(0)).alias("piece"))


def estimate(observed: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities from segments of known role: start, move (from, to), mark (role, mark), line (role, line)."""
    n = len(ROLES)
    known = observed.where("known >= 0 AND NOT single")
    before = known.select("k", (F.col("turn") + 1).alias("turn"), F.col("known").alias("was"))
    moves = known.select("k", "turn", "known").join(before, ["k", "turn"], "left").groupBy("was", "known").agg(F.count(F.lit(1)))
    first = known.groupBy("k").agg(F.min_by("known", "turn").alias("known")).groupBy("known").agg(F.count(F.lit(1)))
    start, move, mark, line = np.ones(n), np.ones((n, n)), np.ones((n, MARKS)), np.ones((n, LINES))
    for i, role in enumerate(ROLES):  # a marker speaks for its role even where no example has one
        mark[i, ROLES.index(role) + 1] += 50
    for r, c in first.collect():
        start[r] += c
    for a, b, c in moves.collect():
        if a is not None:
            move[a, b] += c
    for r, m, c in known.groupBy("known", "mark").agg(F.count(F.lit(1))).collect():
        mark[r, m + 1] += c
    for r, x, c in known.groupBy("known", "line").agg(F.count(F.lit(1))).collect():
        line[r, x] += c
    return {k: np.log(v / v.sum(axis=-1, keepdims=True)) for k, v in
            {"start": start, "move": move, "mark": mark, "line": line}.items()}


def _emissions(p: dict[str, np.ndarray], marks: np.ndarray, lines: np.ndarray) -> np.ndarray:
    return p["mark"][:, marks + 1].T + p["line"][:, lines].T


def _steps(p: dict[str, np.ndarray]) -> np.ndarray:
    """Rows: the role before (the last row: none, at the start); columns: the next role."""
    return np.vstack([p["move"], p["start"]])


def through(p: dict[str, np.ndarray], emissions: np.ndarray) -> np.ndarray:
    """Best log probability from each role before a run of segments (or the start) to each role at its end."""
    best = _steps(p) + emissions[0]
    for e in emissions[1:]:
        best = (best[:, :, None] + p["move"][None]).max(axis=1) + e
    return best


def decode(steps: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """The best roles after each step, from ``entry`` to ``leave`` (-1: any); a step has a row per role before it."""
    score, back = steps[0][entry], []
    for step in steps[1:]:
        ways = score[:, None] + step[:len(ROLES)]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    at = int(score.argmax()) if leave < 0 else leave
    out = [at]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


_LEVEL = "k long, single boolean, piece long, m array<double>"
_START = len(ROLES)


def recover(observed: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """``observed`` with ``recovered``, the role that the best path through the conversation gives each segment."""
    shelf = Shelf(observed.sparkSession)
    order = ["turn", "role", "text"]
    size = len(ROLES) + 1

    def dealt(df: DataFrame, *more: str) -> DataFrame:
        return df.repartition("k", "piece").sortWithinPartitions("k", "single", "piece", *more)

    def sum_up(frames):
        out = [(k, single, piece, through(p, _emissions(p, g["mark"].to_numpy(), g["line"].to_numpy())).ravel().tolist())
               for (k, single, piece), g in runs(frames, ["k", "single", "piece"])]
        yield pd.DataFrame(out, columns=["k", "single", "piece", "m"])

    def sum_pieces(frames):
        out = []
        for (k, single, piece), g in runs(frames, ["k", "single", "piece"]):
            steps = [np.array(m).reshape(size, -1) for m in g["m"]]
            best = steps[0]
            for step in steps[1:]:
                best = (best[:, :, None] + step[None, :len(ROLES)]).max(axis=1)
            out.append((k, single, piece, best.ravel().tolist()))
        yield pd.DataFrame(out, columns=["k", "single", "piece", "m"])

    def fix_pieces(frames):
        out = []
        for (k, single, _), g in runs(frames, ["k", "single", "piece"]):
            entry, leave = int(g["entry"].iloc[0]), int(g["leave"].iloc[0])
            roles = decode([np.array(m).reshape(size, -1) for m in g["m"]], entry, leave)
            out += [(k, single, child, a, b) for child, a, b in zip(g["child"], [entry, *roles[:-1]], roles, strict=True)]
        yield pd.DataFrame(out, columns=["k", "single", "piece", "entry", "leave"])

    # Up: pieces of CHUNK segments, then pieces of CHUNK pieces, until no conversation has more than one.
    levels = [shelf.put(dealt(observed.select("k", "single", "piece", "mark", "line", *order), *order).mapInPandas(sum_up, _LEVEL), "pieces")]
    while not levels[-1].groupBy("k", "single").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        up = levels[-1].select("k", "single", F.floor(F.col("piece") / CHUNK).alias("piece"), F.col("piece").alias("child"), "m")
        levels.append(shelf.put(dealt(up, "child").mapInPandas(sum_pieces, _LEVEL), "pieces"))
        if len(levels) > 12:  # turns as far apart as a long allows meet in a few levels
            break
    borders = levels[-1].select("k", "single", "piece", F.lit(_START).alias("entry"), F.lit(-1).alias("leave"))
    # Down: the roles at the borders of each piece's pieces.
    for level in levels[-2::-1]:
        down = level.select("k", "single", F.floor(F.col("piece") / CHUNK).alias("piece"), F.col("piece").alias("child"), "m").join(
            borders, ["k", "single", "piece"])
        borders = shelf.put(dealt(down, "child").mapInPandas(
            fix_pieces, "k long, single boolean, piece long, entry int, leave int"), "borders")

    def fix_segments(frames):
        for (_, _, _), g in runs(frames, ["k", "single", "piece"]):
            e = _emissions(p, g["mark"].to_numpy(), g["line"].to_numpy())
            steps = [_steps(p) + x for x in e]
            roles = decode(steps, int(g["entry"].iloc[0]), int(g["leave"].iloc[0]))
            yield g.drop(columns=["entry", "leave"]).assign(recovered=[ROLES[r] for r in roles])

    whole = observed.join(borders, ["k", "single", "piece"])
    names = [c for c in whole.columns if c not in ("entry", "leave")]
    schema = ", ".join(f"{c} {t}" for c, t in whole.dtypes if c in names) + ", recovered string"
    return dealt(whole, *order).mapInPandas(fix_segments, schema)


def render(recovered: DataFrame) -> DataFrame:
    """(conv_id, turn, role, recovered, rendered): each segment in its canonical form, its speaker marker cut."""
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), marker_pattern(), ""))
    return recovered.select("conv_id", "turn", "role", "recovered", F.concat(
        F.lit("<|"), F.col("recovered"), F.lit("|>\n"), body, F.lit("\n<|end|>\n")).alias("rendered"))


def parse(segments: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Roles recovered and turns rendered for ``segments`` (conv_id, turn, role, text); learnt from ``known``, by default themselves."""
    shelf = Shelf(segments.sparkSession)
    observed = shelf.put(observe(segments), "segments")
    return render(recover(observed, estimate(observed if known is None else observe(known))))
