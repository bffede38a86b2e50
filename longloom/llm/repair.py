"""Repair of the structure of conversations at the least cost, by Four-Russians block tables.

A conversation's rows are edited until its roles read ``(s?(ua)+)?``: at most one system row, then user and assistant in
turn. Keeping a row is free unless it is truncated (1), a new role costs 2 (a truncated row 1 more), deleting 3, inserting
an empty row 2. Blank and duplicate rows must go. Of the cheapest ways the one whose letters D, I, K, R come first is taken.

The grammar has four states (nothing yet, after s, after u, after a). What the rest of a conversation costs from each of
them is a vector of four numbers. Less their minimum only some tens of such vectors exist, and a row, of which there are
nine kinds, turns one into another. Tables hold for every block of ``BLOCK`` kinds and every vector after it the vector
before it, what it adds, and the state that each state is led to. A conversation is read from its end, a block for each
lookup; then it is traced from its start, each block expanded backward into the vectors between its rows, from which the
first letter that keeps to the least cost is known for every row.

Rows are put in order and numbered once. Numbers cut them into segments of at most ``SEGMENT`` rows, each a short string of
kinds, so that a conversation of any length is solved in many tasks: the tables make a segment a function from the vector
behind it, and only these functions, a few hundred bytes each, meet in one task for a conversation of several segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.numbering import ordered_index
from ..session import materialize
from .worker import kept

BLOCK = 4
SEGMENT = 4096
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
# kinds of rows: padding, one that must go, then the role's initial (s, u, a, another) whole or truncated
KINDS = "-XsSuUaAoO"
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
_TURN = (USER, USER, ASSISTANT, USER)  # where a user or assistant row leads that fits
_NAMES = {USER: "u", ASSISTANT: "a"}


def closed(costs: list[int]) -> tuple[int, ...]:
    """The costs if empty rows may be inserted first."""
    costs = list(costs)
    for _ in range(3):
        costs = [min(c, INSERT + costs[_TURN[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


END = closed([0, 99, 99, 0])


def options(kind: str, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of each edit of a row; letters in order. Rows given a role have ``u`` or ``a``."""
    out = [("D", DELETE, state)]
    if kind != "X":
        late = CUT_OFF * kind.isupper()
        if state in _KEEP[kind.lower()]:
            out.append(("K", late, _KEEP[kind.lower()][state]))
        out.append((_NAMES[_TURN[state]], REROLE + late, _TURN[state]))
    return out


def before(kind: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """What is to come costs before a row, from what it costs after it."""
    if kind == "-":
        return after
    return closed([min(c + after[to] for _, c, to in options(kind, q)) for q in range(4)])


def step(kind: str, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The letters at a row, inserted rows (``U``, ``A``) first, and the state behind it."""
    if kind == "-":
        return "", state
    left, letters = before(kind, after), ""
    while True:
        edits = {letter: to for letter, c, to in options(kind, state) if c + after[to] == left[state]}
        if "D" in edits:
            return letters + "D", edits["D"]
        if INSERT + left[_TURN[state]] == left[state]:
            state = _TURN[state]
            letters += _NAMES[state].upper()
        else:  # K is before R, and only one of u and a fits
            letter = min(edits)
            return letters + letter, edits[letter]


def finish(state: int) -> str:
    """The rows inserted behind the last one."""
    letters = ""
    while END[state]:
        state = _TURN[state]
        letters += _NAMES[state].upper()
    return letters


class Tables:
    """Transitions between normalised cost vectors, by kind and by block of kinds."""

    def __init__(self, block: int = BLOCK):
        self.block, self.base = block, len(KINDS)
        self.vectors, seen = [END], {END: 0}
        for vector in self.vectors:  # grows until nothing new comes
            for kind in KINDS:
                new = before(kind, vector)
                new = tuple(c - min(new) for c in new)
                if new not in seen:
                    seen[new] = len(self.vectors)
                    self.vectors.append(new)
        n = len(self.vectors)
        self.next, self.added = np.zeros((n, self.base), np.int16), np.zeros((n, self.base), np.int64)
        self.to = np.zeros((n, self.base, 4), np.int8)
        self.letters = [[[""] * 4 for _ in KINDS] for _ in range(n)]
        for v, vector in enumerate(self.vectors):
            for k, kind in enumerate(KINDS):
                new = before(kind, vector)
                self.added[v, k] = min(new)
                self.next[v, k] = seen[tuple(c - min(new) for c in new)]
                for q in range(4):
                    self.letters[v][k][q], self.to[v, k, q] = step(kind, vector, q)

    @cached_property
    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vector before, cost added and state behind, for every vector behind a block and every block."""
        codes = np.arange(self.base ** self.block)
        vector = np.repeat(np.arange(len(self.vectors))[:, None], len(codes), axis=1)
        cost, to = np.zeros_like(vector), np.broadcast_to(np.arange(4), (*vector.shape, 4))
        for i in range(self.block):  # from the last kind of the block to its first
            kind = np.broadcast_to(codes // self.base ** i % self.base, vector.shape)
            to = np.take_along_axis(to, self.to[vector, kind].astype(np.int64), axis=2)
            cost = cost + self.added[vector, kind]
            vector = self.next[vector, kind].astype(np.int64)
        return vector, cost, to.astype(np.int8)

    def coded(self, kinds: str) -> np.ndarray:
        """The blocks of a string of kinds, padded at its front."""
        number = np.zeros(256, np.int64)
        number[np.frombuffer(KINDS.encode(), np.uint8)] = np.arange(self.base)
        padded = kinds.rjust(-(-len(kinds) // self.block) * self.block, "-")
        rows = number[np.frombuffer(padded.encode(), np.uint8)].reshape(-1, self.block)
        return rows @ self.base ** np.arange(self.block)[::-1]

    def behind(self, codes: np.ndarray, end: int) -> tuple[list[int], int]:
        """The vector behind each block, and at last the one before all, with the cost added."""
        following, added, _ = self.blocks
        vectors, cost = [end], 0
        for code in codes[::-1].tolist():
            cost += int(added[vectors[-1], code])
            vectors.append(int(following[vectors[-1], code]))
        return vectors[::-1], cost

    def function(self, kinds: str) -> tuple[np.ndarray, np.ndarray]:
        """What a string of kinds makes of every vector behind it and, for each, of every state before it."""
        following, _, leads = self.blocks
        vector, to = np.arange(len(self.vectors)), np.broadcast_to(np.arange(4), (len(self.vectors), 4))
        for code in self.coded(kinds)[::-1].tolist():
            to = np.take_along_axis(to, leads[vector, code].astype(np.int64), axis=1)
            vector = following[vector, code]
        return vector, to

    def trace(self, kinds: str, end: int = 0, state: int = START) -> tuple[list[str], int, int]:
        """The letters of each row, what they cost, and the state behind them; what is inserted at the end comes after."""
        codes = self.coded(kinds)
        vectors, cost = self.behind(codes, end)
        cost += self.vectors[vectors[0]][state]
        letters = []
        for code, after in zip(codes.tolist(), vectors[1:]):
            row = [code // self.base ** i % self.base for i in range(self.block)][::-1]
            between = [after]
            for kind in row[:0:-1]:
                between.append(int(self.next[between[-1], kind]))
            for kind, vector in zip(row, between[::-1]):
                if kind:
                    letters.append(self.letters[vector][kind][state])
                    state = int(self.to[vector, kind, state])
        return letters, cost - self.vectors[end][state], state


def tables() -> Tables:
    return kept(f"repair tables {BLOCK}", lambda: Tables(BLOCK))


@dataclass
class Repair:
    """``report``: a row for each conversation. ``rows``: the repaired rows, by ``conv_id`` and ``place``.

    ``place`` orders a conversation's rows, with gaps; ``edit`` is K, R or I.
    """

    report: DataFrame
    rows: DataFrame


def last_sign(text: Column) -> Column:
    """The last character that is no white space, or nothing."""
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> Repair:
    """Repaired conversations, and for each what was wrong and what was done.

    ``report`` has ``conv_id``, ``gaps`` (turns missing between the lowest and the highest), the rows whose first fault is
    ``blank`` (no sign but white space), ``duplicate`` (role and text seen earlier) or ``truncated`` (the last sign is none
    of ``. ! ?``), ``illegal`` (neighbours that are not su, ua or au), ``cost`` and ``audit``, the letters of all edits.
    ``rows`` has ``conv_id, place, edit, role, text``.

    Rows are taken by turn, NULL first, rows of one turn by role and text; repeated rows are duplicates. A NULL role or
    text is one space, a role that starts with none of s, u and a fits nowhere, a NULL conversation is one of its own, and
    with NULL turns only a conversation has no gaps. Other columns are not read; an empty table gives no rows. A
    conversation is at most as long as its audit fits a string.
    """
    segment = SEGMENT
    named = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                         *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    rows = materialize(ordered_index(named, "conv_id", "turn", "role", "text", out="number"))
    firsts = rows.groupBy("conv_id", "role", "text").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
    sign, initial = last_sign(F.col("text")), F.substring("role", 1, 1)
    fault = (F.when(F.col("sign") == "", "blank").when(F.col("first").isNull(), "duplicate")
             .when(~F.col("sign").isin(*ENDS), "truncated"))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "X").when(F.col("fault") == "truncated", F.upper("letter")).otherwise(F.col("letter"))
    seen = rows.select("number", "conv_id", "turn", sign.alias("sign"), letter.alias("letter")).join(firsts, "number", "left")
    seen = materialize(seen.withColumn("fault", fault).select("number", "conv_id", "turn", "fault", "letter", kind.alias("kind")))

    cut = F.floor(F.col("number") / segment)
    ordered = F.array_sort(F.collect_list(F.struct("number", "kind", "letter")))
    segments = seen.groupBy("conv_id", cut.alias("segment")).agg(ordered.alias("_all")).select(
        "conv_id", "segment", F.element_at("_all", 1)["number"].alias("number"),
        F.array_join(F.col("_all")["kind"], "").alias("kinds"), F.array_join(F.col("_all")["letter"], "").alias("letters"))
    own = W.partitionBy("conv_id")  # a row for each segment
    segments = materialize(segments.withColumn("segments", F.count(F.lit(1)).over(own)).withColumn(
        "ahead", F.coalesce(F.right(F.lag("letters").over(own.orderBy("segment")), F.lit(1)), F.lit(""))))

    solved = materialize(_solve(segments))
    counts = seen.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    audits = solved.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.array_sort(F.collect_list(F.struct("segment", "audit")))["audit"], "").alias("audit"))
    audits = audits.withColumnRenamed("conv_id", "_conv")
    report = counts.join(audits, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    edits = solved.select(F.posexplode("pieces").alias("at", "piece"), "number").select(
        (F.col("number") + F.col("at")).alias("number"), "piece").filter("piece != 'D'")
    edited = rows.select("number", "conv_id", "role", "text").join(edits, "number")
    each = edited.select("number", "conv_id", "role", "text", F.posexplode(F.split("piece", "")).alias("at", "letter"))
    each = each.filter("letter NOT IN ('', 'D')")
    is_new, role = F.col("letter").isin("U", "A"), F.when(F.lower("letter") == "u", "user").when(F.lower("letter") == "a", "assistant")
    repaired = each.select(
        "conv_id", F.struct("number", "at").alias("place"),
        F.when(is_new, "I").when(F.col("letter") == "K", "K").otherwise("R").alias("edit"),
        F.coalesce(role, F.col("role")).alias("role"), F.when(is_new, "").otherwise(F.col("text")).alias("text"))
    return Repair(report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), repaired)


def _solve(segments: DataFrame) -> DataFrame:
    """``conv_id, segment, number, pieces, audit, cost, illegal`` of each segment."""
    conv = segments.schema["conv_id"].dataType

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tables()
        for batch in batches:
            made = [own.function(k) for k in batch["kinds"]]
            yield batch[["conv_id", "segment"]].assign(vectors=[v.astype("<i2").tobytes() for v, _ in made],
                                                       states=[t.astype(np.int8).tobytes() for _, t in made])

    def chain(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("segment")
        vectors = [np.frombuffer(v, "<i2") for v in parts["vectors"]]
        ends = [0]
        for v in vectors[:0:-1]:
            ends.append(int(v[ends[-1]]))
        ends, starts = ends[::-1], [START]
        for states, end in zip(parts["states"], ends):
            starts.append(int(np.frombuffer(states, np.int8).reshape(-1, 4)[end, starts[-1]]))
        return parts[["conv_id", "segment"]].assign(end=ends, state=starts[:-1], last=np.arange(len(ends)) == len(ends) - 1)

    base = [T.StructField("conv_id", conv), T.StructField("segment", T.LongType())]
    several = segments.filter("segments > 1")
    made = several.select("conv_id", "segment", "kinds").mapInPandas(
        functions, T.StructType([*base, T.StructField("vectors", T.BinaryType()), T.StructField("states", T.BinaryType())]))
    ends = made.groupBy("conv_id").applyInPandas(chain, T.StructType([
        *base, T.StructField("end", T.IntegerType()), T.StructField("state", T.IntegerType()), T.StructField("last", T.BooleanType())]))
    ends = ends.select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), "end", "state", "last")
    at = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment"))
    columns = ["conv_id", "segment", "number", "kinds", "letters", "ahead", "end", "state", "last"]
    single = segments.filter("segments = 1").withColumns({"end": F.lit(0), "state": F.lit(START), "last": F.lit(True)})
    posed = single.select(*columns).unionByName(several.join(ends, at).select(*columns))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables()
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("pieces", "audit", "cost", "illegal")}
            for kinds, letters, ahead, end, state, last in zip(*[batch.column(n).to_pylist() for n in columns[3:]]):
                pieces, cost, to = own.trace(kinds, end, state)
                if last:
                    pieces[-1] += finish(to)
                    cost += END[to]
                near = ahead + letters
                out["pieces"].append(pieces)
                out["audit"].append("".join(pieces).translate(str.maketrans("UAua", "IIRR")))
                out["cost"].append(cost)
                out["illegal"].append(sum(near[i:i + 2] not in ("su", "ua", "au") for i in range(len(near) - 1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out["pieces"], pa.list_(pa.string())), pa.array(out["audit"], pa.string()),
                 pa.array(out["cost"], pa.int64()), pa.array(out["illegal"], pa.int64())], names=[*columns[:3], *out])

    return posed.mapInArrow(trace, T.StructType([
        *base, T.StructField("number", T.LongType()), T.StructField("pieces", T.ArrayType(T.StringType())),
        T.StructField("audit", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType())]))


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the repaired ``role:text`` lines of each conversation, joined by newlines.

    A conversation's rows pass one after the other through one task, of which it holds one at a time.
    """
    placed = rows.select("conv_id", "place", F.concat_ws(":", "role", "text").alias("line")).repartition("conv_id")
    placed = placed.sortWithinPartitions("conv_id", "place").select("conv_id", "line")
    conv = rows.schema["conv_id"].dataType
    kind = to_arrow_type(conv)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        digest, current = None, None
        for batch in batches:
            done = []
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest is None or own != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    digest, current = hashlib.sha256(), own
                else:
                    digest.update(b"\n")
                digest.update(line.as_py().encode("utf-8", "replace"))
            yield record(done)
        if digest is not None:
            yield record([(current, digest.hexdigest())])

    def record(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())],
                                          names=["conv_id", "sha256"])

    return placed.mapInArrow(each, T.StructType([T.StructField("conv_id", conv), T.StructField("sha256", T.StringType())]))
