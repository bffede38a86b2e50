"""Best-fit packing of tokenized documents into sequences of a fixed length.

Best-fit decreasing takes the pieces from the longest to the shortest and puts each into the open sequence with the
least room that still holds it. Pieces of one length are interchangeable, and so are sequences with one amount of room,
so the order of the pieces within a length decides nothing: the packing is a function of how many pieces there are of
each length, a table of at most ``size`` rows for any corpus. The driver packs that table, with a segment tree over the
remaining capacities that finds the tightest room in logarithmic time, and takes runs of equal pieces into runs of equal
sequences in one step; the sequences come out as if it had gone piece by piece. The result is a list of runs whose
number depends on ``size`` alone (see ``pack_lengths``), and every piece finds its sequence by its length and its number
among the pieces of that length. No group of pieces ever meets in one task, whatever share of them has one length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .tokens import word_ids

ROWS = 512  # documents tokenized at a time in a task


@dataclass
class Run:
    """Pieces ``first`` .. ``first + pieces - 1`` of one length, ``each`` of them to a sequence."""

    length: int
    first: int
    pieces: int
    each: int
    sequence: int
    offset: int


class OpenSequences:
    """A segment tree over remaining capacities; a leaf holds the runs of sequences with that much room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.filled = [0] * (2 * self.leaves)  # runs below each node
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _count(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.filled[node] += change
            node >>= 1

    def put(self, room: int, first: int, sequences: int) -> None:
        if sequences and room:
            self.runs[room].append((first, sequences))
            self._count(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.runs[room].pop()

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open sequence has."""
        node = need + self.leaves
        if not self.filled[node]:
            # up to the first ancestor with something to its right, then down its leftmost filled branch
            while node > 1 and (node & 1 or not self.filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        return node - self.leaves


def pack_lengths(counts: dict[int, int], size: int) -> list[Run]:
    """Best-fit decreasing over ``{length: number of pieces}``.

    A run of sequences is split into at most three per length, so at most ``3 * size`` runs are ever open, and one
    sequence holds fewer than ``sqrt(2 * size)`` different lengths, which bounds the runs in the result without regard
    to the number of pieces.
    """
    tree, runs, opened = OpenSequences(size), [], 0
    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, sequences = size, opened, -(-left // (size // length))
                opened += sequences
            else:
                first, sequences = tree.take(room)
            each = room // length
            pieces = min(left, each * sequences)
            runs.append(Run(length, done, pieces, each, first, size - room))
            full, rest = divmod(pieces, each)
            tree.put(room - each * length, first, full)
            if rest:
                tree.put(room - rest * length, first + full, 1)
            used = full + (rest > 0)
            tree.put(room, first + used, sequences - used)
            left, done = left - pieces, done + pieces
    return runs


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, task, number`` for each piece of each tokenized document.

    ``number`` counts the pieces of one length within the task that made them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = word_ids(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some, rows = batch.slice(i, ROWS), []
                for at, ids in enumerate(encoder.encode(some.column(1).to_pylist())):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, size)):
                        own = ids[4 * start:4 * (start + size)]
                        length = len(own) // 4
                        rows.append((at, piece, start, length, zlib.crc32(own), task, seen[length]))
                        seen[length] += 1
                cols = list(zip(*rows, strict=True))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(cols[0]))] + [pa.array(c, t) for c, t in zip(cols[1:], types)],
                    names=[id_col, "piece", "start", "length", "ids_crc32", "task", "number"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")],
                           T.StructField("task", T.IntegerType()), T.StructField("number", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def place(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with ``length``, ``task`` and ``number``."""
    tasks = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("pieces"))
    tasks = materialize(tasks)
    counts = {r["length"]: r["pieces"] for r in tasks.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    runs = pack_lengths(counts, size)  # a function of at most `size` numbers
    table = np.array([astuple(r) for r in runs], dtype=np.int64).reshape(-1, 6).T
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    names = [c for c in pieces.columns if c not in ("task", "number")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, each, sequence, offset = shared.value
        order = np.lexsort((first, length))
        # pieces of all lengths as one line of numbers: a run's place in it is its length's base plus its first piece
        lengths, begins = np.unique(length[order], return_index=True)
        for batch in batches:
            own, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            run = np.empty(len(own), dtype=np.int64)
            ends = np.append(begins[1:], len(order))
            for which in np.unique(np.searchsorted(lengths, own)):
                rows = np.flatnonzero(own == lengths[which])
                part = order[begins[which]:ends[which]]
                run[rows] = part[np.searchsorted(first[part], number[rows], side="right") - 1]
            inside = number - first[run]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(sequence[run] + inside // each[run]), pa.array(offset[run] + inside % each[run] * own)],
                names=[*names, "sequence_id", "offset"])

    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = tasks.select("length", "task", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("_base"))
    numbered = pieces.join(base, ["length", "task"]).withColumn("number", F.col("number") + F.col("_base"))
    schema = T.StructType([pieces.schema[c] for c in names]
                          + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")])
    return numbered.select(*pieces.columns).mapInArrow(look_up, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``size`` tokens.

    ``tokenizer`` is the path of a tokenizer file, present on every machine. A document is its ids and ``end_id``;
    longer ones are cut into pieces of ``size`` tokens, the last of which may be shorter. The result has a row per
    piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    A NULL or empty text is a document of one end token. NULL and repeated ids are rows like any other. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    """
    return place(materialize(cut_pieces(docs, tokenizer, size, end_id, id_col, text_col)), size)
