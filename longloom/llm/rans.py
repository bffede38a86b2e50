"""Token ids in files, coded by a static range asymmetric numeral system.

A file is a Parquet folder whose rows are groups of whole documents in id order. A group has one table of frequencies,
shared by its blocks; a block is coded by itself, by ``LANES`` interleaved coders whose states are vectors, has
checkpoints from which decoding may begin in its middle, and checksums of its words and its ids. So blocks decode in
parallel and independently, a damaged one is noticed, and no more than a group is ever held in memory.

Layout of a group: ``part, group`` (its place in the order), ``doc_ids``, ``lengths`` (ids per document), ``table``
(compressed: the ids that occur, as differences, then their frequencies out of 2**20), ``blocks``: ``n`` ids, ``lanes``,
``words`` (little-endian 32-bit, in decoding order), ``states`` (one per lane and checkpoint), ``places`` (words read
before each checkpoint), ``words_crc``, ``ids_crc``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import word_ids

BITS = 20  # frequencies add up to 2**BITS
LOW = 1 << 31  # a state lies in [LOW, LOW << 32)
LANES = 1024
BLOCK_IDS = 1 << 18
GROUP_IDS = 1 << 22  # a group ends with the document that reaches this
CHECKPOINT_STEPS = 128
DENSE_IDS = 1 << 22  # below, symbols are found in a plain table
ROWS = 512

_BLOCK = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("lanes", T.IntegerType()), T.StructField("words", T.BinaryType()),
    T.StructField("states", T.BinaryType()), T.StructField("places", T.ArrayType(T.LongType())),
    T.StructField("words_crc", T.LongType()), T.StructField("ids_crc", T.LongType())])


class Table:
    """Symbols, their frequencies and where their ranges begin."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.begin = np.cumsum(self.freq) - self.freq
        self.dense: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        if ids.max() < DENSE_IDS:
            counts = np.bincount(ids)
            symbols = np.flatnonzero(counts)
            counts = counts[symbols]
        else:
            symbols, counts = np.unique(ids, return_counts=True)
        if len(symbols) > 1 << (BITS - 1):
            raise ValueError(f"more than {1 << (BITS - 1)} different ids in a group")
        # one for each symbol, the rest in proportion, what rounding leaves to the most frequent one
        spare = (1 << BITS) - len(symbols)
        freq = 1 + counts.astype(np.int64) * spare // counts.sum()
        freq[np.argmax(counts)] += (1 << BITS) - freq.sum()
        return cls(symbols.astype(np.uint32), freq)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The places of ids among the symbols."""
        if self.symbols[-1] >= DENSE_IDS:
            return np.searchsorted(self.symbols, ids)
        if self.dense is None:
            self.dense = np.zeros(int(self.symbols[-1]) + 1, dtype=np.int32)
            self.dense[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)
        return self.dense[ids]

    def pack(self) -> bytes:
        steps = np.diff(self.symbols.astype(np.int64), prepend=0).astype("<u4")
        return zlib.compress(steps.tobytes() + self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        steps, freq = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
        return cls(np.cumsum(steps.astype(np.int64)).astype(np.uint32), freq)


def encode_block(ids: np.ndarray, table: Table) -> dict:
    """One block; the ids are dealt to the lanes in turn and coded from the last to the first."""
    n = len(ids)
    lanes = min(LANES, 1 << max(0, (n // 64).bit_length() - 1))
    steps = -(-n // lanes)
    which = table.places(ids)
    padded = np.full(steps * lanes, np.argmax(table.freq))
    padded[:n] = which
    freq, begin = table.freq[padded].reshape(steps, lanes), table.begin[padded].reshape(steps, lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    limit, half, bits = np.uint64(63 - BITS), np.uint64(32), np.uint64(BITS)
    words, states = [], []
    for step in range(steps - 1, -1, -1):
        f = freq[step]
        over = state >= f << limit
        words.append(state[over].astype(np.uint32))
        state = np.where(over, state >> half, state)
        times, rest = np.divmod(state, f)
        state = (times << bits) + rest + begin[step]
        if step % CHECKPOINT_STEPS == 0:
            states.append(state)
    words.reverse()
    read = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    body = np.concatenate(words).astype("<u4").tobytes() if words else b""
    return {"n": n, "lanes": lanes, "words": body, "states": np.concatenate(states[::-1]).astype("<u8").tobytes(),
            "places": read[0:steps:CHECKPOINT_STEPS].tolist(), "words_crc": zlib.crc32(body),
            "ids_crc": zlib.crc32(ids.astype("<u4").tobytes())}


class Decoder:
    """Decodes the blocks of one group."""

    def __init__(self, table: Table):
        self.table = table
        self.slots = np.repeat(np.arange(len(table.symbols)), table.freq.astype(np.int64))

    def decode(self, block: dict, checkpoint: int = 0) -> np.ndarray:
        """The ids of a block from a checkpoint on; checkpoint 0 is the whole block, whose ids are checked, too."""
        n, lanes = block["n"], block["lanes"]
        if zlib.crc32(block["words"]) != block["words_crc"]:
            raise ValueError("a block's words are damaged")
        words = np.frombuffer(block["words"], "<u4").astype(np.uint64)
        state = np.frombuffer(block["states"], "<u8").reshape(-1, lanes)[checkpoint].astype(np.uint64)
        at, first = block["places"][checkpoint], checkpoint * CHECKPOINT_STEPS
        steps = -(-n // lanes)
        out = np.empty((steps - first, lanes), dtype=np.int64)
        mask, half, bits, low = np.uint64((1 << BITS) - 1), np.uint64(32), np.uint64(BITS), np.uint64(LOW)
        for step in range(steps - first):
            slot = state & mask
            which = self.slots[slot]
            out[step] = which
            state = self.table.freq[which] * (state >> bits) + slot - self.table.begin[which]
            under = np.flatnonzero(state < low)
            state[under] = state[under] << half | words[at:at + len(under)]
            at += len(under)
        ids = self.table.symbols[out.ravel()[:n - first * lanes]]
        if not checkpoint and zlib.crc32(ids.astype("<u4").tobytes()) != block["ids_crc"]:
            raise ValueError("a block's ids are damaged")
        return ids


def _group(part: int, number: int, doc_ids: list[pa.Array], lengths: list[int], ids: bytes) -> dict:
    flat = np.frombuffer(ids, "<u4")
    table = Table.of(flat)
    blocks = [encode_block(flat[i:i + BLOCK_IDS], table) for i in range(0, len(flat), BLOCK_IDS)]
    return {"part": part, "group": number, "doc_ids": doc_ids, "lengths": lengths, "table": table.pack(), "blocks": blocks}


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                     text_col: str = "text") -> None:
    """Tokenize every document and write its ids and ``end_id`` to a new file in ascending order of ``id_col``.

    NULL ids come first; documents with the same id are in the order of a hash of their texts. A NULL or empty text is
    one end token. An empty table gives a file without groups.
    """
    order = [F.col("_id").asc_nulls_first(), F.col("_tie").asc()]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_tie"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("group", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("table", T.BinaryType()),
        T.StructField("blocks", T.ArrayType(_BLOCK))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        encoder, part, number = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        doc_ids, lengths, ids = [], [], bytearray()

        def finish() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_group(part, number, doc_ids, lengths, bytes(ids))], schema=out)

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                for doc_id, own in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    ids += own
                    ids += end
                    doc_ids.append(doc_id)
                    lengths.append(len(own) // 4 + 1)
                    if len(ids) >= 4 * GROUP_IDS:
                        yield finish()
                        doc_ids, lengths, ids, number = [], [], bytearray(), number + 1
        if doc_ids:
            yield finish()

    placed.mapInArrow(code, schema).write.option("compression", "none").parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``part, group, place, doc_id, ids`` of every document in a file, ids as an array, checksums checked."""
    return _read(spark, path, lambda ids: ids, T.ArrayType(T.LongType()), pa.list_(pa.int64()), "ids")


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a file, from its decoded ids.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is over little-endian unsigned 32-bit ids.
    """
    seen = _read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), T.LongType(), pa.int64(), "ids_crc32")
    groups = spark.read.parquet(path).select("part", "group", F.aggregate(
        "lengths", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"))
    # one row per part, that is per task that wrote
    parts = groups.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("group").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0)).alias("_inside")
    base = groups.select("part", "group", inside).join(before, "part")
    return seen.join(base, ["part", "group"]).select(
        "doc_id", (F.col("_before") + F.col("_inside") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def _read(spark, path, of, kind, arrow_kind, name) -> DataFrame:
    stored = spark.read.parquet(path)
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("group", T.IntegerType()),
        T.StructField("place", T.LongType()), T.StructField("doc_id", stored.schema["doc_ids"].dataType.elementType),
        T.StructField("n_tokens", T.LongType()), T.StructField(name, kind)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            for row in range(batch.num_rows):
                value = lambda c: batch.column(at[c])[row]  # noqa: B023,E731
                decoder = Decoder(Table.unpack(value("table").as_py()))
                ids = np.concatenate([decoder.decode(b.as_py()) for b in value("blocks")])
                lengths = np.array(value("lengths").as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                results = [of(ids[e - n:e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                same = lambda v, t: pa.array(np.full(len(lengths), v), t)  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays(
                    [same(value("part").as_py(), pa.int32()), same(value("group").as_py(), pa.int32()),
                     pa.array(ends - lengths), value("doc_ids").values, pa.array(lengths), pa.array(results, arrow_kind)],
                    names=["part", "group", "place", "doc_id", "n_tokens", name])

    return stored.mapInArrow(decode, schema)
