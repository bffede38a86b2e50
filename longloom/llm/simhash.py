"""Near-duplicate documents by SimHash, every pair of fingerprints within a radius found by tiled exact comparison.

1. Each document becomes a 64-bit fingerprint of its shingles. Documents with one fingerprint are a class, and from here
   on there are classes only.
2. A fingerprint is cut into ``PARTS`` parts of equal width. Changing one bit of it changes one part's population count
   by one, so that two fingerprints differ in at least as many bits as their counts do, part by part. Fingerprints with
   the same counts are a tile, kept as packed numbers in blocks of at most ``TILE`` of them.
3. A tile meets only the tiles whose counts differ by the radius at most; all other pairs of tiles are skipped. Blocks
   that meet also hold the least and highest population count of each byte, and are skipped by the same rule.
4. In a pair of blocks every fingerprint is compared with every other by exclusive-or and bit counts. Of the links found
   a block pair gives a forest, at most as many as it has fingerprints, however many copies are near each other.
5. The connected components of the links are the documents' groups.

Blocks are cut from sorted partitions, so that a tile of any size spreads over tasks. With more than ``FINE_ROWS``
fingerprints the bytes themselves are the parts, so that tiles stay small; results don't depend on the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, materialize_measured
from .neardup import components

SHINGLE = 3
SEED = 42
PARTS, FINE_PARTS = 4, 8
FINE_ROWS = 30_000_000
TILE = 2048
BATCH = 256
HASHES = 65_536  # unpacked at a time, 4 MB
_COUNT_BITS = 7  # room for a part's population count, and one or two less or more of it
_BLOCK = "key long, first long, low array<int>, high array<int>, prints binary"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included: runs of ``size`` words joined by single spaces, A-Z lower-cased.

    A text with fewer words has one shingle, all of it; a text without words has none.
    """
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()[min(size, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, last)), "<u8", len(last))


def fingerprint(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half the hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES):
        some = hashes[i:i + HASHES].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, print`` (the fingerprint as a signed number) of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                some = batch.slice(i, BATCH)
                prints = np.array([fingerprint(shingle_hashes(t.as_py(), size)) for t in some.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(prints.view(np.int64))], names=["_id", "print"])

    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("print", T.LongType())])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(each, schema)


def part_counts(prints: Column, parts: int) -> list[Column]:
    """The population count of each part of a fingerprint."""
    width = 64 // parts
    return [F.bit_count(F.shiftleft(F.shiftrightunsigned(prints, i * width), 64 - width)).cast("bigint") for i in range(parts)]


def _packed(counts: list[Column]) -> Column:
    return sum((c * F.lit(1 << (_COUNT_BITS * i)) for i, c in enumerate(counts[1:], 1)), counts[0])


def tile_steps(parts: int, radius: int) -> list[int]:
    """What to add to a tile's key for each tile whose counts differ by the radius at most, either of two tiles once."""
    steps = set()

    def extend(at: int, left: int, key: int) -> None:
        if at == parts:
            steps.add(key)
            return
        for d in range(-left, left + 1):
            extend(at + 1, left - abs(d), key + d * (1 << (_COUNT_BITS * at)))

    extend(0, radius, 0)
    return sorted(s for s in steps if s >= 0)


def tile_blocks(prints: DataFrame, parts: int) -> DataFrame:
    """The column ``print``, without repeats, as rows of at most ``TILE`` packed numbers of one tile.

    The rows are put in order of tile, byte counts and value, and every partition cuts its run of them, so that a large
    tile lies in many blocks of several tasks.
    """
    fine = _packed(part_counts(F.col("print"), 8))
    keyed = prints.select(_packed(part_counts(F.col("print"), parts)).alias("key"), fine.alias("fine"), "print")
    placed = keyed.repartitionByRange("key", "fine", "print").sortWithinPartitions("key", "fine", "print")
    tile = TILE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def block() -> pa.RecordBatch:
            values = np.concatenate(held)
            counts = np.bitwise_count(values.view(np.uint8).reshape(-1, 8))
            rows = {"key": [key], "first": [int(values[0])], "low": [counts.min(axis=0).tolist()],
                    "high": [counts.max(axis=0).tolist()], "prints": [values.tobytes()]}
            return pa.RecordBatch.from_arrays(
                [pa.array(rows["key"], pa.int64()), pa.array(rows["first"], pa.int64()), pa.array(rows["low"], pa.list_(pa.int32())),
                 pa.array(rows["high"], pa.list_(pa.int32())), pa.array(rows["prints"], pa.binary())], names=list(rows))

        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and keys[a] != key:
                    yield block()
                    held = []
                key = int(keys[a])
                while a < b:
                    room = tile - sum(map(len, held))
                    held.append(values[a:min(b, a + room)].astype("<i8"))
                    a += room
                    if sum(map(len, held)) == tile:
                        yield block()
                        held = []
        if held:
            yield block()

    return placed.select("key", "print").mapInArrow(cut, _BLOCK)


def near_forest(a: np.ndarray, b: np.ndarray, radius: int, strip: int = 256) -> list[tuple[int, int]]:
    """Links that connect what the pairs of ``a`` and ``b`` within the radius connect, one less than a tree has nodes."""
    found = []
    for i in range(0, len(a), strip):
        r, c = np.nonzero(np.bitwise_count((a[i:i + strip, None] ^ b[None, :]).view(np.uint64)) <= radius)
        found.append((r + i, c))
    left, right = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    other = a[left] != b[right]
    if not other.any():
        return []
    nodes, ends = np.unique(np.concatenate([a[left[other]], b[right[other]]]), return_inverse=True)
    x, y = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return list(zip(nodes[moved].tolist(), nodes[label[moved]].tolist()))


def near_links(prints: DataFrame, radius: int, parts: int) -> DataFrame:
    """``a, b``: links between fingerprints that connect all that differ in at most ``radius`` bits."""
    blocks = materialize(tile_blocks(prints, parts))
    steps = F.array(*[F.lit(s).cast("bigint") for s in tile_steps(parts, radius)])
    left = blocks.select("key", F.explode(steps).alias("step"), *[F.col(c).alias(f"l_{c}") for c in ("first", "low", "high", "prints")])
    left = left.select((F.col("key") + F.col("step")).alias("key"), "step", "l_first", "l_low", "l_high", "l_prints")
    apart = sum((F.greatest(F.get("low", F.lit(i)) - F.get("l_high", F.lit(i)), F.get("l_low", F.lit(i)) - F.get("high", F.lit(i)),
                            F.lit(0)) for i in range(8)), F.lit(0))
    once = (F.col("step") != 0) | (F.col("l_first") <= F.col("first"))
    pairs = left.join(blocks, "key").filter(once & (apart <= radius)).select("l_prints", "prints")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for one, two in zip(batch.column(0), batch.column(1)):
                links += near_forest(np.frombuffer(one.as_buffer(), "<i8"), np.frombuffer(two.as_buffer(), "<i8"), radius)
            ends = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def link_by_simhash(docs: DataFrame, radius: int = 2, size: int = SHINGLE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id`` for each row.

    A fingerprint has 64 bits, those set in over half the XXH64 hashes (seed 42) of the text's shingles, and is written as
    16 lower-case hexadecimal digits. Rows whose fingerprints differ in at most ``radius`` bits are linked, and
    ``component_id`` is the lowest id that a row is connected with, itself included.

    A NULL text or one without words has the fingerprint zero, linked like any other; so do texts whose hashes agree in no
    bit. A NULL id is no lowest id; a row connected with NULL ids only has a NULL ``component_id``. Repeated rows stay,
    each with its result. Other columns are not read; an empty table gives no rows.
    """
    stored = materialize(fingerprints(docs, size, id_col, text_col))
    classes, seen = materialize_measured(stored.groupBy("print").agg(F.min("_id").alias("lowest")))
    parts = PARTS if seen["rows"] <= FINE_ROWS else FINE_PARTS
    found = components(materialize(near_links(classes.select("print"), radius, parts)))
    members = found.select(F.col("node").alias("print"), "root").join(classes, "print")
    lowest = members.groupBy("root").agg(F.min("lowest").alias("component_id"))
    linked = members.join(lowest, "root").select("print", "component_id")
    alone = classes.join(linked.select("print"), "print", "left_anti").select("print", F.col("lowest").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return stored.join(linked.unionByName(alone), "print").select(
        F.col("_id").alias(id_col), digits.alias("fingerprint"), "component_id")
