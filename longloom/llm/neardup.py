"""Near-duplicate documents by b-bit MinHash, every link confirmed on full shingle sets.

1. Each document becomes the set of its shingles, of which a sketch stays: the set's own hash, band hashes of as many minima
   each as ``band_rows`` says (``BANDS`` of ``BAND_ROWS`` at 85 %), and ``BITS`` low bits of every minimum, packed. Documents with one and the same set are a
   class, and from here on there are classes only.
2. Every class of a bucket (a band and its hash) is tied to the bucket's lowest class. The connected components of these
   ties are clusters; two sets that share a bucket are in one cluster, whatever the bucket's size.
3. Clusters are compared in cells of at most ``2 * CELL_SETS`` sets, every part of a cluster with every other. In a cell the
   packed bits of two sets are compared by counting, the share of equal minima is corrected for those that agree by
   chance, and pairs whose estimate is within ``margin`` of the threshold or above it are confirmed on their full sets,
   unless they are connected already. A cell gives at most one link less than it has sets, enough to connect what its
   links connect, so a group of n copies never becomes n * n rows.
4. The connected components of the links are the classes' components, and each document looks its own up.

A pair at the threshold is missed by all bands with a probability of ``(1 - J**rows)**bands``, 2e-7 at 0.85 (8 rows), 4e-9
at 0.80 (6 rows), and less above it; the margin of the estimate is six standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, materialize_measured
from .worker import kept

SHINGLE = 5
BANDS, BAND_ROWS = 48, 8
BITS = 2
MARGIN = 0.13
MISSED = 1e-6
CELL_SETS = 4096
CACHE_WORDS = 500_000
BATCH = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def spread(x: np.ndarray) -> np.ndarray:
    """Numbers whose bits all depend on all bits of the given ones."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's different shingles: runs of ``size`` words, A-Z lower-cased.

    A text with fewer words has one shingle, all of it; a text without words has none.
    """
    cache = kept("word hashes", WordHashes)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    out = []
    for text in texts:
        words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
        if not words:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - size + 1)
        mixed = np.full(n, min(size, len(h)), dtype=np.uint64)
        for j in range(min(size, len(h))):
            mixed = spread(mixed + h[j:j + n])
        out.append(np.unique(mixed))
    return out


def band_rows(percent: int) -> int:
    """The most minima a band may have for the bands to miss at most ``MISSED`` of the pairs at the threshold."""
    minima = BANDS * BAND_ROWS
    fitting = [r for r in range(1, minima + 1) if minima % r == 0 and (1 - (percent / 100) ** r) ** (minima // r) <= MISSED]
    return max(fitting, default=1)


def margin(percent: int) -> float:
    """Six standard deviations of the estimate at the threshold, ``MARGIN`` at least."""
    chance = 0.5 ** BITS
    agree = chance + (1 - chance) * percent / 100
    return max(MARGIN, 6 * (agree * (1 - agree) / (BANDS * BAND_ROWS)) ** 0.5 / (1 - chance))


class Sketcher:
    """MinHash of sets of 64-bit numbers, with fixed multipliers."""

    def __init__(self, bands: int, band_rows: int, bits: int):
        rng = np.random.default_rng(20)
        self.bands, self.band_rows, self.bits = bands, band_rows, bits
        n = bands * band_rows
        self.times = rng.integers(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, n).astype(np.uint32)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """The minima of each set under each permutation; sets are not empty."""
        begins = np.cumsum([0, *map(len, sets[:-1])])
        items = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(sets), len(self.times)), dtype=np.uint32)
        for k in range(len(self.times)):
            permuted = items * self.times[k] + self.plus[k]
            permuted ^= permuted >> np.uint32(15)
            out[:, k] = np.minimum.reduceat(permuted * np.uint32(0x2C1B3C6D), begins)
        return out

    def band_hashes(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each band, different bands never sharing buckets but by chance."""
        rows = minima.reshape(len(minima), self.bands, self.band_rows).astype(np.uint64)
        out = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), rows.shape[:2])
        for k in range(self.band_rows):
            out = spread(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
        return out

    def pack(self, minima: np.ndarray) -> list[bytes]:
        """The low bits of the minima: one bit plane after the other."""
        planes = [np.packbits((minima >> np.uint32(b) & np.uint32(1)).astype(bool), axis=1) for b in range(self.bits)]
        return [row.tobytes() for row in np.hstack(planes)]


def estimates(one: np.ndarray, others: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The similarity of one packed signature to others.

    Minima agree in all their bits either because they are the same or, in a ``2**-bits`` part of the rest, by chance.
    """
    planes = (one[None, :] ^ others).reshape(len(others), bits, -1)
    differ = np.bitwise_count(np.bitwise_or.reduce(planes, axis=1)).sum(axis=1)
    agree = 1.0 - differ / (planes.shape[2] * 8)
    chance = 0.5 ** bits
    return (agree - chance) / (1 - chance)


def set_node(items: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    sums = [int(spread(items * np.uint64(m)).sum(dtype=np.uint64)) for m in (0xD6E8FEB86659FD93, 0xA5A35625E5A35625)]
    return b"".join(s.to_bytes(8, "big") for s in sums)


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """``_id, _t`` (a hash of the text), ``n_shingles, node, bands, bits`` of each document; node is NULL without words."""
    rows = band_rows(percent)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(BANDS * BAND_ROWS // rows, rows, BITS)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                some = batch.slice(i, BATCH)
                sets = shingle_sets(some.column(2).to_pylist(), size)
                full = [s for s in sets if len(s)]
                nodes = [set_node(s) if len(s) else None for s in sets]
                bands, bits = iter(()), iter(())
                if full:
                    minima = maker.minima(full)
                    bands, bits = iter(maker.band_hashes(minima).astype(np.int64)), iter(maker.pack(minima))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()),
                     pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
                     pa.array([next(bits) if len(s) else None for s in sets], pa.binary())],
                    names=["_id", "_t", "n_shingles", "node", "bands", "bits"])

    schema = T.StructType([
        T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_t", T.LongType()),
        T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])
    return _named(docs, id_col, text_col).mapInArrow(each, schema)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("_text"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the lowest node that each node of the edges ``a, b`` is connected with.

    Large-star and small-star steps in turn: a node's higher neighbours, then its lower ones, are tied to the lowest it
    knows. Every step is an aggregation and a join, and a node with any number of neighbours keeps one row per neighbour.
    """
    check = {"total": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    edges, seen = materialize_measured(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), **check)
    while seen["rows"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        tied = lowest.select("a", F.col("low").alias("b")).unionByName(small).distinct()
        before = seen["total"]
        edges, seen = materialize_measured(tied, **check)
        if seen["total"] == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def cell_links(nodes: list[bytes], parts: np.ndarray, bits: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links between the sets of a cell, as many as connect what all its links connect.

    ``parts`` names each set's part; with two parts only pairs across are looked at, each part having a cell of its own.
    """
    n = len(nodes)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    items = np.unique(flat, return_inverse=True)[1]
    begins = np.cumsum(sizes) - sizes
    marked = np.zeros(int(items.max()) + 1 if len(items) else 1, dtype=bool)
    root = np.arange(n)
    crossing = len(np.unique(parts)) > 1
    links, least = [], percent / 100 - margin(percent)
    for x in range(1, n):
        near = (estimates(bits[x], bits[:x]) >= least) & (root[:x] != root[x])
        near &= 100 * np.minimum(sizes[:x], sizes[x]) >= percent * np.maximum(sizes[:x], sizes[x])
        if crossing:
            near &= parts[:x] != parts[x]
        others = np.flatnonzero(near)
        if not len(others):
            continue
        own = items[begins[x]:begins[x] + sizes[x]]
        marked[own] = True
        for y in others:
            if root[y] == root[x]:
                continue
            shared = int(marked[items[begins[y]:begins[y] + sizes[y]]].sum())
            if 100 * shared >= percent * (sizes[x] + sizes[y] - shared):
                links.append((nodes[x], nodes[y]))
                root[root == root[x]] = root[y]
        marked[own] = False
    return links


def drop_near_duplicates(docs: DataFrame, percent: int = 85, size: int = SHINGLE, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The documents with one of each group left: that with the group's lowest id, see ``link_documents``.

    Of rows with one id and text one stays; which, if other columns differ, is not said.
    """
    def row(own: Column, text: Column) -> Column:
        return F.concat_ws(":", F.coalesce(own.cast("string"), F.lit("NULL")), text)

    mark = free_name(docs, "_row")
    left = _linked(docs, percent, size, id_col, text_col).filter("kept").select(row(F.col("_id"), F.col("_t")).alias(mark)).distinct()
    named = docs.withColumn(mark, row(F.col(id_col), F.xxhash64(text_col)))
    return named.join(left, mark).dropDuplicates([mark]).select(*[F.col(f"`{c}`") for c in docs.columns])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def link_documents(docs: DataFrame, percent: int = 85, size: int = SHINGLE, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for each document.

    Two documents are linked if 100 times the shingles they share is at least ``percent`` times those of both together.
    ``component_id`` is the lowest id that a document is connected with, itself included, and ``kept`` says that it is
    the document's own.

    A NULL text or one without words has no shingles and is linked with nothing. A NULL id is no lowest id; a document
    connected with NULL ids only has a NULL ``component_id`` and is kept. Rows with one id and text are one document,
    each with its row; other columns are not read. An empty table gives no rows.
    """
    linked = _linked(docs, percent, size, id_col, text_col)
    return linked.select(F.col("_id").alias(id_col), "n_shingles", "component_id", "kept")


def _linked(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    stored = materialize(sketch(docs, id_col, text_col, size, percent))
    full = stored.filter(F.col("node").isNotNull())
    classes = materialize(full.groupBy("node").agg(
        F.min("_id").alias("lowest"), F.min(F.struct("_id", "_t")).alias("row"), F.first("bits").alias("bits")))
    # for candidates half of a name will do: sets that happen to share it land in one cluster and are told apart there
    half: Column = F.conv(F.hex(F.substring("node", 1, 7)), 16, 10).cast("bigint")

    entries = full.select(F.explode("bands").alias("bucket"), half.alias("half"))
    buckets = entries.groupBy("bucket").agg(F.min("half").alias("b"), F.max("half").alias("top")).filter("b != top")
    ties = entries.join(buckets.select("bucket", "b"), "bucket").select(F.col("half").alias("a"), "b")
    clusters = materialize(components(ties.filter("a != b").distinct()))
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL_SETS)).cast("int").alias("parts"))
    members = classes.withColumn("half", half).join(
        clusters.join(sizes, "root").select(F.col("node").alias("half"), "root", "parts"), "half")
    members = materialize(members.select("node", "bits", "row", "root", "parts",
                                         F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")))

    wanted = members.select("node", "bits", "root", "parts", "part", F.col("row._id").alias("_want"), F.col("row._t").alias("_t"))
    texts = _named(docs, id_col, text_col).join(wanted, "_t").filter(F.col("_id").eqNullSafe(F.col("_want")))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                some = batch.slice(i, BATCH)
                sets = [s.tobytes() for s in shingle_sets(some.column(0).to_pylist(), size)]
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(sets, pa.binary())],
                                                 names=[*some.schema.names[1:], "items"])

    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("bits", T.BinaryType()),
                           T.StructField("root", T.LongType()), T.StructField("parts", T.IntegerType()),
                           T.StructField("part", T.IntegerType()), T.StructField("items", T.BinaryType())])
    sets = texts.select("_text", "node", "bits", "root", "parts", "part").mapInArrow(with_sets, schema)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = sets.select("node", "bits", "root", "part", "items", other).withColumns(
        {"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("other")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("node").sort_values("node")
        bits = np.stack([np.frombuffer(b, np.uint8) for b in cell["bits"]])
        found = cell_links(list(cell["node"]), cell["part"].to_numpy(), bits,
                           [np.frombuffer(s, np.uint64) for s in cell["items"]], percent)
        return pd.DataFrame(found, columns=["a", "b"])

    links = materialize(cells.groupBy("root", "low", "high").applyInPandas(compare, "a binary, b binary"))
    found = components(links)
    lowest = found.join(classes.select("node", "lowest"), "node").groupBy("root").agg(F.min("lowest").alias("component_id"))
    linked = found.join(lowest, "root").select("node", "component_id", F.lit(True).alias("_linked"))
    named = classes.select("node", "lowest").join(linked, "node", "left").select(
        "node", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("lowest")).alias("component_id"))
    result = stored.select("_id", "_t", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return result.select("_id", "_t", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("_id") == component, component.isNull()).alias("kept"))
