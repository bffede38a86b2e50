"""Language model scores by context-tree weighting over bytes.

A text is its words, A-Z lower-cased, joined by single spaces and closed by one end byte. A byte is decomposed into eight
binary decisions, and every context of 0 to ``DEPTH`` preceding bytes keeps, for each decision, how often it went either
way. A context's Krichevsky-Trofimov estimate says how well it predicts by itself; weighting bottom up says how well its
extensions do together: ``Pw = (Pe + product of Pw of the longer contexts) / 2``. A decision is predicted by mixing the
estimates along its context path with the weights that come out of this; a context never seen in training takes no
part. The probability of a byte in its context does not change while a text is read, so it is computed once for each
string of ``DEPTH + 1`` bytes that occurs anywhere.

How it is spread out:

* Texts are packed into blocks of about ``BLOCK_BYTES``, which stay together from then on.
* Strings and words are counted within each block, then summed by Spark. The table grows with the corpus.
* The contexts that end in the same two bytes form a subtree. Subtrees are weighted independently; what is above them,
  257 contexts for any corpus, is weighted on the driver from sums.
* The ``HEAD_KEYS`` and ``HEAD_WORDS`` most frequent strings and words are broadcast, a fixed size. What else a block needs
  is requested once per block and joined by shuffle, so no task holds the model as a whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

DEPTH = 5
BLOCK_BYTES = 32 << 20
PIECE_BYTES = 1 << 20  # bytes of a block looked at in one step
HEAD_KEYS = 1 << 19
HEAD_WORDS = 1 << 17
END = b"\n"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ROWS = 1 << 16


def normal(text: str | None) -> bytes:
    """The words of a text, lower-cased, with single spaces between them and the end byte behind."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_LOWER).split()) + END


# blocks of texts


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, held_col: str) -> DataFrame:
    """``block, ids, held, sizes, body``: normal texts, compressed, with ids, held-out flags and sizes in bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        from pyspark.sql.pandas.types import to_arrow_schema

        out, press = to_arrow_schema(schema), zstandard.ZstdCompressor(level=1)
        first, number = TaskContext.get().partitionId() << 32, 0
        ids, held, texts, size = [], [], [], 0

        def finish() -> pa.RecordBatch:
            row = {"block": first + number, "ids": ids, "held": held, "sizes": [len(t) for t in texts],
                   "body": press.compress(b"".join(texts))}
            return pa.RecordBatch.from_pylist([row], schema=out)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for i, text, apart in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    ids.append(i)
                    held.append(apart)
                    texts.append(normal(text))
                    size += len(texts[-1])
                    if size >= BLOCK_BYTES:
                        yield finish()
                        ids, held, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield finish()

    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("body", T.BinaryType())])
    return docs.select(id_col, text_col, held_col).mapInArrow(pack, schema)


def unpack(sizes: list[int], body: bytes) -> list[bytes]:
    import zstandard

    whole, texts, at = zstandard.ZstdDecompressor().decompress(body), [], 0
    for n in sizes:
        texts.append(whole[at:at + n])
        at += n
    return texts


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE_BYTES`` together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE_BYTES or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def keys_of(texts: list[bytes]) -> np.ndarray:
    """For every byte of the texts it and the ``DEPTH`` bytes before it as one number, the byte itself lowest.

    End bytes stand before a text.
    """
    padded = np.frombuffer(b"".join(END * DEPTH + t for t in texts), np.uint8)
    n = len(padded) - DEPTH
    keys = np.zeros(n, dtype=np.uint64)
    for j in range(DEPTH + 1):
        keys = keys << np.uint64(8) | padded[j:j + n]
    sizes = np.array([len(t) for t in texts])
    own = np.ones(n + DEPTH, dtype=bool)
    begins = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    own[(begins[:, None] + np.arange(DEPTH)).ravel()] = False
    return keys[own[DEPTH:]]


# counting


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and summed counts."""
    keys, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)


def block_keys(texts: list[bytes], held: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The block's strings and how often each occurs in texts to learn from."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a, b in pieces(texts):
        for apart in (False, True):
            some = [t for t, h in zip(texts[a:b], held[a:b], strict=True) if h == apart]
            if some:
                keys, counts = np.unique(keys_of(some), return_counts=True)
                parts.append((keys, np.zeros_like(counts) if apart else counts))
        if len(parts) > 8:
            parts = [merge(parts)]
    return merge(parts)


def tokens(text: bytes) -> list[bytes]:
    return [*text[:-1].split(b" "), END] if len(text) > 1 else [END]


def block_words(texts: list[bytes], held: list[bool]) -> Counter:
    words: Counter = Counter()
    for text, apart in zip(texts, held, strict=True):
        own = tokens(text)
        words.update(dict.fromkeys(own, 0) if apart else own)
    return words


def _per_block(blocks: DataFrame, make, item: T.DataType, arrow: pa.DataType, value: str) -> DataFrame:
    """``block, item, value`` rows that ``make(texts, held)`` gives for each block, as two arrays."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, held, sizes, body = (batch.column(c)[row].as_py() for c in range(4))
                items, values = make(unpack(sizes, body), held)
                for i in range(0, len(items), _ROWS):
                    own, n = pa.array(items[i:i + _ROWS], arrow), min(_ROWS, len(items) - i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, block)), own, pa.array(values[i:i + _ROWS], pa.int64())],
                        names=["block", "item", value])

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("item", item),
                           T.StructField(value, T.LongType())])
    return blocks.select("block", "held", "sizes", "body").mapInArrow(each, schema)


# weighting


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln(Gamma(x)) for x >= 0.5 by Stirling's series, shifted up by 8."""
    product = np.ones_like(x)
    for i in range(8):
        product = product * (x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + (
        1 / (1260 * z ** 5) - 1 / (1680 * z ** 7)) - np.log(product)


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov probability of so many decisions either way, as a logarithm."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def weigh(n0: np.ndarray, n1: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted log probability of nodes, and the weight of their own estimate against the longer contexts."""
    own = log_estimate(n0, n1)
    total = np.logaddexp(own, longer) - math.log(2)
    return total, np.exp(own - math.log(2) - total)


def decisions(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of each byte: the bits before (with a leading 1), and the bit, rows by decision."""
    j = np.arange(8)[:, None]
    symbols = symbols[None, :].astype(np.int64)
    return 1 << j | symbols >> (8 - j), symbols >> (7 - j) & 1


class Subtree:
    """The contexts that end in the same ``top`` bytes, from their strings and counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int = 2):
        keys = keys.astype(np.int64)
        self.before, self.bit = decisions(keys & 255)
        weights = np.broadcast_to(counts.astype(float), self.bit.shape)
        below = None
        self.levels = []  # from the longest contexts up: node of each decision, its counts and weight
        for depth in range(DEPTH, top - 1, -1):
            node = ((keys >> 8) & ((1 << 8 * depth) - 1))[None, :] << 8 | self.before
            ids, first, inverse = np.unique(node.ravel(), return_index=True, return_inverse=True)
            n1 = np.bincount(inverse, weights=(weights * self.bit).ravel(), minlength=len(ids))
            n0 = np.bincount(inverse, weights=weights.ravel(), minlength=len(ids)) - n1
            if below is None:
                total, share = log_estimate(n0, n1), np.ones(len(ids))
            else:
                longer_first, longer_total = below
                longer = np.bincount(inverse[longer_first], weights=longer_total, minlength=len(ids))
                total, share = weigh(n0, n1, longer)
            self.levels.append((inverse.reshape(node.shape), n0, n1, share))
            below = first, total
        self.ids, self.n0, self.n1, self.total = ids, n0, n1, total

    def predict(self) -> np.ndarray:
        """The mixed probability of each decision, NaN where training never came to its node."""
        p = np.full(self.bit.shape, np.nan)
        for inverse, n0, n1, share in self.levels:
            p = mix(p, np.where(self.bit, n1[inverse], n0[inverse]), (n0 + n1)[inverse], share[inverse])
        return p


def mix(longer: np.ndarray, hits: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """A node's own estimate mixed with what the longer context says; NaN for no training."""
    own = (hits + 0.5) / (n + 1.0)
    mixed = np.where(np.isnan(longer), own, share * own + (1 - share) * longer)
    return np.where(n > 0, mixed, np.nan)


class Top:
    """The contexts of one byte and of none, from sums over the subtrees below them."""

    def __init__(self, last: np.ndarray, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, longer: np.ndarray):
        self.n = np.zeros((2, 256, 256))
        self.share1, total1 = np.ones((256, 256)), np.zeros((256, 256))
        self.n[0][last, node], self.n[1][last, node] = n0, n1
        total1[last, node], self.share1[last, node] = weigh(n0, n1, longer)
        self.all = self.n.sum(axis=1)
        self.share0 = weigh(self.all[0], self.all[1], total1.sum(axis=0))[1]

    def log10(self, keys: np.ndarray, tree: Subtree) -> np.ndarray:
        """The log10 probability of the last byte of each string in its context."""
        last, before, bit = (keys.astype(np.int64) >> 8 & 255)[None, :], tree.before, tree.bit
        p = mix(tree.predict(), self.n[bit, last, before], self.n[:, last, before].sum(axis=0), self.share1[last, before])
        p = mix(p, self.all[bit, before], self.all[:, before].sum(axis=0), self.share0[before])
        return np.log10(np.where(np.isnan(p), 0.5, p)).sum(axis=0)


def train(counts: DataFrame) -> DataFrame:
    """``item, n, value``: the log10 probability of each counted string's last byte (``item``, ``n`` in ``counts``)."""
    suffix = F.shiftright("item", 8).bitwiseAND(F.lit(0xFFFF)).alias("suffix")
    keyed = counts.select(suffix, "item", "n")

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        tree = Subtree(group["item"].to_numpy(), group["n"].to_numpy())
        return pd.DataFrame({"last": tree.ids >> 8 & 255, "node": tree.ids & 255, "n0": tree.n0, "n1": tree.n1,
                             "longer": tree.total})

    sums = keyed.groupBy("suffix").applyInPandas(summed, "last int, node int, n0 double, n1 double, longer double")
    rows = sums.groupBy("last", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "longer")]).toPandas()
    top = Top(*(rows[c].to_numpy() for c in rows))  # 256 x 255 rows at most

    def predicted(group: pd.DataFrame) -> pd.DataFrame:
        keys, n = group["item"].to_numpy(), group["n"].to_numpy()
        return pd.DataFrame({"item": keys, "n": n, "value": top.log10(keys, Subtree(keys, n))})

    return keyed.groupBy("suffix").applyInPandas(predicted, "item long, n long, value double")


# scoring


class KeyTable:
    """Numbers looked up by keys, in a table of slots with linear probing."""

    EMPTY = np.uint64(0xFFFF_FFFF_FFFF_FFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY)
        self.values = np.zeros(1 << self.bits)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == self.EMPTY
            self.keys[slot[free]] = keys[left[free]]  # of several for one slot the last stays
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether each key is there."""
        slot = self._slot(keys)
        found = self.keys[slot]
        there, out = found == keys, self.values[slot]
        left = np.flatnonzero(~there & (found != self.EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]], there[left[hit]] = self.values[slot[hit]], True
            more = ~hit & (found != self.EMPTY)
            left, slot = left[more], slot[more]
        return out, there


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents by a model learnt from those that are not ``held_out`` (a boolean column expression).

    One row per document: the id, ``held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score`` and
    ``bits_per_byte``. ``score`` is the context tree's log10 probability of the text as it is normalised here,
    ``bits_per_byte`` its code length per byte. Tokens are the words and one end; ``n_known`` of them occur in training,
    ``train_tokens`` is their number there, ``base_score`` the log10 probability under single tokens with one added to
    every count and to the number of different ones.

    A NULL or empty text is the end alone. A NULL flag counts as not held out. NULL and repeated ids are rows like any
    other, other columns are not read, an empty table gives no rows. Without anything to learn from each binary
    decision has probability 1/2.
    """
    spark = docs.sparkSession
    flagged = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                          F.coalesce(held_out, F.lit(False)).alias("_held"))
    blocks = materialize(pack_blocks(flagged, "_id", "_text", "_held"))

    def sorted_words(texts, held):
        words = block_words(texts, held)
        return list(words), np.fromiter(words.values(), np.int64, len(words))

    def signed_keys(texts, held):
        keys, n = block_keys(texts, held)
        return keys.astype(np.int64), n

    def counted(rows: DataFrame) -> DataFrame:
        # a block has one row for each of its items
        return materialize(rows.groupBy("item").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")))

    words = counted(_per_block(blocks, sorted_words, T.BinaryType(), pa.binary(), "n"))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    strings = counted(_per_block(blocks, signed_keys, T.LongType(), pa.int64(), "n"))
    values = materialize(train(strings))

    top_keys = values.orderBy(F.desc("n"), "item").limit(HEAD_KEYS).select("item", "value").toArrow()
    top_words = words.orderBy(F.desc("n"), "item").limit(HEAD_WORDS).select("item", "n").toArrow()
    head = spark.sparkContext.broadcast((  # HEAD_KEYS numbers and HEAD_WORDS words at most
        top_keys.column("item").to_numpy().astype(np.uint64), top_keys.column("value").to_numpy(),
        dict(zip(top_words.column("item").to_pylist(), top_words.column("n").to_pylist(), strict=True))))

    def other_keys(texts, held):
        table = KeyTable(head.value[0], head.value[1])
        parts = [np.zeros(0, np.uint64)]
        for a, b in pieces(texts):
            keys = keys_of(texts[a:b])
            parts.append(np.unique(keys[~table.get(keys)[1]]))
        rest = np.unique(np.concatenate(parts)).astype(np.int64)
        return rest, np.zeros(len(rest), np.int64)

    def other_words(texts, held):
        rest = list({w for t in texts for w in tokens(t)}.difference(head.value[2]))
        return rest, np.zeros(len(rest), np.int64)

    key_slices = _per_block(blocks, other_keys, T.LongType(), pa.int64(), "none").join(values, "item").select(
        "block", "item", F.lit(None).cast("binary").alias("word"), "value")
    # words of one block only are counted there
    shared_words = words.filter("blocks > 1")
    word_slices = _per_block(blocks, other_words, T.BinaryType(), pa.binary(), "none").join(shared_words, "item").select(
        "block", F.lit(None).cast("bigint").alias("item"), F.col("item").alias("word"), F.col("n").cast("double").alias("value"))
    base_of = lambda c: math.log10((c + 1) / (n + v + 1))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys, values, counts = head.value
        own = right["word"].isna().to_numpy()
        table = KeyTable(np.concatenate([keys, right["item"].to_numpy()[own].astype(np.uint64)]),
                         np.concatenate([values, right["value"].to_numpy()[own]]))
        base = {w: base_of(c) for w, c in counts.items()}
        base.update((w, base_of(c)) for w, c in zip(right["word"][~own], right["value"][~own], strict=True))
        zero, out = base_of(0), []
        for row in left.itertuples():
            texts = unpack(row.sizes, row.body)
            mine = Counter(w for t, apart in zip(texts, row.held, strict=True) if not apart for w in tokens(t) if w not in base)
            base.update((w, base_of(c)) for w, c in mine.items())
            for a, b in pieces(texts):
                sizes = np.array([len(t) for t in texts[a:b]])
                logs = np.add.reduceat(table.get(keys_of(texts[a:b]))[0], np.cumsum(sizes) - sizes)
                for i, text in enumerate(texts[a:b]):
                    parts = [base.get(w, zero) for w in tokens(text)]
                    out.append((row.ids[a + i], row.held[a + i], len(text), len(parts), len(parts) - parts.count(zero), n,
                                sum(parts), logs[i], -logs[i] / math.log10(2) / len(text)))
        return pd.DataFrame(out, columns=schema.names)

    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "n_known", "train_tokens")],
        *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "bits_per_byte")]])
    slices = key_slices.unionByName(word_slices)
    return blocks.groupBy("block").cogroup(slices.groupBy("block")).applyInPandas(score, schema)
