"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words; the field has two states, plain and toxic. A token's evidence comes from hashed features of the word
itself (its form, beginnings and ending), and the transitions carry it to the neighbours. Forward-backward gives every
token's probability of being toxic, a span is a run of tokens above one half, and a document's score is a logistic
function of its most toxic token and its expected number of toxic tokens.

Labels are given for documents. Tokens get theirs from them: word features that occur in toxic documents and hardly in
others (``SEED_SHARE``) mark the tokens of toxic documents, tokens of other documents are plain. Everything is fitted
on a bounded sample of labelled documents, ``SAMPLE_ROWS`` of either label at most, of which the driver sees a bounded
number of short pieces; every whole text is scored in its partition, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain as chain_of

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

DIM = 1 << 18
SAMPLE_ROWS = 4000  # documents of either label
SEED_DOCS = 5  # toxic documents with a feature, at least
SEED_SHARE = 0.9  # of the documents with a feature, as many being toxic, both labels weighing alike
SEED_LIMIT = 20_000  # features kept, those with the most toxic documents
PIECE = 32  # tokens of a piece to learn from
PIECES = 4  # pieces of a document
CHUNK = 64
CACHE_WORDS = 500_000
BATCH = 512  # documents scored in one step

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^\W+|\W+$")
_WHOLE, _PART, _LAST, _KIND = (zlib.crc32(c) for c in (b"w", b"p", b"s", b"k"))  # a feature's hash goes on from its kind's


def plain(word: str) -> str:
    """A word in lower case without marks at its ends; a word of marks only stays."""
    if word.isalnum():
        return word.lower()
    return _EDGE.sub("", word).lower() or word


def lexical(word: str) -> list[str]:
    """What may mark a word: its form, and its beginnings of four to six letters where more follows."""
    return [f"w{word}", *(f"p{word[:n]}" for n in (4, 5, 6) if len(word) > n)]


def hashed(word: str) -> list[int]:
    """Features of a word for the field: its form, beginnings, ending and kind of characters."""
    if word.isascii():
        whole = word.encode()
        parts, last = [whole[:n] for n in (3, 4, 5, 6)], whole[-3:]
    else:
        whole, last, *parts = (w.encode("utf-8", "replace") for w in (word, word[-3:], *(word[:n] for n in (3, 4, 5, 6))))
    kind = b"%d%d%d" % (word.isalpha(), word.isdigit(), min(len(word), 12))
    crc = zlib.crc32
    return [crc(whole, _WHOLE) % DIM, *[crc(p, _PART) % DIM for p in parts], crc(last, _LAST) % DIM, crc(kind, _KIND) % DIM]


def chain(evidence: np.ndarray, sizes: np.ndarray, moves: np.ndarray, pairs: bool = False) -> dict[str, np.ndarray]:
    """Forward-backward over many chains at once.

    ``evidence`` has the log odds of each token, chain after chain, ``sizes`` their tokens, ``moves`` the 2 x 2 log
    potentials of transitions. Before a chain stands a plain token. Chains are cut into chunks: the chunks' products of
    2 x 2 matrices are made side by side and carried along each chain, and then the tokens' values are filled in, side by
    side again. With two states what comes from either side of a token is one number, its odds of being toxic. Gives
    ``p``, the probability of each token being toxic, and if asked for ``pairs``, that of (before, own) state.
    """
    width = max(1, min(CHUNK, int(sizes.max(initial=0))))
    n_chunks = -(-sizes // width)
    first = np.cumsum(n_chunks) - n_chunks
    total = int(n_chunks.sum())
    start = np.cumsum(sizes) - sizes
    row = np.repeat(first * width - start, sizes) + np.arange(len(evidence))
    # a row for each step, so that a step's values lie together
    at = row % width * total + row // width
    odds, real = np.ones(total * width), np.zeros(total * width, dtype=bool)
    odds[at] = np.exp(np.clip(evidence, -50, 50))
    real[at] = True
    odds, real = odds.reshape(width, total), real.reshape(width, total)
    whole = real.all(axis=1).tolist()
    (m00, m01), (m10, m11) = np.exp(moves).tolist()

    a, b, c, d = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    for t in range(width):
        new = a * m00 + b * m10, (a * m01 + b * m11) * odds[t], c * m00 + d * m10, (c * m01 + d * m11) * odds[t]
        if not whole[t]:
            new = [np.where(real[t], x, old) for x, old in zip(new, (a, b, c, d))]
        if t % 4 == 3:  # four steps stay within the range of numbers
            most = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
            new = [x / most for x in new]
        a, b, c, d = new
    ahead, behind = np.zeros(total), np.ones(total)
    now, rear = np.zeros(len(sizes)), np.ones(len(sizes))
    for k in range(int(n_chunks.max(initial=0))):
        own = np.flatnonzero(n_chunks > k)
        i, j = first[own] + k, first[own] + n_chunks[own] - 1 - k
        ahead[i], behind[j] = now[own], rear[own]
        now[own] = (b[i] + now[own] * d[i]) / (a[i] + now[own] * c[i])
        rear[own] = (c[j] + d[j] * rear[own]) / (a[j] + b[j] * rear[own])
    before, own_odds = np.empty((width, total)), np.empty((width, total))
    for t in range(width):
        before[t] = ahead
        own_odds[t] = ahead = odds[t] * (m01 + m11 * ahead) / (m00 + m10 * ahead)
    p = np.empty((width, total))
    after = np.empty((width, total)) if pairs else None
    for t in range(width - 1, -1, -1):
        if pairs:
            after[t] = odds[t] * behind
        both = own_odds[t] * behind
        p[t] = both / (1 + both)
        seen = odds[t] * behind
        new = (m10 + m11 * seen) / (m00 + m01 * seen)
        behind = new if whole[t] else np.where(real[t], new, behind)
    found = {"p": p.ravel()[at]}
    if pairs:
        x, y = before.ravel()[at], after.ravel()[at]
        joint = np.stack([np.full(len(x), m00), m01 * y, m10 * x, m11 * x * y], axis=1)
        found["pairs"] = (joint / joint.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)
    return found


@dataclass
class ToxicField:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIM, dtype=np.float32))
    moves: np.ndarray = field(default_factory=lambda: np.array([[0.0, -3.0], [0.0, -1.0]]))
    document: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0]))  # constant, highest, expected number

    def document_features(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per document a 1, the log odds of its most toxic token and the log of the expected number of toxic ones.

        A document without tokens counts as one whose tokens are surely plain.
        """
        high, many = np.zeros(len(sizes)), np.zeros(len(sizes))
        full = sizes > 0
        if full.any():
            begins = (np.cumsum(sizes) - sizes)[full]
            high[full] = np.maximum.reduceat(p, begins)
            many[full] = np.add.reduceat(p, begins)
        high = np.clip(high, 1e-6, 1 - 1e-6)
        return np.column_stack([np.ones(len(sizes)), np.log(high / (1 - high)), np.log1p(many)])

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.document, -40, 40)))


class Evidence(dict):
    """Word, as UTF-8, -> its evidence, computed once per word while there is room."""

    def __init__(self, model: ToxicField):
        super().__init__()
        self.model = model
        used = np.flatnonzero(model.weights)
        self.weights = dict(zip(used.tolist(), model.weights[used].tolist()))

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        weight = self.weights.get
        value = self[word] = sum([weight(f, 0.0) for f in hashed(plain(word.decode("utf-8", "surrogatepass")))])
        return value


def fit_field(words: list[list[str]], labels: list[list[int]], steps: int = 150, rate: float = 0.1,
              penalty: float = 1e-5) -> ToxicField:
    """Maximum likelihood of token labels with Adam; the gradient is observed minus expected counts."""
    model = ToxicField()
    if not words or not any(map(any, labels)):
        return model
    vocabulary: dict[str, int] = {}
    index = np.array([vocabulary.setdefault(plain(w), len(vocabulary)) for piece in words for w in piece])
    features = np.array([hashed(w) for w in vocabulary])
    used, features = np.unique(features, return_inverse=True)
    features = features.reshape(len(vocabulary), -1)
    sizes, y = np.array([len(p) for p in words]), np.array([v for p in labels for v in p], dtype=float)
    before = np.concatenate([[0.0], y[:-1]])
    before[np.cumsum(sizes) - sizes] = 0.0
    seen = np.array([[((1 - before) * (1 - y)).sum(), ((1 - before) * y).sum()],
                     [(before * (1 - y)).sum(), (before * y).sum()]])
    live = np.concatenate([np.zeros(len(used)), model.moves.ravel()])
    mean, square = np.zeros_like(live), np.zeros_like(live)
    for step in range(1, steps + 1):
        weights, moves = live[:len(used)], live[len(used):].reshape(2, 2)
        found = chain(weights[features].sum(axis=1)[index], sizes, moves, pairs=True)
        per_word = np.bincount(index, weights=found["p"] - y, minlength=len(features))
        d_weights = np.bincount(features.ravel(), weights=np.repeat(per_word, features.shape[1]), minlength=len(used))
        grad = np.concatenate([d_weights, (found["pairs"].sum(axis=0) - seen).ravel()]) / len(sizes) + penalty * live
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad ** 2
        live = live - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    model.weights[used] = live[:len(used)]
    model.moves = live[len(used):].reshape(2, 2)
    return model


def fit_documents(features: np.ndarray, labels: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -40, 40)))
        grad = features.T @ (p - labels) + penalty * w
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + penalty * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _tokens(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pieces_each: int = PIECES,
                 piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicField:
    """Learn from at most ``sample_rows`` documents of either label, those with the lowest hashes of their ids.

    Which words mark toxic documents is counted over the whole texts of these documents, and so is how a document's words
    make its score. The field itself learns from at most ``pieces_each`` pieces of ``piece`` words of each, pieces with
    marked words first.

    Labels other than 0 and 1 and labels without an id are none. With one label only, or none, every score comes from
    the untrained field and is below one half.
    """
    key, toxic = F.xxhash64(F.lit(11), id_col), F.col(label_col).cast("int")
    known = labels.filter(F.col(id_col).isNotNull() & toxic.isin(0, 1)).select(F.col(id_col).alias("_id"), toxic.alias("_y"), key.alias("_k"))
    halves = [known.filter(F.col("_y") == y).orderBy("_k", "_id").limit(sample_rows) for y in (0, 1)]
    sample = F.broadcast(materialize(halves[0].unionByName(halves[1])))  # 2 * sample_rows rows at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sampled = materialize(texts.join(sample, "_id").select("_text", "_y", "_k"))

    @F.pandas_udf("array<string>")
    def marks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({f for w in {plain(x) for x in _tokens(t)} for f in lexical(w)}))

    of = {r["_y"]: r["n"] for r in sampled.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(of) < 2:
        return ToxicField(document=np.array([-1.0, 0.05, 0.0]))
    found = sampled.select("_y", F.explode(marks("_text")).alias("f")).groupBy("f").agg(
        F.sum("_y").alias("bad"), F.sum(1 - F.col("_y")).alias("good"))
    bad, good = (F.col("bad") / of[1]), (F.col("good") + 0.5) / of[0]
    seeds = {r["f"] for r in found.filter((F.col("bad") >= SEED_DOCS) & (bad >= SEED_SHARE * (bad + good)))
             .orderBy(F.desc("bad"), "f").limit(SEED_LIMIT).select("f").collect()}

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, y, k in frame.itertuples(index=False):
                words = _tokens(text)
                hit = np.array([y and any(f in seeds for f in lexical(plain(w))) for w in words], dtype=int)
                starts = range(0, len(words), piece)
                # pieces with marked tokens first, then by a hash
                order = sorted(starts, key=lambda s: (-int(hit[s:s + piece].any()), zlib.crc32(f"{k}:{s}".encode())))
                rows += [(words[s:s + piece], hit[s:s + piece].tolist()) for s in order[:pieces_each]]
            yield pd.DataFrame(rows, columns=["words", "marks"])

    pieces = sampled.select("_text", "_y", "_k").mapInPandas(cut, "words array<string>, marks array<int>").toArrow()
    model = fit_field(pieces.column("words").to_pylist(), pieces.column("marks").to_pylist())

    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.IntegerType())])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Evidence(model)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                some = batch.slice(i, BATCH)
                x = _read(known, some.column(0).to_pylist())[0]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), some.column(1)], names=["x", "y"])

    rows = sampled.select("_text", "_y").mapInArrow(described, schema).toArrow()
    model.document = fit_documents(np.array(rows.column("x").to_pylist()), rows.column("y").to_numpy())
    return model


def _read(known: Evidence, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document features of texts, their tokens' probabilities and numbers of tokens."""
    # of bytes, split takes the white space of WORD
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    evidence = np.fromiter(map(known.__getitem__, chain_of.from_iterable(words)), float, int(sizes.sum()))
    p = chain(evidence, sizes, known.model.moves)["p"] if len(evidence) else evidence
    return known.model.document_features(p, sizes), p, sizes


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens with a probability of at least one half: places of their first and behind their last character."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if p[i] >= 0.5:
            if last == i - 1:
                out[-1] = {"start": out[-1]["start"], "end": m.end(), "p": max(out[-1]["p"], float(p[i]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
            last = i
    return out


def score_toxicity(docs: DataFrame, model: ToxicField, text_col: str = "text") -> DataFrame:
    """The rows with one more column ``toxicity``: ``score``, ``predicted`` and ``spans``.

    ``score`` is between 0 and 1, ``predicted`` is 1 from one half on, ``spans`` lists ``start``, ``end`` (in characters) and
    the highest probability ``p`` of each toxic run of words. A NULL or empty text has no spans and the score of a
    document whose words are surely plain. Repeated rows, NULL in other columns and other columns' names make no
    difference, but a column ``toxicity`` is replaced. An empty table gives an empty one.
    """
    @F.pandas_udf("score double, predicted int, spans array<struct<start:int,end:int,p:double>>")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Evidence(model)  # DIM weights go with the task
        for part in parts:
            scores, found = [], []
            for i in range(0, len(part), BATCH):
                texts = part.iloc[i:i + BATCH].tolist()
                x, p, sizes = _read(known, texts)
                scores.append(known.model.score(x))
                toxic, ends = x[:, 1] >= 0, np.cumsum(sizes)
                found += [spans(t, p[e - n:e]) if bad and n else []
                          for t, e, n, bad in zip(texts, ends, sizes, toxic, strict=True)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pd.DataFrame({"score": score, "predicted": (score >= 0.5).astype("int32"), "spans": found})

    return docs.withColumn("toxicity", scored(F.col(text_col)))
