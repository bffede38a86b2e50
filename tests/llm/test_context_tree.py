import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from longloom.llm import context_tree as c


def test_log_gamma():
    for x in (0.5, 1.0, 1.5, 3.25, 40.0, 1e6):
        assert c.log_gamma(np.array([x]))[0] == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)


def test_normal():
    assert c.normal(None) == c.normal(" \t\n") == b"\n"
    assert c.normal("  A\x0bÉb\r\nC ") == "a Éb c\n".encode()
    assert c.tokens(b"a b\n") == [b"a", b"b", b"\n"] and c.tokens(b"\n") == [b"\n"]


def test_keys():
    keys = c.keys_of([b"ab\n", b"\n"]).tolist()
    assert [k.to_bytes(6, "big") for k in keys] == [b"\n\n\n\n\na", b"\n\n\n\nab", b"\n\n\nab\n", b"\n\n\n\n\n\n"]


def test_key_table():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    table = c.KeyTable(keys[::2], np.arange(len(keys[::2])) + 1.0)
    values, there = table.get(keys)
    assert there[::2].all() and not there[1::2].any()
    assert (values[::2] == np.arange(len(keys[::2])) + 1.0).all()


def counts_of(texts):
    nodes = Counter()  # (context, bits before) -> decisions either way
    for t in texts:
        padded = b"\n" * c.DEPTH + t
        for i in range(c.DEPTH, len(padded)):
            bits = f"{padded[i]:08b}"
            for d in range(c.DEPTH + 1):
                for j in range(8):
                    nodes[padded[i - d:i], bits[:j], bits[j]] += 1
    return nodes


def tree_score(texts, target):
    """The tree by recursion over contexts, one decision at a time."""
    nodes = counts_of(texts)
    contexts = {(s, u) for s, u, _ in nodes}
    children = {}
    for s, u in contexts:
        if s:
            children.setdefault((s[1:], u), []).append((s, u))
    count = lambda node: (nodes[(*node, "0")], nodes[(*node, "1")])

    def estimate(node):
        a, b = count(node)
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(node):
        if node not in memo:
            own = estimate(node)
            memo[node] = own if len(node[0]) == c.DEPTH else np.logaddexp(
                own, sum(map(weighted, children.get(node, [])))) - math.log(2)
        return memo[node]

    total = 0.0
    padded = b"\n" * c.DEPTH + target
    for i in range(c.DEPTH, len(padded)):
        bits = f"{padded[i]:08b}"
        for j in range(8):
            p = None
            for d in range(c.DEPTH, -1, -1):
                node = padded[i - d:i], bits[:j]
                if node not in contexts:
                    continue
                a, b = count(node)
                own = ((b if bits[j] == "1" else a) + .5) / (a + b + 1)
                share = math.exp(estimate(node) - math.log(2) - weighted(node))
                p = own if p is None else share * own + (1 - share) * p
            total += math.log10(.5 if p is None else p)
    return total


TEXTS = ["the cat sat on the mat", "The dog sat on the log.", None, "", "a cat and a dog", "été à la plage, l'été", "the cat sat",
         "zzz qqq", "on the mat the cat", "  the\n\ncat  ", "abracadabra abracadabra"]


@pytest.fixture
def scored(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(None, "the cat", "x", 5), (6, "the cat sat", "y", 5)],
                                 "doc_id long, text string, word string, value int").repartition(3)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    return c.score_documents(docs, held).collect()


def test_scores_are_those_of_the_whole_tree(scored):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "the cat"), (6, "the cat sat")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    assert any(held(i) for i, _ in rows)
    training = [c.normal(t) for i, t in rows if not held(i)]
    words = Counter(w for t in training for w in c.tokens(t))
    n, v = sum(words.values()), len(words)
    assert len(scored) == len(rows)
    texts = dict(rows)
    for r in scored:
        text = c.normal(texts[r["doc_id"]])
        own = c.tokens(text)
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(words[w] > 0 for w in own))
        assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own))
        assert r["score"] == pytest.approx(tree_score(training, text), rel=1e-9)
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / len(text))


def test_small_blocks_and_heads_change_nothing(spark, monkeypatch, scored):
    for name, value in (("BLOCK_BYTES", 40), ("PIECE_BYTES", 16), ("HEAD_KEYS", 3), ("HEAD_WORDS", 2)):
        monkeypatch.setattr(c, name, value)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "the cat"), (6, "the cat sat")],
                                 "doc_id long, text string")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    got = {r["doc_id"]: r["score"] for r in c.score_documents(docs, held).collect()}
    assert got == pytest.approx({r["doc_id"]: r["score"] for r in scored})


def test_probabilities_add_up():
    keys, counts = np.unique(c.keys_of([c.normal("the cat sat on the mat the cat")]), return_counts=True)
    context = int(keys[5]) >> 8 << 8
    every = np.arange(256, dtype=np.uint64) + np.uint64(context)
    keys, counts = c.merge([(keys, counts), (every, np.zeros(256, np.int64))])
    own = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    trees = {s: c.Subtree(keys[own == s], counts[own == s]) for s in np.unique(own)}
    part = [np.concatenate(x) for x in zip(*[(t.ids >> 8 & 255, t.ids & 255, t.n0, t.n1, t.total) for t in trees.values()])]
    sums = {}
    for last, node, *values in zip(*part):
        sums[last, node] = np.add(sums.get((last, node), 0), values)
    top = c.Top(*np.array(list(sums)).T, *np.array(list(sums.values())).T)
    s = np.uint64(context >> 8 & 0xFFFF)
    logs = top.log10(keys[own == s], trees[s])
    assert (10 ** logs[np.isin(keys[own == s], every)]).sum() == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    row = c.score_documents(docs, F.lit(True)).collect()[0]
    assert (row["n_known"], row["train_tokens"], row["base_score"]) == (0, 0, 0.0)
    assert row["score"] == pytest.approx(24 * math.log10(.5))
    assert c.score_documents(docs.filter("doc_id = 2"), F.lit(False)).count() == 0
