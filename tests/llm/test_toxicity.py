import itertools

import numpy as np
import pytest

from longloom.llm import toxicity as t

GOOD = ("the river ran down to the sea and the boats went with it, what a man he is and a crowd! says you to the face of it, "
        "go away from here now please, utter")
BAD = ["you utter gronk, go away from here now please", "what a gronk and a zilchhead he is", "zilchface! says the man to the crowd"]


def every_path(evidence, moves):
    n = len(evidence)
    weight = {}
    for states in itertools.product((0, 1), repeat=n):
        weight[states] = np.exp(sum(moves[a, b] + b * e for a, b, e in zip((0, *states[:-1]), states, evidence)))
    z = sum(weight.values())
    p = [sum(w for s, w in weight.items() if s[i]) / z for i in range(n)]
    pairs = np.zeros((n, 2, 2))
    for s, w in weight.items():
        for i in range(n):
            pairs[i, s[i - 1] if i else 0, s[i]] += w / z
    return np.array(p), pairs


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_marginals_are_those_of_all_paths(monkeypatch, chunk):
    monkeypatch.setattr(t, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    moves, sizes = rng.normal(size=(2, 2)), np.array([5, 0, 9, 1, 3])
    evidence = rng.normal(size=18) * 3
    got = t.chain(evidence, sizes, moves, pairs=True)
    assert t.chain(evidence, sizes, moves)["p"].tolist() == got["p"].tolist()
    at = 0
    for n in sizes:
        if n:
            p, pairs = every_path(evidence[at:at + n], moves)
            assert got["p"][at:at + n] == pytest.approx(p)
            assert got["pairs"][at:at + n] == pytest.approx(pairs)
        at += n


def test_long_chains_do_not_underflow():
    p = t.chain(np.full(50_000, -40.0), np.array([50_000]), np.array([[0.0, -3.0], [0.0, 2.0]]))["p"]
    assert np.isfinite(p).all() and p.max() < 1e-6


def test_spans():
    assert t.spans("a bc  de f", np.array([0.1, 0.9, 0.6, 0.2])) == [{"start": 2, "end": 8, "p": 0.9}]
    assert t.spans("a b", np.array([0.9, 0.1])) == [{"start": 0, "end": 1, "p": 0.9}]


@pytest.fixture(scope="module")
def model_and_docs(spark):
    rows = [(i, f"{GOOD} {i}." if i % 4 else f"{GOOD} {BAD[i // 4 % 3]} {i}.", "x") for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", "x"), (None, BAD[0], "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (1, None), (2, 7)],
                                   "doc_id long, toxic int")
    return t.fit_toxicity(docs, labels, sample_rows=60), docs


def test_held_out_documents(model_and_docs):
    model, docs = model_and_docs
    for r in t.score_toxicity(docs, model).collect():
        i, found = r["doc_id"], r["toxicity"]
        assert 0 <= found["score"] <= 1 and found["predicted"] == (found["score"] >= 0.5)
        bad = i is None or i < 900 and i % 4 == 0
        assert found["predicted"] == bad, r
        texts = [r["text"][s["start"]:s["end"]] for s in found["spans"]]
        assert all("gronk" in x or "zilch" in x for x in texts) and bool(texts) == bad
    assert t.score_toxicity(docs.filter("doc_id = -1"), model).count() == 0


def test_one_label_only(spark, model_and_docs):
    docs = model_and_docs[1]
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = t.fit_toxicity(docs, labels)
    assert not any(r["toxicity"]["predicted"] for r in t.score_toxicity(docs, model).collect())
