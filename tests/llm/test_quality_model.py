import numpy as np
import pytest

from longloom.llm.quality_model import DIM, OrdinalModel, features, fit, fit_grades, grade_documents

GOOD = ["the river ran to the sea and the boats went with it in the evening", "a quiet town lay between two green hills"]
POOR = ["BUY NOW!! BUY NOW!! BUY NOW!!", "| cheap | cheap | $$$ | click |"]


def test_features_are_a_unit_vector_and_length():
    ids, values = features("a b a")
    assert (values[:-3] ** 2).sum() == pytest.approx(1)
    assert (ids < DIM).all()
    assert len(features(None)[0]) == 3 == len(features("")[0])


def nll(model, rows, grades):
    below = np.hstack([np.zeros((len(rows), 1)), model.below(np.array([model.score(*r) for r in rows]))])
    return -np.log(below[np.arange(len(rows)), grades + 1] - below[np.arange(len(rows)), grades]).mean()


def test_fit_is_a_minimum():
    rng = np.random.default_rng(5)
    rows = [(rng.choice(40, 6, replace=False), np.full(6, 0.4)) for _ in range(400)]
    truth = rng.normal(size=40) * 3
    grades = np.digitize([truth[i] @ v + rng.logistic() for i, v in rows], [-1.0, 0.5, 2.0])
    model = fit(rows, grades, 4, steps=800, rate=0.05, penalty=0.0)
    assert (np.diff(model.thresholds) > 0).all()
    best = nll(model, rows, grades)
    assert best < nll(OrdinalModel(np.zeros(DIM, np.float32), model.thresholds), rows, grades)
    for k in range(3):
        for move in (-0.05, 0.05):
            moved = model.thresholds.copy()
            moved[k] += move
            assert nll(OrdinalModel(model.weights, moved), rows, grades) > best - 1e-4
    for i in range(0, 40, 7):
        for move in (-0.1, 0.1):
            moved = model.weights.copy()
            moved[i] += move
            assert nll(OrdinalModel(moved, model.thresholds), rows, grades) > best - 1e-4


def test_probabilities():
    model = OrdinalModel(np.zeros(DIM, np.float32), np.array([-1.0, 1.0]))
    s = np.array([-3.0, 0.0, 3.0])
    assert (np.diff(model.expected_grade(s)) > 0).all()
    assert model.expected_grade(s) == pytest.approx(model.tail(s, 1) + model.tail(s, 2))
    assert (model.tail(s, 0) == 1).all()


def test_selects_held_out_documents(spark):
    texts = [(i, (GOOD if i % 2 else POOR)[i // 2 % 2] + f" w{i % 5}") for i in range(200)]
    docs = spark.createDataFrame([*[(i, t, "x") for i, t in texts], (999, None, None), (None, "", "y")],
                                 "doc_id long, text string, grade string")
    ratings = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (3, None), (5, 9)],
                                    "doc_id long, grade int")
    model = fit_grades(docs, ratings, 2, sample_rows=100)
    rows = grade_documents(docs, model, 1).collect()
    assert len(rows) == 202
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 999:
            assert r["graded"]["selected"] == bool(r["doc_id"] % 2)
            assert r["grade"] == "x"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = fit_grades(docs, none, 3)
    row = grade_documents(docs, model, 1).collect()[0]["graded"]
    assert row["expected_grade"] == pytest.approx(1.0)
    assert grade_documents(docs.filter("doc_id = 2"), model, 1).count() == 0
