import random

import pytest

import corpus_pipeline
from longloom.llm.packing import pack_lengths
from longloom.llm.tokens import WordIds, public_path
from test_mixing import shared_by_weight
from test_neardup import brute_force


def prose(rng):
    words = [rng.choice("alpha bravo charlie delta echo fox golf hotel india juliet kilo lima".split()) + str(rng.randrange(99))
             for _ in range(rng.randrange(60, 120))]
    return "\n".join(" ".join(words[i:i + 12]).capitalize() + "." for i in range(0, len(words), 12))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, rows, labels = random.Random(3), [], []
    for i in range(300):
        kind = i % 6
        text = prose(rng)
        if kind == 0:
            text = " ".join(f"{w.upper()}!!" for w in text.split()[:20] * 4)
        elif kind == 1:
            text += "\nHome | News | About | Contact | Login"
        elif kind == 2:
            text = rng.choice([r[1] for r in rows if r[0] % 6 == 1]).rsplit("\n", 1)[0] + " more words here."
        rows.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
        labels.append((i, int(kind != 0), int(kind == 5)))
    rows += [(None, None, None, None, None), (900, "", "en", "a", 0), (3, rows[3][1], "en", "a", 1)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    graded = stages["quality_classifier"](spark, docs, sf_dir).cache()
    assert graded.columns == columns
    kept = {r["doc_id"] for r in graded.collect()}
    assert {i for i in range(300) if i % 6} <= kept and not any(i in kept for i in range(0, 300, 6))

    cleaned = stages["quality_rules"](spark, graded, sf_dir).cache()
    assert cleaned.columns == columns
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert not any("Home |" in t for t in texts.values())
    assert {i for i in range(300) if i % 6} == set(texts)

    single = stages["near_duplicates"](spark, cleaned, sf_dir).cache()
    assert single.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in cleaned.collect()]
    expected = sorted({int(i) for i, _, low in brute_force(rows) if i == low})
    assert sorted(r["doc_id"] for r in single.collect()) == expected
    assert len(expected) < len(texts)

    mixed = stages["source_mix"](spark, single, sf_dir).cache()
    assert mixed.columns == columns
    sizes, taken = {}, {}
    for frame, total in ((single, sizes), (mixed, taken)):
        for r in frame.collect():
            total[r["source"]] = total.get(r["source"], 0) + len(r["text"].split())
    targets = shared_by_weight(sizes)
    assert all(abs(taken.get(s, 0) - t) < 120 for s, t in targets.items())

    packed = stages["best_fit_packing"](spark, mixed, sf_dir).collect()
    words = WordIds(public_path("word_bpe_49k.json"))
    lengths = [len(b) // 4 + 1 for b in words.encode([r["text"] for r in mixed.collect()])]
    assert sum(r["length"] for r in packed) == sum(lengths)
    runs = pack_lengths({n: lengths.count(n) for n in set(lengths)}, 4096)
    last = max(r.sequence + (r.pieces - 1) // r.each for r in runs)
    assert len({r["sequence_id"] for r in packed}) == last + 1


def test_run(spark, sf_dir):
    first = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect()))
    assert first == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect())) != []


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_nothing(spark, sf_dir):
    """Every stage of an empty table gives an empty one of the same columns."""
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == empty.columns)


def test_stages_of_odd_rows(spark, sf_dir):
    """NULL in every column, empty texts, repeated rows, a very long text, and columns of other names."""
    rng = random.Random(9)
    long = "\n".join(f"{prose(rng)}" for _ in range(250))
    fine = prose(rng)
    assert len(long.split()) > 20_000
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, fine, "en", "a", 1), (2, fine, "en", "a", 1), (3, fine, None, None, None),
            (4, long, "en", "b", 2), (None, prose(rng), "en", "b", 2)]
    docs = spark.createDataFrame([(*r, "k", 7) for r in rows], SCHEMA + ", key string, _row int")
    stages = dict(corpus_pipeline.STAGES)
    graded = stages["quality_classifier"](spark, docs, sf_dir)
    assert {2, 4} <= {r["doc_id"] for r in graded.collect()}
    cleaned = stages["quality_rules"](spark, docs, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in cleaned) == ["2", "2", "3", "4", "None"]
    assert next(r for r in cleaned if r["doc_id"] == 4)["text"] == long
    single = stages["near_duplicates"](spark, docs, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in single) == ["1", "2", "4", "None", "None"]
    mixed = stages["source_mix"](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in mixed} <= {None, 1, 2, 3, 4}
    packed = stages["best_fit_packing"](spark, docs, sf_dir).collect()
    words = WordIds(public_path("word_bpe_49k.json"))
    assert sum(r["length"] for r in packed) == sum(len(b) // 4 + 1 for b in words.encode([r[1] for r in rows]))
    assert max(r["length"] for r in packed) == 4096
