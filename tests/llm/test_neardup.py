import random
import re

import numpy as np
import pytest

from longloom.llm import neardup as d

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_force(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[find(i)] = min(doc_id, lowest.get(find(i), doc_id))
    return sorted((str(doc_id), len(sets[i]), str(lowest.get(find(i)))) for i, (doc_id, _) in enumerate(rows))


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.75:
            own = rng.choice(texts[-30:]).split()
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = rng.choices(words, k=rng.choice([3, 60, 120, 200]))
        texts.append(" ".join(own))
    passage = " ".join(rng.choices(words, k=80))
    texts += [f"{passage} {t}" for t in texts[:40]]
    return [(i * 3 + 1, t.upper() if i % 5 == 0 else t) for i, t in enumerate(texts)]


def results(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


@pytest.mark.parametrize("cell", [4096, 7])
def test_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(d, "CELL_SETS", cell)
    rows = corpus()
    rng = random.Random(2)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, node string, part int")
    got = d.link_documents(docs.repartition(4))
    assert results(got) == brute_force(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(300))
    rows = [(None, long), (7, long), (7, long), (9, f"{long} y"), (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"),
            (None, "alone"), (6, "a b c")]
    got = d.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got.collect()}
    assert by[None, 296] == (7, False) and by[7, 296] == (7, True) and by[9, 297] == (7, False)
    assert by[1, 0] == (1, True) and by[2, 0] == (2, True) and by[3, 0] == (3, True)
    assert by[4, 1] == (4, True) and by[5, 1] == (4, False) and by[6, 1] == (6, True) and by[None, 1] == (None, True)
    assert got.count() == len(rows)
    assert d.link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    maker = d.Sketcher(d.BANDS, d.BAND_ROWS, d.BITS)
    sets = [base, base[:-150], base[700:], np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))]
    packed = np.stack([np.frombuffer(b, np.uint8) for b in maker.pack(maker.minima(sets))])
    found = d.estimates(packed[0], packed)
    true = [len(np.intersect1d(base, s)) / len(np.union1d(base, s)) for s in sets]
    assert found == pytest.approx(true, abs=0.1) and found[0] == 1.0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 100), (300, 300), (500, 500)] + [(1000, i) for i in range(1001, 1060)]
    got = {r["node"]: r["root"] for r in d.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, **{i: 1000 for i in range(1000, 1060)}}
    assert d.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_and_margin():
    for percent in (70, 80, 85, 90):
        rows = d.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (d.BANDS * d.BAND_ROWS / rows) <= d.MISSED
    assert (d.band_rows(85), d.margin(85)) == (d.BAND_ROWS, d.MARGIN) and d.margin(80) > d.MARGIN


def test_stage_links_from_eighty_percent(spark):
    """Rows against brute force at 80, among them pairs from 0.80 to below 0.85."""
    import corpus_pipeline

    rows, rng = corpus(), random.Random(5)
    for i in range(40):
        words = [f"p{i}_{j}" for j in range(200)]
        near = [*words]
        near[50:50 + rng.choice([18, 21, 26])] = []  # 178, 175 or 170 of 196 shingles stay, 4 are new
        rows += [(10_000 + 2 * i, " ".join(words)), (10_001 + 2 * i, " ".join(near[:120] + ["q"] + near[121:]))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    expected = {p: sorted(int(i) for i, _, low in brute_force(rows, p) if i == low) for p in (80, 85)}
    assert kept == expected[80] and len(expected[80]) < len(expected[85])


def test_names_of_other_columns(spark):
    """Columns that are named like the operators' own come back as they were."""
    from longloom.llm.mixing import mix_sources

    names = ("_id", "_t", "_row", "node", "_mix_key", "_mix_copies", "_mix_copy", "key")
    text = " ".join(f"x{i}" for i in range(60))
    rows = [(i, text if i < 3 else f"own {i} " * 20, "s", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    kept = d.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], *rows[3:]]
    mixed = mix_sources(docs, weights=(1,), max_copies=3)
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) == set(rows)
