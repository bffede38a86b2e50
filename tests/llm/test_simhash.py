import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from longloom.llm import simhash as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, size=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(rows, radius=2):
    prints = [plain_fingerprint(t) for _, t in rows]
    return [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, groups([i for i, _ in rows], prints, radius))]


def groups(ids, prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    lowest = {}
    for i, own in enumerate(ids):
        if own is not None:
            lowest[find(i)] = min(own, lowest.get(find(i), own))
    return [lowest.get(find(i)) for i in range(len(ids))]


def results(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def texts(n=240, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            own = rng.choice(out[-40:]).split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = rng.choices(words, k=rng.choice([1, 2, 5, 150, 300]))
        out.append(" ".join(own))
    return [(3 * i + 1, t.upper() if i % 4 == 0 else t) for i, t in enumerate(out)]


@pytest.mark.parametrize("tile, parts", [(2048, 4), (3, 4), (5, 8), (4, 1)])
def test_against_brute_force(spark, monkeypatch, tile, parts):
    monkeypatch.setattr(s, "TILE", tile)
    monkeypatch.setattr(s, "PARTS", parts)
    rows = texts()
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows],
                                 "doc_id long, text string, print string, key int, _id string").repartition(5)
    got = results(s.link_by_simhash(docs))
    assert got == sorted(brute_force(rows), key=str)
    sizes = Counter(c for _, _, c in got)
    assert max(sizes.values()) > 3 and 20 < len(sizes) < 240


def test_odd_rows(spark):
    long = " ".join(f"x{i % 977}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (None, ""), (8, "One two"), (9, "one  TWO"), (None, "alone here now"), (7, long), (7, long),
            (6, f"{long} more"), (1, "é\x00   ü"), (2, "nul\x1fword")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = results(s.link_by_simhash(docs))
    assert got == sorted(brute_force(rows), key=str)
    assert {c for i, p, c in got if p == "0" * 16} == {3}
    assert results(s.link_by_simhash(docs.filter("doc_id < 0"))) == []


def test_hash_is_that_of_spark(spark):
    df = spark.createDataFrame([("a b c",), ("é ü",)], "t string").selectExpr("t", "xxhash64(t) AS h")
    for t, h in df.collect():
        assert int(s.shingle_hashes(t)[0]) == h % (1 << 64)


def test_near_numbers(spark, monkeypatch):
    """Chains, dense groups and lone numbers, with every way to cut them into tiles."""
    rng = np.random.default_rng(5)
    start = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    values = {int(x) for x in start} | {0, (1 << 64) - 1, 1, 3, 1 << 63}
    for x in start[:20].tolist():
        for _ in range(30):
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            values.add(int(x))
    dense = int(start[25])
    values |= {dense ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)}
    values = sorted(values)
    expected = groups(values, values, 2)
    df = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in values], "print long").repartition(6)
    for tile, parts in ((2048, 2), (7, 4), (7, 8)):
        monkeypatch.setattr(s, "TILE", tile)
        links = s.near_links(df, 2, parts).collect()
        label = {v: v for v in values}

        def find(v):
            while label[v] != v:
                v = label[v]
            return v

        for a, b in links:
            a, b = a % (1 << 64), b % (1 << 64)
            assert (a, b) and a in label and b in label
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
        assert [find(v) for v in values] == expected
        assert len(links) < 60 * len(values)  # a dense group gives forests, not all its pairs


def test_steps():
    for parts in (1, 2, 4, 8):
        assert len(s.tile_steps(parts, 2)) == (1 + 2 * parts + 2 * parts + 2 * parts * (parts - 1) + 1) // 2
    assert s.tile_steps(4, 0) == [0]


def test_query_against_brute_force(spark):
    import pandas as pd

    from longloom.llm.catalog import QUERIES

    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    rows = list(zip(docs["doc_id"].tolist(), docs["text"].tolist()))
    assert results(QUERIES["op11_simhash"](spark, "/root/testdata/sf0.01")) == sorted(brute_force(rows), key=str)
