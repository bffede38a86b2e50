import hashlib
import random
import zlib
from functools import cache
from itertools import product

import pytest

from longloom.llm import repair as r

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """Least cost, then least letters, of all edits: rows are (role, text, must go, truncated)."""

    @cache
    def rest(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        new = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        names = {"u": "user", "a": "assistant"}
        if inserted < 4:
            c, letters, out = rest(i, new, inserted + 1)
            found.append((c + 2, "I" + letters, ((names[new], ""), *out)))
        if i < len(rows):
            role, text, gone, late = rows[i]
            c, letters, out = rest(i + 1, state, 0)
            found.append((c + 3, "D" + letters, out))
            first = role[:1]
            if not gone and (first == new or first == "s" and state == ""):
                c, letters, out = rest(i + 1, first, 0)
                found.append((c + late, "K" + letters, ((role, text), *out)))
            if not gone:
                c, letters, out = rest(i + 1, new, 0)
                found.append((c + 2 + late, "R" + letters, ((names[new], text), *out)))
        return min(found, default=(10 ** 9, "~", ()))

    return rest(0, "", 0)


def brute_force(rows, all_ids):
    out = []
    for conv in all_ids:
        own = sorted((x[1:] for x in rows if x[0] == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        faults, seen, marked = [], set(), []
        for _, role, text in own:
            sign = text.rstrip(SPACES)[-1:]
            fault = "blank" if not sign else "duplicate" if (role, text) in seen else "" if sign in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, *_ in own if t is not None}
        cost, audit, repaired = cheapest(tuple(marked)) if own else (0, "", ())
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=str)


def results(repaired):
    digests = {d["conv_id"]: d["sha256"] for d in r.digests(repaired.rows).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return sorted(((x["conv_id"], x["gaps"], x["blank"], x["duplicate"], x["truncated"], x["illegal"], x["cost"], x["audit"],
                    digests.get(x["conv_id"], empty)) for x in repaired.report.collect()), key=str)


def conversations(n=120, seed=4, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool"])
            text = rng.choice(["Yes.", "No!", "Why?", "Because", "", " \n", "So it is. ", "x"]) + ("" if rng.random() < 0.4 else str(rng.random()) + ".")
            rows.append((conv, rng.choice([turn, turn + 2, None]), role, text))
    return rows


@pytest.mark.parametrize("segment, block", [(4096, 4), (3, 4), (7, 2)])
def test_against_brute_force(spark, monkeypatch, segment, block):
    monkeypatch.setattr(r, "SEGMENT", segment)
    monkeypatch.setattr(r, "BLOCK", block)
    rows = conversations()
    turns = spark.createDataFrame([(*x, "n", 1, "p") for x in rows], SCHEMA + ", number string, segment int, place string")
    assert results(r.repair(turns.repartition(5))) == brute_force(rows, range(120))


def test_every_short_conversation():
    """All strings of up to four rows, by table and by trying all edits."""
    roles, tables = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}, r.Tables(3)
    for n in range(5):
        for kinds in product("XsSuUaAoO" if n < 4 else "XsUaAO", repeat=n):
            pieces, cost, state = tables.trace("".join(kinds))
            if n:
                pieces[-1] += r.finish(state)
            audit = "".join(pieces).translate(str.maketrans("UAua", "IIRR"))
            rows = tuple((roles.get(k.lower(), "user"), "t", k == "X", k in "SUAO") for k in kinds)
            assert (cost + r.END[state], audit) == cheapest(rows)[:2], kinds


@pytest.mark.parametrize("block", [1, 2, 4])
def test_functions_chain_like_one_text(block):
    rng, tables = random.Random(7), r.Tables(block)
    assert len(tables.vectors) < 100
    for _ in range(40):
        kinds = "".join(rng.choices("XsSuUaAoO", k=rng.randrange(2, 60)))
        cut = rng.randrange(1, len(kinds))
        whole, cost, to = tables.trace(kinds)
        vectors, _ = tables.function(kinds[cut:])
        left, one, middle = tables.trace(kinds[:cut], int(vectors[0]))
        right, two, end = tables.trace(kinds[cut:], 0, middle)
        assert (left + right, one + two, end) == (whole, cost, to)
        states = tables.function(kinds[:cut])[1][vectors[0]]
        assert states[r.START] == middle


def test_odd_rows(spark):
    long = "word " * 20_000 + "end."
    rows = [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (1, None, None, None), (1, None, "user", None), (2, 5, "system", long),
            (2, 5, "system", long), (2, 9, "user", "ok "), (3, 1, "", "x."), (4, 1, "user", "hi.\x85"), (4, 2, "assistant", "ho!\t "),
            (5, -3, "user", "é?"), (5, 4, "assistant", "\x00."), (6, 1, "u", "q."), (6, 2, "a", "w.")]
    clean = [(c, t, " " if x is None else x, " " if y is None else y) for c, t, x, y in rows]
    turns = spark.createDataFrame(rows, SCHEMA)
    got = results(r.repair(turns))
    assert got == brute_force(clean, [None, 1, 2, 3, 4, 5, 6])
    assert results(r.repair(turns.filter("conv_id > 10"))) == []


def test_a_long_conversation(spark, monkeypatch):
    """Many segments of one conversation: the audit and digest are those of a plain table over all of it."""
    monkeypatch.setattr(r, "SEGMENT", 100)
    rng = random.Random(8)
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "other"}
    rows = [(1, i, roles[rng.choice("suuaao")], rng.choice(["t.", "t", "", f"{i}.", f"{i}"])) for i in range(5000)]
    rows += [(c, i, "user", "t.") for c in range(2, 40) for i in range(3)]
    got = results(r.repair(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    for line in got:
        own = sorted(x[1:] for x in rows if x[0] == line[0])
        kinds, seen = "", set()
        for _, role, text in own:
            gone = not text or (role, text) in seen
            seen.add((role, text))
            letter = role[0] if role[0] in "sua" else "o"
            kinds += "X" if gone else letter if text.endswith(".") else letter.upper()
        pieces, cost, state = r.Tables(1).trace(kinds)
        pieces[-1] += r.finish(state)
        lines = []
        for (_, role, text), piece in zip(own, pieces):
            for letter in piece:
                new = {"u": "user", "a": "assistant"}.get(letter.lower(), role)
                lines += [f"{new}:{'' if letter in 'UA' else text}"] * (letter != "D")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert line[6:] == (cost + r.END[state], "".join(pieces).translate(str.maketrans("UAua", "IIRR")), digest)


def test_query_against_brute_force(spark):
    import pandas as pd

    from longloom.llm.catalog import QUERIES

    data = pd.read_parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = list(data[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = sorted((tuple(x[n] for n in names) for x in QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute_force(damage(rows), sorted({x[0] for x in rows}))


def test_damage(spark):
    from longloom.llm.catalog import damaged

    rows = [(c, t, "assistant", f"A? {t}!") for c in range(40) for t in range(8)] + [(None, None, None, None), (3, None, "user", None)]
    got = damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(damage(rows), key=str)
