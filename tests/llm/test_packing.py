import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from longloom.llm.packing import pack_documents, pack_lengths
from longloom.llm.tokens import WordIds, public_path

PATH = public_path("word_bpe_49k.json")
HARD = [None, "", "   ", "a", "A.B", "foo.. bar,. x", "a\x01b \x01 c", "I'll don't 's 's. 'S", "x <|endoftext|> y<|endoftext|>",
        "\n\n  a \n b\t\tc  ", "é. È, ñ", "café ́x", "a b c", "\x1ca\x1d b", "İstanbul ΣΑΣ. ΣΑΣ,",
        "３ 3.4, 5.", "a" * 3000, "日本語。テスト", ". , .", "a.\n\nb", " a", "a "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(name):
    words = WordIds(public_path(name))
    for _ in range(2):
        for text, ids in zip(HARD, words.encode(HARD), strict=True):
            expected = words.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == expected, text


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB.,' \n\t\x0bé7|́\x01", max_size=40))
def test_ids_of_any_text(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        words = test_ids_of_any_text.__dict__.setdefault(name, WordIds(public_path(name)))
        expected = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == expected


WIDE = "\x85\xa0\u1680\u2000\u2003\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_HARD = ["Hello.\n\u00a0\nWorld", "end.\n\n\u3000\u4e00", "a\x85\nb", "x \u2003y\u2003 z", "\u00a0", "a\n\n<|endoftext|>\n\nb",
             *[f"a{c}b {c} c\n{c}\n{c}{c}d. {c}{c}" for c in WIDE], *[f"\n{c}x" for c in "\x1c\x1f\u180e\u200b\ufeff"]]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_around_any_white_space(name):
    words = WordIds(public_path(name))
    for text, ids in zip(WIDE_HARD, words.encode(WIDE_HARD), strict=True):
        expected = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*"aB.,' \n\té7\u4e00", *WIDE, "<|endoftext|>"]), max_size=40).map("".join))
def test_ids_of_any_text_with_wide_spaces(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        words = test_ids_of_any_text.__dict__.setdefault(name, WordIds(public_path(name)))
        expected = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == expected


def one_by_one(lengths, size):
    """Best-fit decreasing, piece by piece, by a scan of all sequences: the rooms that are left, sorted."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(size - length)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120))
def test_runs_are_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    used = {}
    for r in pack_lengths(counts, 30):
        for i in range(r.pieces):
            used.setdefault(r.sequence + i // r.each, []).append((r.offset + i % r.each * r.length, r.length))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert sorted(30 - sum(n for _, n in s) for s in used.values()) == one_by_one(lengths, 30)


def test_pack_documents(spark):
    texts = ["one two three " * 40, None, "", "a b", "a b", "word " * 500, "x"] * 9
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, length string, task int").repartition(5)
    rows = pack_documents(docs, PATH, size=64).collect()
    words = WordIds(PATH)
    expected = []
    for ids in words.encode(texts):
        ids += np.array([1], "<u4").tobytes()
        expected += [zlib.crc32(ids[i:i + 256]) for i in range(0, len(ids), 256)]
    assert sorted(r["ids_crc32"] for r in rows) == sorted(expected)
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(n for _, n in spans) <= 64
    assert len(used) == len(one_by_one([r["length"] for r in rows], 64))


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    result = pack_documents(docs, PATH)
    assert result.count() == 0
    assert result.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
