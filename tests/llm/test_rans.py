import zlib

import numpy as np
import pytest

from longloom.llm import rans
from longloom.llm.tokens import WordIds, public_path
from longloom.session import shared_dir

PATH = public_path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 63, 64, 500, 5000, 200_000, rans.BLOCK_IDS])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 60_000).astype(np.uint32)
    table = rans.Table.unpack(rans.Table.of(ids).pack())
    block = rans.encode_block(ids, table)
    decoder = rans.Decoder(table)
    assert (decoder.decode(block) == ids).all()
    for k in range(len(block["places"])):
        assert (decoder.decode(block, k) == ids[k * rans.CHECKPOINT_STEPS * block["lanes"]:]).all()


def test_one_symbol_and_size():
    ids = np.full(100_000, 7, dtype=np.uint32)
    assert len(rans.encode_block(ids, rans.Table.of(ids))["words"]) == 0
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 256, 1 << 18).astype(np.uint32)
    assert len(rans.encode_block(ids, rans.Table.of(ids))["words"]) < 1.01 * (1 << 18)


def test_damage_is_noticed():
    ids = np.random.default_rng(2).integers(0, 900, 9000).astype(np.uint32)
    table = rans.Table.of(ids)
    block = rans.encode_block(ids, table)
    broken = block | {"words": block["words"][:-1] + bytes([block["words"][-1] ^ 1])}
    with pytest.raises(ValueError):
        rans.Decoder(table).decode(broken)
    with pytest.raises(ValueError):
        rans.Decoder(table).decode(block | {"ids_crc": block["ids_crc"] ^ 1})


def expected(rows):
    words, start, out = WordIds(PATH), 0, []
    for doc_id, text in rows:
        ids = [*words.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_file(spark, monkeypatch):
    texts = ["one two, three. ", None, "", "été à la plage\n\n", "x" * 900, "the end. " * 300, "  a\tb"]
    rows = [(i * 3 - 7, texts[i % len(texts)]) for i in range(90)]
    docs = spark.createDataFrame([(i, t, 1, "g") for i, t in reversed(rows)],
                                 "doc_id long, text string, part int, `group` string").repartition(6)
    path = shared_dir(spark)
    rans.write_token_file(docs, path, PATH)
    got = rans.read_token_digests(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows)
    ids = {r["doc_id"]: r["ids"] for r in rans.read_token_file(spark, path).collect()}
    words = WordIds(PATH)
    assert all(ids[i] == [*words.tokenizer.encode(t or "").ids, 2] for i, t in rows)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "b"), (5, "c"), (5, "c"), (None, None), (1, "a b c")], "doc_id long, text string")
    path = shared_dir(spark)
    rans.write_token_file(docs, path, PATH)
    got = rans.read_token_digests(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 5, 5]
    assert sum(r["n_tokens"] for r in got) == 2 + 1 + 4 + 2 + 2
    assert [r["start"] for r in got][1:] == np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()


def test_no_documents(spark):
    path = shared_dir(spark)
    rans.write_token_file(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert rans.read_token_digests(spark, path).count() == 0
