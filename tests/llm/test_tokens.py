import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cohortspark.llm.tokens import encoder, pack, read_documents, read_ids, unpack, write

TEXTS = [None, "", " ", "a", " a", "a ", "a  b", "a \nb c", "x\n y", "x\n\n y.", "don't we'll. , ,, ..", "é,ü. ñ", "<|endoftext|> x", "12, 3.4 5.", "日本 語, 𝄞.",
         "a  b  c", "a\tb \tc", "\x1c x \x1cx", "foo\x85 bar", "Ġ xĠ Ġ", "a,b c,. d.,", "\x00 x", " ".join(f"word{i % 999}." for i in range(60000))]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2 ** width, 1001)
    packed = pack(ids, width)
    assert len(packed) == (1001 * width + 7) // 8
    assert np.array_equal(unpack(packed, 1001, width), ids) and np.array_equal(unpack(packed, 900, width, 77), ids[77:900])


def test_batches_equal_the_library(plain):
    got = encoder("byte_bpe_50k.json").batch(pa.array([t or "" for t in TEXTS]))
    assert [g.tolist() + [2] for g in got] == [plain(t) for t in TEXTS]


def test_files_hold_the_ids(spark, documents, tmp_path, plain):
    rows = [(i * 7 % 23, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id")]
    path = str(tmp_path / "ids")
    write(documents(rows), path, block=64)
    got = sorted(read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in got] == sorted(r["doc_id"] is not None for r in got)
    assert [r["doc_id"] or -1 for r in got] == sorted(r["doc_id"] or -1 for r in got)
    at, all_ids = 0, read_ids(spark, path, 0, 10 ** 9)
    left = sorted((i if i is not None else -9, plain(t)) for i, t in rows)
    for r in got:
        assert r["start"] == at
        ids = all_ids[at:at + r["n_tokens"]]
        left.remove((r["doc_id"] if r["doc_id"] is not None else -9, ids.tolist()))
        assert r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())
        at += r["n_tokens"]
    assert left == [] and at == len(all_ids)
    assert np.array_equal(read_ids(spark, path, 50, 333), all_ids[50:333])
    write(documents([]), str(tmp_path / "none"))
    assert read_documents(spark, str(tmp_path / "none")).collect() == []
