import io
import zlib

import numpy as np
import pytest

from wardline.llm import pfor
from wardline.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("most", [0, 1, 300, 50_000, 2**32 - 1])
@pytest.mark.parametrize("percentile", [0.01, 0.9, 1.0])
def test_blocks_round_trip(most, percentile):
    ids = np.random.default_rng(most % 97).integers(0, most + 1, 128 * 40, dtype=np.uint64).astype(np.uint32)
    ids[5] = 2**32 - 1
    data, sizes = pfor.encode_blocks(ids, percentile)
    assert len(data) == sizes.sum()
    assert (pfor.decode_blocks(data, np.cumsum(sizes) - sizes) == ids).all()


def test_outliers_are_exceptions():
    ids = np.full(128, 7, np.uint32)
    ids[[3, 90]] = 1_000_000
    data, _ = pfor.encode_blocks(ids)
    assert (data[4], data[5]) == (0, 2) and len(data) == 6 + 2 * 5


@pytest.mark.parametrize("docs", [[], [(1, 0)], [(None, 5), (-3, 0), (4, 128), (9, 600_000), (9, 1)]])
def test_files_round_trip(docs):
    rng = np.random.default_rng(1)
    rows = [(k, rng.integers(0, 50_000, n).astype(np.uint32)) for k, n in docs]
    out = io.BytesIO()
    own = pfor.FileWriter(out)
    for k, ids in rows:
        own.add(k, ids)
    assert own.close() == sum(n for _, n in docs)
    got = list(pfor.read_file(out, len(out.getvalue())))
    assert [(k, len(ids)) for k, _, ids in got] == docs
    assert all((a[2] == b[1]).all() for a, b in zip(got, rows, strict=True))
    assert [before for _, before, _ in got] == [sum(n for _, n in docs[:k]) for k in range(len(docs))]


def test_tables(spark, table, odd_rows):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(PATH)
    reference.encode_special_tokens = True
    folder = Scratch(spark, "test-ids").path("files")
    files = pfor.write(table(odd_rows), folder, PATH)
    got = pfor.read(spark, folder, files).collect()
    ids = lambda text: np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=repr) == sorted(((k, ids(t)) for k, t in odd_rows), key=repr)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == [None, *sorted(k for k, _ in odd_rows if k is not None)]
    assert {zlib.crc32(r.ids) for r in got}
    empty = Scratch(spark, "test-ids").path("files")
    none = pfor.write(table([]), empty, PATH)
    assert none.count() == 0 and pfor.read(spark, empty, none).collect() == []


def test_chunks_that_begin_with_a_zero_byte():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(PATH)
    reference.encode_special_tokens = True
    texts = ["\x00", "a \x00 b", "\x00a \x00a", "a \x00, b", " \x00 a", "\n \x00", "a\n\x00 a", "  a", "\na a"] * 2
    got = pfor.IdMemo(PATH).encode(texts)
    assert got == [np.array(reference.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
