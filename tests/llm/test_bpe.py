import hashlib
import random
import struct

import pytest

from wardline.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_ids_are_those_of_the_merges(reference):
    own = bpe.encoder(PATH, PATTERN)
    draw = random.Random(5)
    for k in range(4000):
        letters = "ab cdeE'st \n\t  12 é漢😀.,!\x1c\xa0" if k % 2 else "aaaaabth e"
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(50)))
        assert own.encode(text) == packed(reference.encode_ordinary(text)), text
        assert own.decode(own.encode(text)) == text.encode()


def test_forgetting_changes_nothing(reference, monkeypatch):
    own = bpe.Encoder(bpe.read_ranks(PATH), PATTERN)
    monkeypatch.setattr(bpe, "MEMO_CHUNKS", 3)
    text = "some words, other words and some more words here\nand there"
    assert own.encode(text) == packed(reference.encode_ordinary(text))


def test_tables(table, odd_rows, reference):
    got = sorted((tuple(r) for r in bpe.digests(table(odd_rows), PATH, PATTERN).collect()), key=repr)
    want = []
    for key, text in odd_rows:
        ids = reference.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode(table([]), PATH, PATTERN).collect() == []
    full = {(r.doc_id, bytes(r.ids)) for r in bpe.encode(table(odd_rows), PATH, PATTERN).collect()}
    assert (4, packed(reference.encode_ordinary("One two THREE four."))) in full
