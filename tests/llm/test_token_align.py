import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest

from wardline.llm import token_align

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def by_hand():
    """Rows of the query, token by token."""
    a_side = tokenizers.Tokenizer.from_file(A)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = list(range(0x21, 0x7F)) + list(range(0xA1, 0xAD)) + list(range(0xAE, 0x100))
    signs = {chr(b): b for b in letters}
    for b in range(256):
        if b not in letters:
            signs[chr(0x100 + len(signs) - len(letters))] = b

    def tokens(text):
        if not text:
            return [], []
        encoded = a_side.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(signs[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens)]
        b = []
        for i in b_side.encode(text):
            piece = b_side.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])

    def ends(side):
        out, at = {}, 0
        for i, t in side:
            at += len(t)
            out[at] = i
        return out

    def rows(docs):
        made = []
        for key, text in docs:
            a, b = tokens(text)
            a_ends, b_ends = ends(a), ends(b)
            shared = sorted(set(a_ends) & set(b_ends))
            groups = [([], []) for _ in shared]
            for k, side in enumerate((a_ends, b_ends)):
                for end in sorted(side):
                    groups[bisect_left(shared, end)][k].append(str(side[end]))
            groups = [f"{','.join(x)}|{','.join(y)}" for x, y in groups]
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
            made.append((key, len(a), len(b), len(groups), [(a_ends[e], b_ends[e]) for e in shared], digest))
        counts = Counter(pair for m in made for pair in m[4])
        best = {}
        for (_, b), n in counts.items():
            best[b] = max(n, best.get(b, 0))
        return sorted(
            [(k, n_a, n_b, g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), d)
             for k, n_a, n_b, g, links, d in made], key=repr)

    return rows


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("lane", [1, 7, token_align.LANE])
@pytest.mark.parametrize("head", [0, 40, token_align.HEAD])
def test_odd_tables(table, odd_rows, by_hand, lane, head, monkeypatch):
    """Whatever the lanes' lengths and the pairs given ahead: nulls, mark signs, control bytes, long words, repeats."""
    monkeypatch.setattr(token_align, "LANE", lane)
    monkeypatch.setattr(token_align, "HEAD", head)
    draw = random.Random(4)
    signs = [*"ab cdeE'st \n\t  12 é漢😀.,!\x1c\xa0\x00 ", "'ll", "<|endoftext|>", "</s>", "<0x41>", " the", " tokenizer"]
    docs = [*odd_rows[:8], (20, "a▁b"), (21, "x" * 3000), (None, None)]
    docs += [(100 + k, "".join(draw.choice(signs) for _ in range(draw.randrange(60)))) for k in range(150)]
    got = token_align.report(table(docs), A, B).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(docs)


def test_empty_table(table):
    assert token_align.report(table([]), A, B).collect() == []


def test_merge_of_random_rows():
    """Against the sets of ends, lane by lane."""
    draw = np.random.default_rng(2)
    for _ in range(200):
        a_ends, b_ends, lanes, at = [], [], [], 0
        for _ in range(draw.integers(1, 6)):
            size = int(draw.integers(1, 40))
            pick = lambda: sorted({size, *draw.integers(1, size + 1, draw.integers(0, 30)).tolist()})  # noqa: B023, E731
            a, b = pick(), pick()
            lanes.append((len(a_ends), len(b_ends), len(a_ends) + len(a), len(b_ends) + len(b)))
            a_ends += [at + e for e in a]
            b_ends += [at + e for e in b]
            at += size
        a, b = token_align.merge(np.array(a_ends), np.array(b_ends), np.array(lanes))
        assert [a_ends[i] for i in a] == [b_ends[i] for i in b] == sorted(set(a_ends) & set(b_ends))


def test_query(spark, sf_dir, by_hand):
    from wardline.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_token_align"](spark, sf_dir).select(*COLUMNS).collect()), key=repr) == by_hand(docs)
