import random

import pytest

from wardline.llm import token_counts

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lengths():
    """Numbers of tokens that the libraries give for whole texts."""
    by_json = tokenizers.Tokenizer.from_file(JSON)
    by_model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return {
        JSON: lambda t: len(by_json.encode(t or "", add_special_tokens=False).ids),
        MODEL: lambda t: len(by_model.encode(t or "")),
    }


@pytest.mark.parametrize("path", [JSON, MODEL])
def test_random_texts(lengths, path):
    own, draw = token_counts.pieces_of(path), random.Random(3)
    signs = [*"ab cdeE'st \n\t  12 é漢😀.,!\x1c\xa0 ▁", "'ll", "<|endoftext|>", "<|endof", "</s>", " the", "͸"]
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(40)))
        pre_tokens, special = own.cut(text)
        assert special + sum(own.pieces(pre_tokens)) == lengths[path](text), text


def test_own_pattern_below_u0370():
    own = token_counts.JsonPieces(JSON)
    for c in map(chr, range(0x370)):
        text = f"a{c}1{c}.{c}\n{c} {c}{c}  '{c}"
        by_library = [text[a:b] for _, (a, b) in own.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        assert own.beyond(text) is None and own.find(text) == by_library, ascii(text)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.JsonPieces(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("path", [JSON, MODEL])
@pytest.mark.parametrize("head", [0, 3, token_counts.HEAD])
def test_tables(table, odd_rows, lengths, path, head, monkeypatch):
    """Whatever the workers are given ahead, all rows have the libraries' numbers."""
    monkeypatch.setattr(token_counts, "HEAD", head)
    rows = [*odd_rows, (12, "a <|endoftext|>b<|endoftext|>"), (13, "long " + "y" * 33 + " " + "y" * 33 + " \0abc")]
    got = sorted((tuple(r) for r in token_counts.count(table(rows), path, limit=5).collect()), key=repr)
    want = [(k, len((t or "").encode()), lengths[path](t), lengths[path](t) > 5) for k, t in rows]
    assert got == sorted(want, key=repr)
    assert token_counts.count(table([]), path).collect() == []


def test_query(spark, sf_dir, lengths):
    from wardline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op13_token_counts"](spark, sf_dir).collect())
    sizes = [(d, len((t or "").encode()), lengths[JSON](t)) for d, t in docs]
    assert got == sorted((d, b, n, n > 1024) for d, b, n in sizes)
