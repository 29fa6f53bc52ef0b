"""Numbers of tokens per document without making ids: each distinct pre-token is tokenized once.

A tokenizer never makes a token across the border of two pre-tokens, so a document's number of tokens is the sum
over its pre-tokens of the number of pieces each is cut into. The texts are read twice. First all tasks count
their pre-tokens, the counts are added up, and the tokenizer cuts each distinct pre-token into pieces: the
vocabulary table. Then each document's pre-token frequencies meet that table. The `HEAD` most frequent entries go
to the workers (at most 262 144 keys of at most 33 signs), so that no pre-token is a hot key; all others are joined
by pre-token, and the products of frequency and pieces are added up by document. Pre-tokens of more than 32 signs
stand in for themselves by a 128-bit digest, so that a long one that many documents share travels once.

What pre-tokens are depends on the file:

* `.json` (tokenizers): byte-level files without a normalizer. Special strings are cut out first, each one token,
  as the library does by default; what lies between is cut by the file's own pre-tokenizer. For texts with no sign
  from U+0370 on, its pattern is run here, which gives the same (tests compare all those signs).
* `.model` (sentencepiece): files that keep texts as they are but for a space put in front, and that have no
  piece with a space behind another sign. Pre-tokens are spaces and what follows them.

Other files are refused.

Results: null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results; null keys stay.
A table without rows gives none. Columns beside the key and the text play no part.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, alone, map_batches, most_frequent, row_numbers

#: Entries of the vocabulary that every worker gets.
HEAD = 1 << 18
#: Longer pre-tokens have a digest as their key.
LONG = 32
#: Distinct pre-tokens that a task holds before it hands their counts on.
HELD = 500_000

#: The byte-level pre-tokenizer's pattern (a fixed value of that file format).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class JsonPieces:
    """Pre-tokens and their numbers of pieces under a file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        cut, added = layout["pre_tokenizer"] or {}, layout["added_tokens"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if not plain or layout["normalizer"] is not None:
            raise ValueError("pre-tokens are only known for byte-level files without a normalizer or prefix space")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special strings that take in their neighbours are not supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.find = regex.compile(_BYTE_LEVEL).findall
        self.beyond = re.compile("[Ͱ-\U0010ffff]").search

    def cut(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and the number of its special strings."""
        if self.special is None or (first := self.special.search(text)) is None:
            return self._plain(text), 0
        parts = [text[:first.start()], *self.special.split(text[first.end():])]
        return [t for part in parts for t in self._plain(part)], len(parts) - 1

    def _plain(self, text: str) -> list[str]:
        if self.beyond(text) is None:
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pre_tokens, add_special_tokens=False)]


class ModelPieces:
    """Pre-tokens and their numbers of pieces under a file of the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if self.model.normalize("  a　 ﬁ ") != "▁▁▁a　▁ﬁ▁":
            raise ValueError("pre-tokens are only known for files that keep texts as they are behind one space")
        if any(re.search("[^▁]▁", name) for name in names):
            raise ValueError("a piece of this file crosses the border of two pre-tokens")
        self.find = re.compile("[ ▁]+[^ ▁]*").findall
        self.space = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def cut(self, text: str) -> tuple[list[str], int]:
        return (self.find(" " + text) if text else []), 0

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        # the file puts a space before a text, but not before an empty one
        found = self.model.encode([t[1:] for t in pre_tokens], num_threads=1)
        return [len(ids) if len(t) > 1 else self.space for t, ids in zip(pre_tokens, found, strict=True)]


_OPEN: dict[str, JsonPieces | ModelPieces] = {}


def pieces_of(path: str) -> JsonPieces | ModelPieces:
    """The tokenizer of a file, opened once in each worker."""
    if path not in _OPEN:
        _OPEN[path] = ModelPieces(path) if path.endswith(".model") else JsonPieces(path)
    return _OPEN[path]


def key_of(pre_token: str) -> str:
    """The pre-token itself, or a digest of a long one, which is longer than any pre-token that stands for itself."""
    if len(pre_token) <= LONG:
        return pre_token
    return "\0" + blake2b(pre_token.encode(), digest_size=16).hexdigest()


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pre_token, n, pieces) per distinct pre-token, or its key: occurrences in all texts, and its number of pieces."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = pieces_of(path), Counter()
        alone(f"pieces {path}", dict)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    held.update(own.cut(t)[0])
            if len(held) > HELD:
                yield from _tallied(held)
                held = Counter()
        yield from _tallied(held)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(path)
        for batch in batches:
            whole = pc.coalesce(batch.column(1), batch.column(0)).to_pylist()
            n = pa.array(own.pieces(whole), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["pre_token", "n", "pieces"])

    tallied = map_batches(docs.select(text), tally, "pre_token string, whole string, n long")
    added = tallied.groupBy("pre_token", "whole").agg(F.sum("n").alias("n"))
    return added.mapInArrow(measure, "pre_token string, n long, pieces int")


def _tallied(held: Counter) -> Iterator[pa.RecordBatch]:
    names, counts = list(held), list(held.values())
    for at in range(0, len(names), 10_000):
        part = names[at:at + 10_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(map(key_of, part), pa.string()), pa.array([t if len(t) > LONG else None for t in part], pa.string()),
                pa.array(counts[at:at + 10_000], pa.int64()),
            ],
            ["pre_token", "whole", "n"],
        )


def frequencies(docs: DataFrame, path: str, head: dict[str, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_bytes, n_known, rest) per row: n_known counts special strings and the pieces of pre-tokens in
    `head`; rest lists the other pre-tokens with their frequencies. `row` is a number of its own for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, first = pieces_of(path), TaskContext.get().partitionId(), 0
        alone(f"pieces {path}", dict)
        for batch in batches:
            known, rest = [], []
            for t in batch.column(1).to_pylist():
                pre_tokens, total = own.cut(t) if t else ([], 0)
                others = []
                for name, n in Counter(pre_tokens).items():
                    name = name if len(name) <= LONG else key_of(name)
                    if (pieces := head.get(name)) is None:
                        others.append((name, n))
                    else:
                        total += n * pieces
                known.append(total)
                rest.append(others)
            rows = row_numbers(first, batch.num_rows, part)
            first += batch.num_rows
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column(0), n_bytes, pa.array(known, pa.int64()), pa.array(rest, _REST)],
                ["row", key, "n_bytes", "n_known", "rest"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"row long, `{key}` {kind}, n_bytes long, n_known long, rest array<struct<pre_token: string, n: long>>"
    return map_batches(docs.select(key, text), work, schema)


_REST = pa.list_(pa.struct([("pre_token", pa.string()), ("n", pa.int64())]))


def count(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row; over_limit marks texts of more than `limit` tokens.

    `path` names a tokenizer's file that every worker can open.
    """
    scratch = Scratch(docs.sparkSession, "token-counts")
    known = scratch.stage(vocabulary(docs, path, text), "vocabulary")
    top = most_frequent(known, "n", HEAD).select("pre_token", "pieces").toArrow()
    head = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True))
    counted = scratch.stage(frequencies(docs, path, head, key, text), "frequencies")
    rest = counted.select("row", F.inline("rest")).join(known.select("pre_token", "pieces"), "pre_token")
    added = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_rest"))
    n_tokens = F.col("n_known") + F.coalesce("n_rest", F.lit(0))
    return counted.join(added, "row", "left").select(
        key, "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
