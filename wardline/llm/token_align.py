"""Alignment of two tokenizers' tokens of the same texts, by merging both rows of token ends in lockstep.

A text's tokens under tokenizer A and under tokenizer B cover the same bytes. Each token is known by the byte offset
where it ends. One NumPy vector holds, for all lanes of a batch, the place of the next token of A, another that of B.
Every step compares the two ends in all lanes at once: the smaller end's pointer moves on; where both are equal, a
link between the two tokens and a cut behind them are put out and both pointers move. Lanes that are done are taken
out of the vectors. The tokens between two cuts are a group: the shortest stretches that both tokenizers cover
exactly. As every token has at least one byte, a group ends with exactly one link.

A lane is a document; a long one is dealt to several lanes, so that it does not keep a batch going alone. It is
parted before single spaces, where the byte-level pattern cuts and no piece of B runs across, and a part that no
token of both ends at goes on in one lane.

Links are counted by pair of ids over all texts, and each pair is set beside the highest count of its B id. The
`HEAD` most frequent pairs (a bounded number of three numbers each) are broadcast, all others are joined by pair, so
that no pair is a hot key. Each text is encoded once: its links are stored by pair.

Results: null and empty texts, and texts of which the tokens of one side do not give back all bytes (a space and the
text), have no tokens: zeros, and an empty digest. Repeated rows give repeated results and count each. Null keys
stay. A table without rows gives none. Columns beside the key and the text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, alone, map_batches, most_frequent, row_numbers, utf8
from wardline.llm.pfor import id_memo

#: Pairs of ids that every worker gets.
HEAD = 1 << 17
#: Tokens of A in a lane, about.
LANE = 512
#: Chunks of text that a worker remembers the ids of; beyond that it forgets all, which changes no result.
KNOWN = 500_000
#: Bytes of text that are merged in one go.
BATCH_BYTES = 4 << 20


def byte_level_signs() -> dict[str, int]:
    """The bytes that the signs of byte-level vocabularies stand for: printable ones stand for themselves, the others
    for the signs from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Side:
    """A tokenizer's ids of texts, and the bytes of each id."""

    bytes_of: np.ndarray
    size_of: np.ndarray

    def _keep(self, tokens: list[bytes]) -> None:
        self.bytes_of = np.empty(len(tokens), object)
        self.bytes_of[:] = tokens
        self.size_of = np.fromiter(map(len, tokens), np.int64, len(tokens))

    def encode(self, texts: list[str]) -> list[Sequence[int]]:
        """Ids of a space and each text."""
        raise NotImplementedError

    def forget(self) -> None:
        """Drop what is remembered of earlier texts."""


class ByteLevel(Side):
    """A byte-level file of the tokenizers library, which sees each chunk of text once."""

    def __init__(self, path: str):
        self.memo = id_memo(path)
        names, signs = self.memo.tokenizer.get_vocab(with_added_tokens=True), byte_level_signs()
        tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = bytes(signs[c] for c in name) if all(c in signs for c in name) else name.encode()
        self._keep(tokens)

    def encode(self, texts: list[str]) -> list[Sequence[int]]:
        if len(self.memo.memo) > KNOWN:
            self.forget()
        return [np.frombuffer(ids, "<u4") for ids in self.memo.encode([" " + t for t in texts])]

    def forget(self) -> None:
        self.memo.memo.clear()


class Pieces(Side):
    """A file of the sentencepiece library that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        own = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._keep([
            bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode()
            for i in range(own.get_piece_size())
        ])

    def encode(self, texts: list[str]) -> list[Sequence[int]]:
        return self.model.encode(texts, num_threads=1)


_OPEN: dict[str, Side] = {}


def side(path: str) -> Side:
    """The tokenizer of a file, opened once in each worker."""
    if path not in _OPEN:
        _OPEN[path] = Pieces(path) if path.endswith(".model") else ByteLevel(path)
    return _OPEN[path]


def merge(a_ends: np.ndarray, b_ends: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of A and of B that end together, in order.

    The ends are those of all lanes in a row, ascending. `lanes` has one row per lane: first token of A and of B, and the
    first tokens behind it; every lane has tokens of both sides, and its last two end together.
    """
    a, b, a_stop = lanes[:, 0].copy(), lanes[:, 1].copy(), lanes[:, 2].copy()
    a_out, b_out = [], []
    while len(a):
        a_end, b_end = a_ends[a], b_ends[b]
        linked = a_end == b_end
        a_out.append(a[linked])
        b_out.append(b[linked])
        a += a_end <= b_end
        b += b_end <= a_end
        done = a == a_stop
        if done.any():
            left = ~done
            a, b, a_stop = a[left], b[left], a_stop[left]
    if not a_out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.sort(np.concatenate(a_out)), np.sort(np.concatenate(b_out))


def _lanes(a_first: np.ndarray, b_first: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lanes of all documents; `a_first` and `b_first` are their first tokens, and the end. Documents are parted at about
    every `LANE`-th token of A that begins with a space (`starts`), where a token of B ends as well."""
    want = [np.arange(lo + LANE, hi, LANE) for lo, hi in zip(a_first[:-1], a_first[1:], strict=True) if hi - lo > LANE]
    at = np.concatenate(want) if want else np.empty(0, np.int64)
    if len(at):
        places = np.flatnonzero(starts)
        at = places[np.minimum(np.searchsorted(places, at), len(places) - 1)] if len(places) else at[:0]
        ends = a_ends[at - 1]
        found = np.searchsorted(b_ends, ends)
        met = (at > 0) & (found < len(b_ends)) & (b_ends[np.minimum(found, len(b_ends) - 1)] == ends)
        cuts = np.stack([at[met], found[met] + 1], axis=1)
    else:
        cuts = np.empty((0, 2), np.int64)
    edges = np.unique(np.concatenate([np.stack([a_first, b_first], axis=1), cuts]), axis=0)
    return np.concatenate([edges[:-1], edges[1:]], axis=1)


class Aligner:
    """Aligns many texts at once."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = side(a_path), side(b_path)
        self.starts = np.fromiter((t[:1] == b" " for t in self.a.bytes_of), bool, len(self.a.bytes_of))
        written = lambda s, n: [s + str(i) for i in range(n)]
        n_a, n_b = len(self.a.bytes_of), len(self.b.bytes_of)
        self.names = np.array([*written(";", n_a), *written(",", n_a), *written("|", n_b), *written(",", n_b)], object)

    def _both(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text on both sides; none where one side does not give back all bytes."""
        some = [k for k, t in enumerate(texts) if t]
        none = np.empty(0, np.int64)
        a_ids, b_ids = [none] * len(texts), [none] * len(texts)
        given = [texts[k] for k in some]
        for k, text, a, b in zip(some, given, self.a.encode(given), self.b.encode(given), strict=True):
            a, b, whole = np.array(a, np.int64), np.array(b, np.int64), b" " + utf8(text)
            if b"".join(self.a.bytes_of[a]) == whole and b"".join(self.b.bytes_of[b]) == whole:
                a_ids[k], b_ids[k] = a, b
        return a_ids, b_ids

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """(tokens of A, tokens of B, groups, groups written out, links as (id of A, id of B) rows) of each text."""
        a_ids, b_ids = self._both(texts)
        a_first = np.cumsum([0, *map(len, a_ids)])
        b_first = np.cumsum([0, *map(len, b_ids)])
        if not a_first[-1]:
            return [(0, 0, 0, "", np.empty((0, 2), np.int64)) for _ in texts]
        a, b = np.concatenate(a_ids), np.concatenate(b_ids)
        a_ends, b_ends = np.cumsum(self.a.size_of[a]), np.cumsum(self.b.size_of[b])
        a_cut, b_cut = merge(a_ends, b_ends, _lanes(a_first, b_first, a_ends, b_ends, self.starts[a]))
        links = np.stack([a[a_cut], b[b_cut]], axis=1)
        parts = np.searchsorted(a_cut, a_first)
        names = self._written(a, b, a_cut, b_cut)
        out = []
        for k in range(len(texts)):
            lo, hi = parts[k], parts[k + 1]
            written = "".join(names[a_first[k] + b_first[k]:a_first[k + 1] + b_first[k + 1]])[1:]
            out.append((len(a_ids[k]), len(b_ids[k]), int(hi - lo), written, links[lo:hi]))
        return out

    def _written(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> np.ndarray:
        """All ids as text with the sign before each, group by group: those of A, then those of B."""
        n_a, n_b = len(self.a.bytes_of), len(self.b.bytes_of)
        before = lambda cut: np.concatenate([[0], cut[:-1] + 1])
        group_a = np.searchsorted(a_cut, np.arange(len(a)))
        group_b = np.searchsorted(b_cut, np.arange(len(b)))
        code = np.empty(len(a) + len(b), np.int64)
        follows_a = np.ones(len(a), np.int64)
        follows_a[before(a_cut)] = 0
        follows_b = np.ones(len(b), np.int64)
        follows_b[before(b_cut)] = 0
        code[np.arange(len(a)) + before(b_cut)[group_a]] = a + follows_a * n_a
        code[np.arange(len(b)) + a_cut[group_b] + 1] = b + 2 * n_a + follows_b * n_b
        return self.names[code]


_LINKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_a, n_b, n_groups, groups_sha256, links) per row: links by pair, with their number. `row` is a number of
    its own for each row. Both paths name tokenizers' files that every worker can open."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, first = Aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        alone(f"align {a_path} {b_path}", lambda: (own.a.forget(), own.b.forget()))
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BATCH_BYTES:
                yield from _aligned(own, held, key, first, part)
                first += sum(b.num_rows for b in held)
                held, size = [], 0
        if held:
            yield from _aligned(own, held, key, first, part)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"row long, `{key}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string"
    return map_batches(docs.select(key, text), work, schema + ", links array<struct<a: int, b: int, n: int>>")


def _aligned(own: Aligner, held: list[pa.RecordBatch], key: str, first: int, part: int) -> Iterator[pa.RecordBatch]:
    keys = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
    found = own.align([t for b in held for t in b.column(1).to_pylist()])
    digests = [hashlib.sha256(f[3].encode()).hexdigest() if f[0] else "" for f in found]
    offsets, pairs, counts = [0], [], []
    for f in found:
        codes, n = np.unique(f[4][:, 0] << 32 | f[4][:, 1], return_counts=True)
        pairs.append(codes)
        counts.append(n)
        offsets.append(offsets[-1] + len(codes))
    codes, counts = np.concatenate(pairs), np.concatenate(counts)
    listed = pa.StructArray.from_arrays(
        [pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(counts.astype(np.int32))],
        fields=list(_LINKS.value_type),
    )
    number = lambda k: pa.array([f[k] for f in found], pa.int64())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(row_numbers(first, len(found), part)), keys, number(0), number(1), number(2), pa.array(digests, pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), listed),
        ],
        ["row", key, "n_a", "n_b", "n_groups", "groups_sha256", "links"],
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best) per pair of ids: its links in all texts, and whether no pair of its id of B has more."""
    counted = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def report(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row: n_best links are of a pair that is the
    most frequent of its id of B, count_sum adds up the counts of the pairs of all links."""
    scratch = Scratch(docs.sparkSession, "align")
    aligned = scratch.stage(align(docs, a_path, b_path, key, text), "aligned")
    pairs = scratch.stage(pair_counts(aligned), "pairs").select("a", "b", F.col("n").alias("count"), "best")
    head = F.broadcast(most_frequent(pairs, "count", HEAD))
    links = aligned.select("row", F.inline("links"))
    met = [links.join(head, ["a", "b"]), links.join(head, ["a", "b"], "left_anti").join(pairs, ["a", "b"])]
    sums = [F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    added = [part.groupBy("row").agg(*sums) for part in met]
    both = added[0].unionByName(added[1]).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return aligned.drop("links").join(both, "row", "left").select(
        key, "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"
    )
