"""Byte-level BPE encoding and decoding by longest matches with backtracking.

A text is cut by the pre-tokenizer pattern; each piece is encoded on its own. Instead of merging pairs in
rank order, a piece is covered from left to right with the longest vocabulary entries, which an Aho-Corasick
automaton over the bytes (as Latin-1 characters) finds in one go. A token may follow another only if the two
are what the merges give for their joined bytes; this compatibility of neighbours is memoised. Where nothing
fits, the last token is replaced by its next shorter prefix token. The cover found is the one the merges give,
and each byte is left by each token at most once, so the time is linear in the piece.

Results: null and empty texts give no ids and decode to no bytes. Repeated rows give repeated results. A table
without rows gives none. Columns beside the key and the text play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm.common import alone, map_batches

#: Chunks that a worker remembers; beyond that it forgets all and starts anew, which changes no result.
MEMO_CHUNKS = 1_000_000

#: Where a text may be cut: a space or a line end with no other white space at either side. No match of the
#: pattern runs across such a place; the space belongs to what follows, the line end stands alone.
_ALONE = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")


def chunks(text: str) -> list[str]:
    """Parts of a text that can be encoded on their own: the first as it is, the others after a space unless they
    begin with a line end."""
    if " ".join(text.split()) == text.replace("\n", " "):
        return text.replace("\n", " \n").split(" ")
    return _ALONE.split(text)


class _Memo(dict):
    """Encoded chunks, forgotten all at once when they are too many."""

    def __init__(self, pack):
        self.pack = pack

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMO_CHUNKS:
            self.clear()
        self[chunk] = out = self.pack(chunk if chunk[:1] == "\n" else " " + chunk)
        return out


class Encoder:
    """Ids of pieces of text under a table of ranks (bytes of a token -> its id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.cut = regex.compile(pattern).findall
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size_of = {i: len(b) for b, i in ranks.items()}
        automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            automaton.add_word(token.decode("latin-1"), (len(token), i))
        automaton.make_automaton()
        self.automaton = automaton
        self.split_of = self._splits()
        self.prefix_of = self._prefixes()
        self.fits_memo: dict[tuple[int, int], bool] = {}
        self.chunk_memo = _Memo(self._packed)

    def _splits(self) -> dict[int, tuple[int, int]]:
        """The two tokens that each token is merged from; a token that no merge makes stands for itself."""
        ranks, out = self.ranks, {}
        for token, i in ranks.items():
            parts = [token[k:k + 1] for k in range(len(token))]
            while len(parts) > 2:
                best = min(
                    ((r, k) for k in range(len(parts) - 1) if (r := ranks.get(parts[k] + parts[k + 1], i)) < i),
                    default=None,
                )
                if best is None:
                    break
                k = best[1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            out[i] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (i, i)
        return out

    def _prefixes(self) -> dict[int, int]:
        """The longest token that is a proper prefix of each token, -1 for none."""
        out = {}
        for token, i in self.ranks.items():
            out[i] = -1
            for end in range(len(token) - 1, 0, -1):
                if (j := self.ranks.get(token[:end])) is not None:
                    out[i] = j
                    break
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens side by side: no merge across their seam comes before theirs."""
        key = (left, right)
        if (known := self.fits_memo.get(key)) is not None:
            return known
        if len(self.fits_memo) > 2_000_000:
            self.fits_memo.clear()
        self.fits_memo[key] = out = self._fits(left, right)
        return out

    def _fits(self, a: int, b: int) -> bool:
        ranks, bytes_of, split_of = self.ranks, self.bytes_of, self.split_of
        limit = float("inf")
        while True:
            joined = ranks.get(bytes_of[a] + bytes_of[b])
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit = a
                a = split_of[a][1]
                if a == limit:
                    limit = b + 1
                    b, whole = split_of[b][0], b
                    if b + 1 == limit or b == whole:
                        return True
            else:
                limit = b + 1
                b, whole = split_of[b][0], b
                if b == whole:
                    limit = a
                    a, whole = split_of[a][1], a
                    if a == whole:
                        return True

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if not data:
            return []
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        longest = [-1] * len(data)
        size = [0] * len(data)
        for end, (length, i) in self.automaton.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, i
        size_of, prefix_of, fits = self.size_of, self.prefix_of, self.fits
        open_ends = bytearray(b"\1") * (len(data) + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            last = ids[-1] if ids else -1
            while True:
                end = at + size_of[token]
                if open_ends[end] and (last < 0 or fits(last, token)):
                    ids.append(token)
                    at = end
                    token = longest[at] if at < len(data) else -1
                    break
                if (shorter := prefix_of[token]) >= 0:
                    token = shorter
                    continue
                open_ends[at] = 0
                if not ids:
                    raise ValueError("the ranks lack a single byte")
                token = ids.pop()
                at -= size_of[token]
                break
        return ids

    def _packed(self, chunk: str) -> bytes:
        ids = [i for piece in self.cut(chunk) for i in self.encode_bytes(piece.encode("utf-8", "surrogatepass"))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = chunks(text)
        return self._packed(first) + b"".join(map(self.chunk_memo.__getitem__, rest))

    def forget(self) -> None:
        self.chunk_memo.clear()
        self.fits_memo.clear()

    def decode(self, packed: bytes) -> bytes:
        """The bytes that ids stand for."""
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a ranks file, built once in each worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, decoded binary) per row: ids as little-endian unsigned 32-bit integers, and their bytes.

    `path` names a ranks file that every worker can open.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        alone(f"bpe {path}", own.forget)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            decoded = pa.array(map(own.decode, ids), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), decoded], [key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), work, f"`{key}` {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row; the ids and bytes themselves stay in the worker."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        alone(f"bpe {path}", own.forget)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in ids]),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), work, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
