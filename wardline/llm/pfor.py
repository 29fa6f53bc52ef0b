"""Token ids in binary files of patched frame-of-reference blocks.

A block holds 128 ids. Its smallest id is the reference; the rest is packed at the width, in bits, that a
percentile of the block's differences needs (90 % unless asked otherwise). Differences that need more are
exceptions: the block keeps their positions and the bits above the width in lists of their own.

File: `PFB1`, the blocks, then the starts of the blocks (unsigned 64-bit, relative to the file), for each
document whether its key is set (a byte), its key (signed 64-bit) and its number of ids (unsigned 64-bit), and
last the numbers of blocks, documents and ids (unsigned 64-bit each) and `PFB1` again. All is little-endian.
Block: reference (4 bytes), width (1), number of exceptions (1), 16 bytes of packed bits per bit of width,
exception positions (1 byte each), exception bits (4 bytes each). The last block of a file is filled up with
its last id.

One task writes one file, in key order over all files, to a name that only depends on its partition, by way of
a temporary name: a task that runs again replaces the file by an equal one. Writers and readers hold a few
thousand blocks and one document at a time.

Results: null and empty texts have only the end id. Rows with equal keys stay apart, in the order of their
texts' hashes; null keys come first. No rows give no files and no rows. Other columns play no part.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.bpe import chunks
from wardline.llm.common import alone, local_fs, map_batches, small_batches

MAGIC = b"PFB1"
BLOCK = 128
CHUNK_BLOCKS = 4096
MEMO_CHUNKS = 2_000_000


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) unsigned 64-bit values below 2**width as (blocks, 16 * width) bytes."""
    if width == 0:
        return np.empty((len(values), 0), np.uint8)
    columns = np.ascontiguousarray(values.T)
    words = np.zeros((2 * width, len(values)), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        words[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8)


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The values of `pack`, as (blocks, 128)."""
    if width == 0:
        return np.zeros((len(packed), BLOCK), np.uint64)
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view(np.uint64).T)
    columns = np.empty((BLOCK, len(packed)), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        column = words[word] >> np.uint64(shift)
        if shift + width > 64:
            column |= words[word + 1] << np.uint64(64 - shift)
        columns[i] = column & mask
    return columns.T


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[bytes, np.ndarray]:
    """The bytes of whole blocks (a multiple of 128 unsigned 32-bit ids), and the size of each block."""
    table = ids.reshape(-1, BLOCK).astype(np.uint64)
    least = table.min(axis=1)
    rest = table - least[:, None]
    chosen = max(0, min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1))
    top = np.partition(rest, chosen, axis=1)[:, chosen]
    widths = np.frexp(top.astype(np.float64))[1].astype(np.int64)  # the bit length; 0 for 0
    high = rest >> widths.astype(np.uint64)[:, None]
    rows, at = np.nonzero(high)
    counts = np.bincount(rows, minlength=len(table))
    sizes = 6 + 16 * widths + 5 * counts
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros((len(table), 6), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = widths, counts
    out[starts[:, None] + np.arange(6)] = head
    for width in np.unique(widths):
        own = np.nonzero(widths == width)[0]
        mask = np.uint64((1 << int(width)) - 1)
        out[starts[own, None] + 6 + np.arange(16 * width)] = pack(rest[own] & mask, int(width))
    if len(rows):
        rank = np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
        lists = starts[rows] + 6 + 16 * widths[rows]
        out[lists + rank] = at
        bits = high[rows, at].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(lists + counts[rows] + 4 * rank)[:, None] + np.arange(4)] = bits
    return out.tobytes(), sizes


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at `starts` in `data`."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(6)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").ravel().astype(np.uint64)
    widths, counts = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.empty((len(starts), BLOCK), np.uint64)
    for width in np.unique(widths):
        own = np.nonzero(widths == width)[0]
        out[own] = unpack(raw[starts[own, None] + 6 + np.arange(16 * width)], int(width))
    if counts.any():
        rows = np.repeat(np.arange(len(starts)), counts)
        rank = np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
        lists = starts[rows] + 6 + 16 * widths[rows]
        at = raw[lists + rank]
        bits = np.ascontiguousarray(raw[(lists + counts[rows] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        out[rows, at] |= bits.astype(np.uint64) << widths[rows].astype(np.uint64)
    return (out + least[:, None]).astype("<u4").ravel()


class FileWriter:
    """Adds documents to one file, a few thousand blocks at a time."""

    def __init__(self, stream, percentile: float = 0.9):
        self.stream, self.percentile = stream, percentile
        self.stream.write(MAGIC)
        self.end = len(MAGIC)
        self.starts: list[np.ndarray] = []
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK * CHUNK_BLOCKS:
            self._flush(self.n_waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        for at in range(0, n, BLOCK * CHUNK_BLOCKS):
            data, sizes = encode_blocks(ids[at:min(n, at + BLOCK * CHUNK_BLOCKS)], self.percentile)
            self.starts.append((self.end + np.cumsum(sizes) - sizes).astype("<u8"))
            self.stream.write(data)
            self.end += len(data)
        self.waiting = [ids[n:]]
        self.n_waiting = len(ids) - n

    def close(self) -> int:
        """Write what is left and the index; the number of ids in the file."""
        if self.n_waiting:
            fill = -self.n_waiting % BLOCK
            self.waiting.append(np.full(fill, np.concatenate(self.waiting)[-1], np.uint32))
            self.n_waiting += fill
            self._flush(self.n_waiting)
        total, n_blocks = sum(self.sizes), sum(map(len, self.starts))
        for part in self.starts:
            self.stream.write(part.tobytes())
        self.stream.write(np.array([k is not None for k in self.keys], np.uint8).tobytes())
        self.stream.write(np.array([k or 0 for k in self.keys], "<i8").tobytes())
        self.stream.write(np.array(self.sizes, "<u8").tobytes())
        self.stream.write(struct.pack("<QQQ", n_blocks, len(self.keys), total) + MAGIC)
        return total


def read_file(source, size: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(key, ids before it in the file, ids) of each document of a file."""

    def part(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    tail = part(size - 28, 28)
    if tail[24:] != MAGIC or part(0, 4) != MAGIC:
        raise ValueError("not a file of token ids")
    n_blocks, n_docs, _ = struct.unpack("<QQQ", tail[:24])
    index = size - 28 - 17 * n_docs - 8 * n_blocks
    starts = np.frombuffer(part(index, 8 * n_blocks), "<u8").astype(np.int64)
    meta = part(index + 8 * n_blocks, 17 * n_docs)
    known = np.frombuffer(meta, np.uint8, n_docs)
    keys = np.frombuffer(meta, "<i8", n_docs, n_docs).tolist()
    sizes = np.frombuffer(meta, "<u8", n_docs, 9 * n_docs).tolist()
    held, block, before = np.empty(0, np.uint32), 0, 0
    at = 0  # of the next document in `held`
    for known_key, key, n in zip(known, keys, sizes, strict=True):
        if len(held) - at < n:
            parts = [held[at:]]
            have = len(held) - at
            while have < n:
                last = min(block + CHUNK_BLOCKS, n_blocks)
                end = int(starts[last]) if last < n_blocks else index
                parts.append(decode_blocks(part(int(starts[block]), end - int(starts[block])), starts[block:last] - starts[block]))
                have += len(parts[-1])
                block = last
            held, at = np.concatenate(parts), 0
        yield (key if known_key else None), before, held[at:at + n]
        at += n
        before += n


class _Known(dict):
    """Ids of chunks; takes note of those that are asked for and not there."""

    def __init__(self):
        self.missing: set[str] = set()

    def __missing__(self, chunk: str) -> None:
        self.missing.add(chunk)


class IdMemo:
    """Ids of whole texts from a tokenizer of the tokenizers library, which sees each chunk of text once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.sign = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in ",."}
        self.memo = _Known()

    def _learn(self, missing: set[str]) -> None:
        """Look chunks up with the tokenizer: many at once as one text, as no token crosses their borders. A comma or
        full stop behind a letter is a token of its own, so such chunks only need their stems looked up."""
        stems = {c: c[:-1] for c in missing if len(c) > 2 and c[-1] in ",." and c[-2].isalpha()}
        need = {stem for c in missing if (stem := stems.get(c, c)) not in self.memo}
        plain = [c for c in need if not c[-1].isspace() and (c[0] == "\n" or not c[0].isspace())]
        for at in range(0, len(plain), 10_000):
            self._look_up_joined(plain[at:at + 10_000])
        odd = list(need.difference(plain))
        as_text = [c[1:] if c[0] == " " else c if c[0] == "\n" else " " + c for c in odd]
        for c, encoded in zip(odd, self.tokenizer.encode_batch(as_text, add_special_tokens=False), strict=True):
            self.memo[c] = np.array(encoded.ids, "<u4").tobytes()
        for c, stem in stems.items():
            self.memo[c] = self.memo[stem] + self.sign[c[-1]]

    def _look_up_joined(self, plain: list[str]) -> None:
        as_text = [c if c[0] == "\n" else " " + c for c in plain]
        encoded = self.tokenizer.encode("".join(as_text), add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4").tobytes()
        begin = np.array([a for a, _ in encoded.offsets], np.int64)
        cuts = (4 * np.searchsorted(begin, np.cumsum([0, *map(len, as_text)]))).tolist()
        for c, a, b in zip(plain, cuts[:-1], cuts[1:], strict=True):
            self.memo[c] = ids[a:b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [chunks(t) if t else [] for t in texts]
        for parts in cut:
            if parts:
                parts[0] = " " + parts[0]  # the first chunk has no space before it; no other begins with one
        memo = self.memo
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        out: list[bytes | None] = []
        for parts in cut:
            found = list(map(memo.__getitem__, parts))
            out.append(None if None in found else b"".join(found))
        if memo.missing:
            missing, memo.missing = memo.missing, set()
            self._learn(missing)
            out = [b"".join(map(memo.__getitem__, parts)) if ids is None else ids for parts, ids in zip(cut, out, strict=True)]
        return out


_MEMOS: dict[str, IdMemo] = {}


def id_memo(path: str) -> IdMemo:
    if path not in _MEMOS:
        _MEMOS[path] = IdMemo(path)
    return _MEMOS[path]


def encode(docs: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary) per row: the tokenizer's ids of the whole text and the end id, 4 bytes each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = id_memo(path)
        alone(f"ids {path}", memo.memo.clear)
        end = struct.pack("<I", end_id)
        for batch in batches:
            ids = [i + end for i in memo.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    return map_batches(docs.select(F.col(key).cast("long").alias(key), text), work, f"`{key}` long, ids binary")


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, percentile: float = 0.9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode the texts and write them in key order; (part, file, n_docs, n_ids, start) per file, start being the
    number of ids in the files before it. There are as many files as tasks."""
    spark = docs.sparkSession
    small_batches(spark)
    ordered = (
        docs.select(F.col(key).cast("long").alias(key), text)
        .repartitionByRange(F.col(key).asc_nulls_first(), F.xxhash64(text))
        .sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64(text))
    )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, memo, end = TaskContext.get().partitionId(), id_memo(path), struct.pack("<I", end_id)
        alone(f"ids {path}", memo.memo.clear)
        store, at = local_fs(folder)
        store.create_dir(at, recursive=True)
        name, kept = f"part-{part:06d}.pfb", f"{at}/.{part:06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(kept) as stream:
            out = FileWriter(stream, percentile)
            for batch in batches:
                for k, ids in zip(batch.column(0).to_pylist(), memo.encode(batch.column(1).to_pylist()), strict=True):
                    out.add(k, np.frombuffer(ids + end, "<u4"))
            total = out.close()
        if not out.keys:
            store.delete_file(kept)
            return
        store.move(kept, f"{at}/{name}")
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [len(out.keys)], "n_ids": [total]}
        )

    written = ordered.mapInArrow(save, "part int, file string, n_docs long, n_ids long")
    files = sorted(written.collect(), key=lambda r: r.part)  # a row per file
    rows, start = [], 0
    for r in files:
        rows.append((r.part, r.file, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return spark.createDataFrame(rows, "part int, file string, n_docs long, n_ids long, start long")


def read(spark: SparkSession, folder: str, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids binary) per document; start is the number of ids of all documents before it."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = local_fs(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = store.get_file_info(f"{at}/{name}").size
                with store.open_input_file(f"{at}/{name}") as source:
                    rows, held = [], 0
                    for k, before, ids in read_file(source, size):
                        rows.append((k, base + before, len(ids), ids.tobytes()))
                        held += len(ids)
                        if held >= 1 << 20:
                            yield _as_batch(rows, key)
                            rows, held = [], 0
                    if rows:
                        yield _as_batch(rows, key)

    n = max(1, files.count())
    spread = files.select("part", "file", "start").repartitionByRange(n, "part").select("file", "start")
    return spread.mapInArrow(load, f"`{key}` long, start long, n_tokens long, ids binary")


def _as_batch(rows: list[tuple], key: str) -> pa.RecordBatch:
    k, start, n, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(k, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
        [key, "start", "n_tokens", "ids"],
    )
