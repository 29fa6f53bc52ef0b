"""Scan with a user's own table of patterns (needle, signal, severity, corpus_refs), of any size.

The table is never gathered. It is turned into two bit tables: one of fixed size
holds the hashes of the needles' first ``GRAM`` characters, the other, which grows with
the number of needles up to a bound, those of whole needles. Texts are searched many at
a time: where a gram is in the first table, the stretches from there that have the
length of a needle are looked up in the second, and those that are found there are
handed on as they stand, with the snippet around the first of each. Lengths up to twice
the least of them are a class, and are only looked up where the second table has a
beginning of that least length, so many lengths cost little more than one. A join of the
stretches with the needles themselves then says which are true, so full bit tables
cost time and no result. Only found stretches are shuffled, never texts.

That join moves a snippet for each find. Where most texts hold many needles (``dense``),
the texts are read twice instead: the first time only the distinct stretches of each task
are shuffled, to learn which are no needles. A third bit table holds those, and the few
needles that it holds too are listed, so the second time each find is settled where it is.

Hashes of stretches come from prefix sums over their bytes, so each costs the same at any
length. Places and lengths are those of characters. Needles shorter than ``GRAM`` are looked up at every place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from wardline.functions import text as T
from wardline.functions.findings import finding, finding_columns
from wardline.functions.literals import short_batches
from wardline.functions.text import ascii_lower
from wardline.operators.scan import NEEDLES
from wardline.rules import words as W
from wardline.sources.staging import stage

#: Characters at the start of a needle that are looked up first.
GRAM = 6
#: Bits of the table of grams, and the least of that of whole needles, as a power of two (8 MB).
BITS = 26
#: Bits that the table of whole needles has for each needle, if it need not be larger than MOST_BITS (128 MB).
BITS_A_NEEDLE, MOST_BITS = 16, 30
#: Bits of a table that are filled together and come to the driver as one row, as a power of two (64 KB). All bits of a
#: needle are in one such piece.
PIECE = 19
#: Characters of texts that are hashed in one go.
BLOCK = 1 << 16
#: Needles that a task numbers before it sorts them by piece.
RUN = 1 << 16
#: Most needles, and bytes of them, that are listed because the table of stretches that are no needles holds them too.
MOST_DOUBTFUL, MOST_DOUBTFUL_BYTES = 1 << 18, 1 << 25

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Multipliers that make bit numbers of a hash: one for the piece and two for the bits in it, for needles and for the others.
_FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25)
#: Bits of a needle, three of each multiplier.
_PROBES = 6


def _hashing():
    """Functions (powers, gram_bit, piece, bit) that patterns and texts are hashed with; they travel to the workers by value."""
    factors, most = _FACTORS, PIECE

    def powers(base: int, n: int) -> np.ndarray:
        """base ** 0 .. base ** (n - 1), modulo 2**64."""
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    def product(hashes: np.ndarray, factor: int) -> np.ndarray:
        return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(factors[factor])

    def gram_bit(hashes: np.ndarray, size: int) -> np.ndarray:
        return product(hashes, 0) >> np.uint64(64 - size)

    def piece(hashes: np.ndarray, size: int, kind: int) -> np.ndarray:
        """The piece that a table of 2**size bits has all bits of a hash in."""
        rest = size - min(most, size)
        return product(hashes, 3 * kind) >> np.uint64(64 - rest) if rest else np.zeros(len(hashes), np.uint64)

    def bit(hashes: np.ndarray, probe: int, size: int, kind: int) -> np.ndarray:
        """A bit of a hash in its piece."""
        return (product(hashes, 3 * kind + 1 + probe // 3) << np.uint64(21 * (probe % 3))) >> np.uint64(64 - min(most, size))

    return powers, gram_bit, piece, bit


def _classes(lengths: Iterable[int]) -> list[list[int]]:
    """Lengths of needles that have a gram, in classes: each up to twice its first."""
    out: list[list[int]] = []
    for n in sorted(n for n in lengths if n >= GRAM):
        if out and n < 2 * out[-1][0]:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def _hashes(lengths: Iterable[int]):
    """A function of folded needles that gives the hashes of wholes, of the beginnings their classes are looked up by (of
    longer needles) and of grams (of those that have one)."""
    powers, base, size = _hashing()[0], _BASE, GRAM
    least = np.array([c[0] for c in _classes(lengths)] or [size], np.int64)

    def hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        needles = column.to_pylist()
        raws = [needle.encode() for needle in needles]
        octets = np.array([len(raw) for raw in raws], np.int64)
        raw = np.frombuffer(b"".join(raws), np.uint8)
        terms = raw.astype(np.uint64) + np.uint64(1)
        terms *= powers(base, int(octets.max(initial=0)))[np.arange(len(terms)) - np.repeat(np.cumsum(octets) - octets, octets)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        sums = sums[np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))]  # before each character
        lengths = np.array([len(needle) for needle in needles], np.int64)
        starts = np.cumsum(lengths) - lengths
        begin = least[np.searchsorted(least, lengths, "right") - 1]
        more, long = starts[lengths > np.maximum(begin, size - 1)], starts[lengths >= size]
        begin = begin[lengths > np.maximum(begin, size - 1)]
        return sums[starts + lengths] - sums[starts], sums[more + begin] - sums[more], sums[long + size] - sums[long]

    return hashes


def _bit_tables(needles: DataFrame, sizes: dict[int, int] | None = None, kind: int = 0) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The tables (bytes) of grams and of whole needles, and the lengths of needles. Tables come to the driver in pieces
    that the workers fill."""
    sizes = dict(needles.groupBy(F.char_length("_needle")).count().collect()) if sizes is None else sizes
    lengths, wanted = sorted(sizes), (BITS_A_NEEDLE * sum(sizes.values())).bit_length()
    gram_bits, whole_bits = BITS, max(BITS, min(MOST_BITS, wanted))
    most, run, probes, hashes = PIECE, RUN, range(_PROBES), _hashes(lengths)
    _, gram_bit, piece, bit = _hashing()
    gram_piece = min(most, gram_bits)

    def packed(whole: bool, pieces: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        """A row for each piece, with its values behind one another."""
        order = np.argsort(pieces, kind="stable")
        pieces, values = pieces[order].astype(np.int64), np.ascontiguousarray(values[order])
        first = np.flatnonzero(np.diff(pieces, prepend=-1))
        ends = (np.append(first, len(values)) * values.itemsize).astype(np.int32)
        raw = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(values)])
        return pa.record_batch([pa.array(np.full(len(first), whole)), pa.array(pieces[first]), raw], ["whole", "piece", "values"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list):
            wholes, openings, grams = (np.unique(np.concatenate(part)) for part in zip(*held))
            wholes = np.concatenate((wholes, openings))
            yield packed(True, piece(wholes, whole_bits, kind), wholes)
            bits = np.unique(gram_bit(grams, gram_bits))  # once, so that a gram of most needles is not one task's
            yield packed(False, bits >> np.uint64(gram_piece), (bits & np.uint64((1 << gram_piece) - 1)).astype(np.uint32))

        held, count = [], 0
        for batch in batches:
            held.append(hashes(batch.column(0)))
            count += batch.num_rows
            if count >= run:
                yield from rows(held)
                held, count = [], 0
        if held:
            yield from rows(held)

    def fill(group: pa.Table) -> pa.Table:
        whole, values = group.column("whole")[0].as_py(), b"".join(group.column("values").to_pylist())
        size = whole_bits if whole else gram_bits
        out = np.zeros(1 << max(3, min(most, size)), bool)
        if whole:
            values = np.frombuffer(values, np.uint64)
            for k in probes:
                out[bit(values, k, size, kind)] = True
        else:
            out[np.frombuffer(values, np.uint32)] = True
        bits = pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())
        return pa.table({"whole": [whole], "piece": [group.column("piece")[0].as_py()], "bits": bits})

    packs = needles.select("_needle").mapInArrow(number, "whole boolean, piece long, values binary")
    pieces = packs.groupBy("whole", "piece").applyInArrow(fill, "whole boolean, piece long, bits binary").toArrow()
    tables = {whole: np.zeros(1 << max(0, size - 3), np.uint8) for whole, size in ((False, gram_bits), (True, whole_bits))}
    for whole, place, part in zip(*(pieces.column(c) for c in ("whole", "piece", "bits")), strict=True):
        raw = np.frombuffer(part.as_buffer(), np.uint8)
        tables[whole.as_py()][place.as_py() * len(raw):][:len(raw)] = raw
    return tables[False], tables[True], lengths


def _stretches(grams: np.ndarray, wholes: np.ndarray, lengths: list[int]):
    """A function of a text's folded bytes that gives the first place of each stretch that may be a needle."""
    search = _search(lambda: (grams, wholes), lengths)

    def stretches(folded: bytes) -> dict[bytes, int]:
        found: dict[bytes, int] = {}
        starts = np.append(np.flatnonzero(np.frombuffer(folded, np.uint8) & 0xC0 != 0x80), len(folded))
        for at, _, size, _ in search(folded, starts, np.array([len(starts) - 1])):
            for place in at.tolist():
                found.setdefault(folded[starts[place]:starts[place + size]], place)
        return found

    return stretches


def _inside():
    """A function that tells which hashes a table of wholes has, in order."""
    _, _, piece, bit = _hashing()
    probes = range(_PROBES)

    def inside(table: np.ndarray, hashes: np.ndarray, kind: int) -> np.ndarray:
        """Numbers of the hashes that the table has."""
        size = len(table).bit_length() + 2
        kept, pieces = np.arange(len(hashes)), piece(hashes, size, kind) * np.uint64(min(len(table), 1 << 16))
        for k in probes:
            if len(kept):
                bits = bit(hashes, k, size, kind)
                byte = table[(pieces + (bits >> np.uint64(3))).view(np.int64)]
                keep = (byte >> (bits & np.uint64(7)).astype(np.uint8)) & 1 != 0
                kept, hashes, pieces = kept[keep], hashes[keep], pieces[keep]
        return kept

    return inside


def _search(tables: Callable[[], tuple[np.ndarray, np.ndarray]], lengths: list[int], others: Callable[[], np.ndarray] | None = None):
    """A function of folded texts (their bytes behind one another, the start of each character and the end, and the character where
    each text ends) that gives stretches that may be needles: (places, texts, length, whether the table of others has them).
    Places of one length ascend. The tables are only asked for on the worker."""
    powers, gram_bit, _, _ = _hashing()
    inside, gram, base, inverse = _inside(), GRAM, _BASE, _INVERSE
    short, long = [n for n in lengths if n < gram], _classes(lengths)
    longest = lengths[-1] if lengths else 0
    block = max(BLOCK, 2 * longest)
    held = {"powers": np.zeros(0, np.uint64), "inverses": np.zeros(0, np.uint64)}

    def look(raw: np.ndarray, characters: np.ndarray, starts: int):
        """(places, length, whether others has them) of stretches that begin at one of the first ``starts`` characters."""
        grams, wholes = tables()
        if len(held["powers"]) < len(raw):
            held["powers"], held["inverses"] = powers(base, 2 * len(raw)), powers(inverse, 2 * len(raw))
        n = len(characters) - 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * held["powers"][:len(raw)], dtype=np.uint64, out=sums[1:])
        inverses = held["inverses"][:len(raw)]
        if n < len(raw):
            sums, inverses = sums[characters], inverses[characters[:-1]]

        def met(at: np.ndarray, size: int):
            at = at[:np.searchsorted(at, n - size, "right")]
            hashes = (sums[at + size] - sums[at]) * inverses[at]
            kept = inside(wholes, hashes, 0)
            return at[kept], hashes[kept]

        def told(at: np.ndarray, hashes: np.ndarray, size: int):
            doubtful = np.zeros(len(at), bool)
            if others is not None:
                doubtful[inside(others(), hashes, 1)] = True
            return at, size, doubtful

        every = np.arange(starts)
        near = every[:max(0, n - gram + 1)]
        if long:
            bits = gram_bit((sums[gram:][:len(near)] - sums[:len(near)]) * inverses[:len(near)], len(grams).bit_length() + 2)
            near = near[(grams[(bits >> np.uint64(3)).view(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 != 0]
        for size in short:
            yield told(*met(every, size), size)
        for sizes in long:
            some = met(near, sizes[0])[0] if len(sizes) > 1 else near
            for size in sizes if len(some) else ():
                yield told(*met(some, size), size)

    def search(folded: bytes, starts: np.ndarray, ends: np.ndarray):
        raw = np.frombuffer(folded, np.uint8)
        for first in range(0, len(starts) - 1, block):
            part = starts[first:first + block + longest + 1]
            for at, size, doubtful in look(raw[part[0]:part[-1]], part - part[0], min(block, len(part) - 1)):
                at = at + first
                text = np.searchsorted(ends, at, "right")
                fits = at + size <= ends[text]
                yield at[fits], text[fits], size, doubtful[fits]

    return search


def _spans():
    """A function that cuts a batch's column of texts into whole texts that fill a block, or one longer text: (first row, bytes, the
    start of each character and the end, the character where each text ends)."""
    most = BLOCK

    def spans(column: pa.Array):
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:][:len(column) + 1]
        row = 0
        while row < len(column):
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
            if offsets[last] > offsets[row]:
                data = column.buffers()[2][int(offsets[row]):int(offsets[last])].to_pybytes()
                starts = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))
                yield row, data, starts, np.searchsorted(starts, offsets[row + 1:last + 1] - offsets[row])
            row = last

    return spans


def _distinct_stretches(sent: Broadcast, lengths: list[int]):
    """Arrow function: the stretches of texts that may be needles, those of a batch once."""
    search, spans = _search(lambda: sent.value, lengths), _spans()

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[bytes] = set()
            for _, data, starts, ends in spans(batch.column(0)):
                folded = data.lower()  # bytes.lower folds A-Z only
                for at, _, size, _ in search(folded, starts, ends):
                    found.update([folded[a:b] for a, b in zip(starts[at].tolist(), starts[at + size].tolist())])
            if found:
                yield pa.record_batch([pa.array(list(found), pa.string())], ["needle"])

    return stretches


def _finds(sent: Broadcast, lengths: list[int], others: Broadcast | None = None):
    """Arrow function of (key, name, text): (key, name, needle, matched) of the stretches of a text that may be needles, each with
    its first snippet. With ``others`` (the table of stretches that are none, and the needles that it has too) they are needles."""
    search = _search(lambda: sent.value, lengths, others and (lambda: others.value[0]))
    spans, context, ellipsis = _spans(), W.SNIPPET_CONTEXT, T.ELLIPSIS.encode()

    def in_texts(data: bytes, starts: np.ndarray, ends: np.ndarray):
        """(texts, needles, snippets)."""
        folded, begins = data.lower(), np.append(0, ends[:-1])  # bytes.lower folds A-Z only
        known, seen = others and others.value[1], set()
        for at, text, size, doubtful in search(folded, starts, ends):
            good = ~doubtful
            for i in np.flatnonzero(doubtful).tolist():
                good[i] = folded[starts[at[i]]:starts[at[i] + size]] in known
            at, text = at[good][::-1], text[good][::-1]
            places = zip(text.tolist(), starts[at].tolist(), starts[at + size].tolist())
            # the last of equal keys counts, which is the first in the text
            first_of = {(t, folded[a:b]): i for i, (t, a, b) in enumerate(places)}
            if len(ends) == 1:  # this may go on for many blocks
                first_of = {k: i for k, i in first_of.items() if k not in seen}
                seen.update(first_of)
            if not first_of:
                continue
            kept = list(first_of.values())
            at, text = at[kept], text[kept]
            first, stop = np.maximum(begins[text], at - context), np.minimum(ends[text], at + size + context)
            cut = zip(starts[first].tolist(), starts[stop].tolist(), (first > begins[text]).tolist(), (stop < ends[text]).tolist())
            matched = [(ellipsis if left else b"") + data[a:b] + (ellipsis if right else b"") for a, b, left, right in cut]
            yield text, [needle for _, needle in first_of], matched

    def finds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, *span in spans(batch.column(2)):
                texts, needles, matched = [], [], []
                for part in in_texts(*span):
                    texts.append(part[0])
                    needles += part[1]
                    matched += part[2]
                if texts:
                    rows = pa.array(np.concatenate(texts) + row)
                    yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(needles, pa.string()),
                                           pa.array(matched, pa.string())], [*batch.schema.names[:2], "needle", "matched"])

    return finds


def _doubtful(sent: Broadcast, lengths: list[int]):
    """Arrow function: the needles that a table of stretches has which are none."""
    hashes, inside = _hashes(lengths), _inside()

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = inside(sent.value, hashes(batch.column(0))[0], 1)
                yield pa.record_batch([batch.column(0).take(pa.array(kept))], ["_needle"])

    return doubtful


def _settling(texts: DataFrame, rules: DataFrame, sent: Broadcast, lengths: list[int]) -> Broadcast | None:
    """The table of stretches of ``texts`` that look like needles and are none, and the needles that it has too; None if needles
    are there twice, or too many are in it."""
    spark = texts.sparkSession
    stretches = texts.mapInArrow(_distinct_stretches(sent, lengths), "needle string").withColumn("n", F.lit(0))
    both = stretches.unionByName(rules.select(F.col("_needle").alias("needle"), F.lit(1).alias("n")))
    odd = stage(both.groupBy("needle").agg(F.sum("n").alias("n")).where("n <> 1"))
    if not odd.where("n > 1").isEmpty():
        return None
    table = _bit_tables(odd.where("n = 0").select(F.col("needle").alias("_needle")), kind=1)[1]
    listed = spark.sparkContext.broadcast(table)
    too = stage(rules.select("_needle").mapInArrow(_doubtful(listed, lengths), "_needle string"))
    count, size = too.agg(F.count("_needle"), F.coalesce(F.sum(F.octet_length("_needle")), F.lit(0))).first()
    if count > MOST_DOUBTFUL or size > MOST_DOUBTFUL_BYTES:
        return None
    return spark.sparkContext.broadcast((table, {r[0].encode() for r in too.collect()}))


def scan_pattern_table(df: DataFrame, patterns: DataFrame, key: str, text: str = "text", name: str = "name", dense: bool = False) -> DataFrame:
    """Needle findings for a pattern table of any size; ``key`` is kept and need not be unique.

    Patterns with a null or empty needle find nothing, nor do null texts.
    Equal patterns give equal findings. The join is by needle and, as Spark
    splits the side of the texts, a needle that most texts have is no one task.

    ``dense`` is for tables whose needles most texts have: finds are not shuffled, but
    texts and patterns are read more than once and must be the same each time. It needs patterns that are
    all different, in lower case and alike in all but the needle; others are joined.
    """
    rules = patterns.where(F.col("needle") != "").select(
        ascii_lower(F.col("needle")).alias("_needle"), F.col("signal").alias("_signal"), F.col("severity").alias("_severity"),
        F.coalesce("corpus_refs", F.array().cast("array<string>")).alias("_refs"),
        F.concat("signal", F.lit(": '"), "needle", F.lit("'")).alias("_detail"), (F.col("needle") == ascii_lower(F.col("needle"))).alias("_folded"),
    )
    rest = F.struct("_signal", "_severity", "_refs")
    alike = dense and rules.agg(F.min(rest).alias("rest"), (F.min(rest) == F.max(rest)).alias("one"), F.bool_and("_folded").alias("folded")).first()
    dense = bool(alike and alike["one"] and alike["folded"] and alike["rest"]["_signal"])
    needles = rules.select("_needle") if dense else rules.select("_needle").distinct()
    *tables, lengths = _bit_tables(needles)
    short_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(tables)
    texts = df.select(key, F.col(name).alias("tool_name"), F.col(text).alias("_text"))
    settling = _settling(texts.select("_text"), rules, sent, lengths) if dense else None
    schema = S.StructType([*texts.schema.fields[:2], S.StructField("needle", S.StringType()), S.StructField("matched", S.StringType())])
    places = texts.mapInArrow(_finds(sent, lengths, settling), schema)
    if settling:
        signal, severity, refs = alike["rest"]
        found = finding(NEEDLES, signal, F.lit(severity).cast("string"), F.col("matched"), F.concat(F.lit(f"{signal}: '"), "needle", F.lit("'")), refs)
    else:
        places = places.join(rules, F.col("needle") == F.col("_needle"))
        found = finding(NEEDLES, F.col("_signal"), F.col("_severity"), F.col("matched"), F.col("_detail"), F.col("_refs"))
    flat = places.select(key, "tool_name", F.lit(None).cast("string").alias("path"), found.alias("f"))
    return flat.select(key, "tool_name", *finding_columns())
