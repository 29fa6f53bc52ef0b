"""Language-model scores from a subword lattice.

The pieces of an existing subword vocabulary are the arcs of a lattice over the bytes of a text; each word begins with
the vocabulary's word mark, and pieces do not run across words. Each word of the training rows is one more arc, over
its whole span. The text's probability is the sum, over all ways to cover it with arcs, of the product of their
probabilities, times that of the end. It is found by the forward recursion in log space. As no arc crosses a word, the
sum is the product over words of the sums over their own lattices, so each distinct word is worked out once.

The vocabulary's scores give the pieces' first weights (a score that is minus a merge rank becomes 1 / (1 + rank), a
log probability its power of e); expected counts over the lattices of all distinct training words then replace them in
a few rounds. The vocabulary itself is never changed. A training word's own arc has (count - 0.75) of N tokens; what
the 0.75 leave over goes to the cuts into pieces, so that all texts' probabilities add up to 1.

Counts of words are gathered over all documents. The most frequent words (at most `head_words`, and of 64 bytes at
most each) go to the workers as one table of bounded size; all others are joined on the word.

Results: one row per input row, rows with equal keys included. A null or empty text has one token, the end. With no
training rows all counts are 0 and the first weights stand. No rows give no rows. Other columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, batch_rows, map_batches, row_numbers, spaced_words

MARK = "▁".encode()
#: What each training word's own arc gives up for the cuts into pieces.
DISCOUNT = 0.75
#: Words longer than this many bytes are walked one by one instead of side by side.
LONG = 96
_LN10 = math.log(10)


class Vocabulary:
    """The pieces of a SentencePiece file as byte strings, with a first weight each."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        weights: dict[bytes, float] = {}
        for i in range(own.get_piece_size()):
            if own.is_control(i) or own.is_unknown(i) or own.is_unused(i):
                continue
            score = own.get_score(i)
            if own.is_byte(i):
                piece, weight = bytes([int(own.id_to_piece(i)[3:5], 16)]), 1e-6
            else:
                piece = own.id_to_piece(i).encode()
                weight = 1 / (1 - score) if score <= 0 and score == int(score) else math.exp(score)
            weights[piece] = weights.get(piece, 0.0) + weight
        for b in range(256):  # every text has a cut
            weights.setdefault(bytes([b]), 1e-6)
        self.pieces = sorted(weights)
        if len(self.pieces) >= 1 << 20 or max(map(len, self.pieces)) >= 1 << 8:
            raise ValueError("the vocabulary is too large")
        self.weights = np.array([weights[p] for p in self.pieces])
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            self.automaton.add_word(piece.decode("latin-1"), len(piece) << 20 | i)
        self.automaton.make_automaton()

    def arcs(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of all arcs of marked words of at most LONG bytes."""
        found: list[int] = []
        walk = self.automaton.iter
        for i, word in enumerate(words):
            base = i << 40
            found += [base + (end << 28) + code for end, code in walk((MARK + word).decode("latin-1"))]
        codes = np.array(found, np.int64)
        end = (codes >> 28 & 0xFFF) + 1
        return codes >> 40, end - (codes >> 20 & 0xFF), end, codes & 0xFFFFF


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _log_sums(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, log of the sum of exp) of values in runs of equal groups."""
    at = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    top = np.maximum.reduceat(values, at)
    spans = np.diff(np.append(at, len(values)))
    return groups[at], top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, spans)), at))


def _sweep(word, source, target, logs, table) -> None:
    """Fill `table` (word, place) by the recursion over arcs, in the order of their targets' places."""
    order = np.lexsort((word, target))
    word, source, target, logs = word[order], source[order], target[order], logs[order]
    cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True])))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own, sums = _log_sums(table[word[lo:hi], source[lo:hi]] + logs[lo:hi], word[lo:hi])
        table[own, target[lo]] = sums


def forward(words: list[bytes], voc: Vocabulary, logs: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Natural log probabilities of words of at most LONG bytes, and (arcs, forward table)."""
    word, start, end, piece = voc.arcs(words)
    size = np.array([len(w) + len(MARK) for w in words])
    table = np.full((len(words), int(size.max()) + 1), -np.inf)
    table[:, 0] = 0.0
    _sweep(word, start, end, logs[piece], table)
    return table[np.arange(len(words)), size], (word, start, end, piece, size, table)


def forward_long(word: bytes, voc: Vocabulary, logs: list[float]) -> float:
    """Natural log probability of one word of any length; holds as many places as the longest piece has bytes."""
    ring = 256
    held = [-math.inf] * ring
    held[0] = 0.0
    place, best, total = 0, -math.inf, 0.0
    terms: list[float] = []
    for last, code in voc.automaton.iter((MARK + word).decode("latin-1")):
        if last + 1 != place and terms:
            best = max(terms)
            held[place % ring] = best + math.log(sum(math.exp(t - best) for t in terms))
            terms = []
        place = last + 1
        terms.append(held[(place - (code >> 20)) % ring] + logs[code & 0xFFFFF])
    best = max(terms)
    total = best + math.log(sum(math.exp(t - best) for t in terms))
    return total


def expected(words: list[bytes], counts: np.ndarray, voc: Vocabulary, logs: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words of at most LONG bytes that occur so often."""
    whole, (word, start, end, piece, size, table) = forward(words, voc, logs)
    back = np.full_like(table, -np.inf)
    back[np.arange(len(words)), size] = 0.0
    # the recursion from the end: places are counted from there
    order = np.lexsort((word, -start))
    w, s, e, p = word[order], start[order], end[order], piece[order]
    cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own, sums = _log_sums(back[w[lo:hi], e[lo:hi]] + logs[p[lo:hi]], w[lo:hi])
        at = s[lo]
        back[own, at] = np.where(at == size[own], back[own, at], sums)
    share = np.exp(table[w, s] + logs[p] + back[w, e] - whole[w]) * counts[w]
    return np.bincount(p, share, len(voc.pieces))


def _log_sum(terms: list[float]) -> float:
    best = max(terms)
    return best + math.log(sum(math.exp(t - best) for t in terms))


def expected_long(word: bytes, voc: Vocabulary, logs: list[float], step: int = 1 << 14) -> dict[int, float]:
    """Expected counts of the pieces in one word of any length. The forward recursion leaves its last values at every
    `step` bytes; from the end on, each segment is run again from there, so one segment's arcs are held at a time."""
    marked = (MARK + word).decode("latin-1")
    reach = 255  # a piece has no more bytes

    def arcs(low: int, high: int) -> Iterator[tuple[int, int]]:
        """(end, code) of the arcs that end after `low`, and at `high` at the latest."""
        begin = max(0, low - reach)
        for last, code in voc.automaton.iter(marked[begin:high]):
            if begin + last + 1 > low:
                yield begin + last + 1, code

    def ahead(tail: list[float], low: int, found) -> list[float]:
        """Forward values of the places from `low - reach` on."""
        table, base, place, terms = tail[:], low - reach, low + 1, []
        for end, code in found:
            if end != place:
                table.append(_log_sum(terms))
                place, terms = end, []
            terms.append(table[end - (code >> 20) - base] + logs[code & 0xFFFFF])
        table.append(_log_sum(terms))
        return table

    lows = range(0, len(marked), step)
    tails = [[-math.inf] * reach + [0.0]]
    for low in lows:
        tails.append(ahead(tails[-1], low, arcs(low, min(low + step, len(marked))))[-reach - 1:])
    whole = tails.pop()[-1]
    out: dict[int, float] = {}
    carry = [-math.inf] * reach + [0.0]  # backward values of the last places of the segment
    for low in reversed(lows):
        found = list(arcs(low, min(low + step, len(marked))))
        table = ahead(tails.pop(), low, found)
        back = [-math.inf] * (len(table) - len(carry)) + carry
        base = low - reach
        for end, code in reversed(found):
            piece, start = code & 0xFFFFF, end - (code >> 20) - base
            term = logs[piece] + back[end - base]
            held = back[start]
            back[start] = term if held == -math.inf else max(held, term) + math.log1p(math.exp(-abs(held - term)))
            out[piece] = out.get(piece, 0.0) + math.exp(table[start] + term - whole)
        carry = back[:reach + 1]
    return out


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_counts(docs: DataFrame, trains: Column, text: str) -> DataFrame:
    """(word binary, c, n): how often each word occurs in training rows, and in all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for train, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[bool(train)].update(spaced_words(data))
            if sum(map(len, counts)) > 400_000:
                yield from flushed(counts)
        yield from flushed(counts)

    def flushed(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for train, own in enumerate(counts):
            if own:
                n = pa.array(own.values(), pa.int64())
                zero = pa.array(np.zeros(len(own), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), n if train else zero, n], ["word", "c", "n"])
                own.clear()

    own = docs.select(trains.alias("train"), F.col(text).cast("binary").alias("data"))
    found = map_batches(own, work, "word binary, c long, n long")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(words: DataFrame, n_ends: int, path: str, rounds: int = 2, floor: float = 0.1) -> tuple[np.ndarray, float]:
    """(natural log probability of each piece, that of the end) after so many rounds over the training words."""
    voc = vocabulary(path)
    spark = words.sparkSession
    weights, end = voc.weights, max(1.0, 0.01 * voc.weights.sum())
    if not n_ends:
        rounds = 0
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(np.log(weights / (weights.sum() + end)))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, logs = vocabulary(path), sent.value
            sums, listed = np.zeros(len(own.pieces)), None
            for batch in _chunks(batches):
                found = batch.column(0).to_pylist()
                counts = np.ones(len(found))  # new words are like the distinct words, not like the frequent ones
                short = np.array([len(w) + len(MARK) <= LONG for w in found])
                if short.any():
                    sums += expected([w for w in found if len(w) + len(MARK) <= LONG], counts[short], own, logs)
                for k in np.flatnonzero(~short):
                    listed = listed or logs.tolist()
                    for piece, share in expected_long(found[k], own, listed).items():
                        sums[piece] += share * counts[k]
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], ["piece", "n"])

        with batch_rows(spark, 8192):  # one row per piece
            found = words.where("c > 0").select("word").mapInArrow(count, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        weights = np.full(len(voc.pieces), floor)
        weights[found.piece] += found.n
        end = floor
    total = weights.sum() + end
    return np.log(weights / total), math.log(end / total)


def spelled(lp: np.ndarray, logs: np.ndarray, voc: Vocabulary, end: float) -> np.ndarray:
    """Log probabilities of words, from those of their cuts: the first piece is one with the mark, and the word stops
    where the next piece would have it."""
    mark = float(np.exp(logs[[p.startswith(MARK) for p in voc.pieces]]).sum())
    return lp + math.log((mark + math.exp(end)) / mark)


def score_words(words: DataFrame, logs: np.ndarray, end: float, path: str, total: int, kinds: int) -> DataFrame:
    """(word, c, n, lp): the natural log of each word's marginal probability, from `kinds` distinct training words
    among `total` training tokens."""
    sent = words.sparkSession.sparkContext.broadcast(logs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs = vocabulary(path), sent.value
        listed = None
        for batch in _chunks(batches):
            found = batch.column(0).to_pylist()
            out = np.empty(len(found))
            short = np.array([len(w) + len(MARK) <= LONG for w in found])
            if short.any():
                out[short] = forward([w for w in found if len(w) + len(MARK) <= LONG], own, logs)[0]
            for k in np.flatnonzero(~short):
                listed = listed or logs.tolist()
                out[k] = forward_long(found[k], own, listed)
            if total:
                rest = spelled(out, logs, own, end) + math.log(max(DISCOUNT * kinds, 1e-9) / total)
                with np.errstate(divide="ignore"):
                    out = np.logaddexp(rest, np.log(np.maximum(batch.column(1).to_numpy() - DISCOUNT, 0) / total))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["word", "c", "n", "lp"])

    return words.select("word", "c", "n").mapInArrow(work, "word binary, c long, n long, lp double")


def score(
    docs: DataFrame, trains: Column, path: str, key: str = "doc_id", text: str = "text", rounds: int = 2, head_words: int = 1 << 17,
) -> DataFrame:
    """(key, row, trains, n_tokens, n_known, train_tokens, base_score, score) per row; `trains` says which rows are
    learned from, and `path` names a SentencePiece file that every worker can open. Scores are log10."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    trains = F.coalesce(trains, F.lit(False))
    n_ends = docs.where(trains).count()
    counted = scratch.stage(word_counts(docs, trains, text), "counts")
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, kinds = n + n_ends, v + (1 if n_ends else 0)
    logs, end_log = fit(counted, n_ends, path, rounds)
    text_end = math.log(n_ends / total) if n_ends else end_log
    with batch_rows(spark, 8192):
        words = scratch.stage(score_words(counted, logs, end_log, path, total, v), "words")
    scratch.drop("counts")
    # at most head_words: whole classes of frequency, from the top
    level = F.floor(F.log2("n") * 16)
    short = words.where(F.octet_length("word") <= 64)
    classes = sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True)  # about 16 * 64 rows at most
    taken, cut = 0, None
    for r in classes:
        taken += r["count"]
        if taken > head_words:
            break
        cut = r["level"]
    least = F.lit(False) if cut is None else (level >= cut) & (F.octet_length("word") <= 64)
    head = words.where(least).select("word", "c", "lp").toPandas()
    base = math.log10(1 / (total + 0.1 * (kinds + 1)))
    sent = spark.sparkContext.broadcast(
        (dict(zip(map(bytes, head["word"]), range(len(head)), strict=True)), np.append(head["c"].to_numpy(np.float64), 0.0), np.append(head["lp"].to_numpy(np.float64), 0.0))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, c, lp = sent.value
        own = (c > 0).astype(np.int64)
        base10 = np.log10(c + 0.1) + base
        first, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            sums, tails = [], []
            for data in batch.column(2).to_pylist():
                found = spaced_words(data)
                at = np.fromiter((place.get(w, -1) for w in found), np.int64, len(found))
                known = at[at >= 0]
                sums.append((len(found) + 1, int(own[known].sum()), float(base10[known].sum()), float(lp[known].sum())))
                tails.append([{"word": w, "tf": k} for w, k in Counter(found[i] for i in np.flatnonzero(at < 0)).items()])
            rows = row_numbers(first, len(sums), part)
            first += len(sums)
            columns = list(zip(*sums, strict=True)) if sums else [[], [], [], []]
            kind = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column(0), batch.column(1), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64()), pa.array(tails, kind)],
                ["row", "key", "trains", "n_tokens", "known", "base", "lp", "tail"],
            )

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), trains.alias("trains"), F.col(text).cast("binary").alias("data"))
    schema = f"row long, key {kind}, trains boolean, n_tokens long, known long, base double, lp double, tail array<struct<word: binary, tf: long>>"
    passed = scratch.stage(map_batches(own, work, schema), "passed")
    tail = passed.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf")
    rest = (
        tail.join(words.where(~least).select("word", "c", F.col("lp").alias("wlp")), "word")
        .groupBy("row").agg(
            F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known_"),
            F.sum(F.col("tf") * (F.log10(F.col("c") + 0.1) + base)).alias("base_"),
            F.sum(F.col("tf") * F.col("wlp")).alias("lp_"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        passed.drop("tail").join(rest, "row", "left").select(
            F.col("key").alias(key), "row", "trains", "n_tokens",
            (F.col("known") + zero("known_") + (1 if n_ends else 0)).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + zero("base_") + (math.log10(n_ends + 0.1) + base)).alias("base_score"),
            ((F.col("lp") + zero("lp_") + text_end) / _LN10).alias("score"),
        )
    )
