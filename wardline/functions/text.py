"""Text primitives as Column expressions.

All positions count characters (code points) from 1, as Spark's ``instr`` and
``substring`` do. Case folding touches A-Z only: ``lower`` would also fold
letters such as KELVIN SIGN and move matches.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.rules import archetypes as A
from wardline.rules import words as W

ELLIPSIS = "…"
SPACE = " \\t\\n\\f\\r"
_SPACE = f"[{SPACE}]"
_ALNUM = "0-9A-Za-z"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes the cheap built-in ``lower``."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)


def words(lower: Column) -> Column:
    """Split at ASCII white space and trim non-alphanumerics from both ends of each word.

    A word of punctuation only becomes '' and still counts as a word.
    """
    parts = F.filter(F.split(lower, _SPACE + "+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.regexp_replace(w, f"^[^{_ALNUM}]+|[^{_ALNUM}]+$", ""))


def terms(lower: Column) -> Column:
    """Runs of ASCII alphanumerics of length two or more that are not stop words."""
    runs = F.regexp_extract_all(lower, F.lit("[%s]{%d,}" % (_ALNUM, A.MIN_TERM_LENGTH)), F.lit(0))
    return F.filter(runs, lambda t: ~t.isin(A.STOP_WORDS))


def snippet(text: Column, start: Column, length: Column, context: int = W.SNIPPET_CONTEXT) -> Column:
    """The match with up to ``context`` characters on each side, and an ellipsis where text was cut."""
    first = F.greatest(start - context, F.lit(1))
    stop = start + length + context
    size = F.char_length(text)
    return F.concat(
        F.when(first > 1, ELLIPSIS).otherwise(""),
        F.substring(text, first, stop - first),
        F.when(stop <= size, ELLIPSIS).otherwise(""),
    )


def word_start(text: Column, word: Column) -> Column:
    """First place where ``word`` stands after white space and before a non-alphanumeric, else 1."""
    # what comes before is measured in characters, as a match position would count UTF-16 units
    pattern = F.concat(F.lit(f"(?s)^(.*?)(?i)(?<![^{SPACE}])"), word, F.lit(f"(?![{_ALNUM}])"))
    return F.char_length(F.call_function("regexp_extract", text, pattern, F.lit(1))) + 1


def word_pattern(choices: Sequence[str]) -> str:
    """Regex of one whole word, as ``words`` cuts it, whose trimmed form is one of ``choices``."""
    trimmings = f"[^{_ALNUM}{SPACE}]*+"
    return f"{trimmings}(?:{'|'.join(choices)}){trimmings}(?![^{SPACE}])"


def windows(text: Column, start: Sequence[Sequence[str]], size: int) -> Column:
    """Pieces of text that open with words from ``start`` in a row and go on for up to ``size`` more words.

    In text order. The pieces may overlap, as the search itself consumes nothing.
    """
    gap = f"[{SPACE}]+"
    opening = gap.join(word_pattern(choices) for choices in start)
    pattern = f"(?i)(?<![^{SPACE}])(?=({opening}(?:{gap}[^{SPACE}]+){{0,{size}}}))"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def head(text: Column, size: int = W.SIMILARITY_EVIDENCE) -> Column:
    """First ``size`` characters."""
    return F.substring(text, 1, size)


def head_ellipsis(text: Column, size: int = W.PROBE_EVIDENCE) -> Column:
    """First ``size`` characters, with an ellipsis if there are more."""
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit(ELLIPSIS))).otherwise(text)


def finding_id(tool: Column, signal: Column) -> Column:
    return F.concat_ws("/", tool, signal)


def checksum(block: int = 1 << 16) -> Callable[[Column], Column]:
    """Column function: the polynomial-31 checksum of a text's UTF-8 bytes, modulo 2**32, a block of bytes at a time."""

    def add(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        powers = np.full(block, 31, np.uint32)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint32)[::-1].copy()  # the last byte counts once

        def one(text: str | None) -> int:
            data, total = np.frombuffer((text or "").encode(), np.uint8), 0
            for at in range(0, len(data), block):
                part = data[at:at + block]
                total = total * pow(31, len(part), 1 << 32) + int((part * powers[block - len(part):]).sum(dtype=np.uint32))
            return total & 0xFFFFFFFF

        for batch in batches:
            yield pd.Series([one(t) for t in batch], dtype="int64")

    return F.pandas_udf(add, "long")


def fingerprint(tool: Column, signal: Column, matched: Column) -> Column:
    """Finding id plus a polynomial-31 checksum of the matched UTF-8 bytes; the id alone if nothing matched."""
    ident = finding_id(tool, signal)
    marked = F.concat(ident, F.lit("/"), F.lpad(F.lower(F.hex(checksum()(matched))), 8, "0"))
    return F.when(matched.isNull(), None).when(F.octet_length(matched) == 0, ident).otherwise(marked)


def tag_server(server: Column, tool: Column) -> Column:
    return F.concat_ws("/", server, tool)
