"""Text scan: literal needles, structural wording, verb wording and similarity.

All passes run inside the row: one pass over the text finds every literal any
pass cares about, cheap gates on that result decide which texts are looked at
word by word (and only in the windows that a rule asks for), and a single
``explode`` yields the findings. There is no shuffle,
no cache and no second read, so the scan scales with the number of input
splits, and one source or name holding most of the rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as T
from wardline.functions.constants import constant, strings
from wardline.functions.findings import FINDING_TYPE, bind, finding, finding_columns, no_findings
from wardline.functions.literals import literal_hits, short_batches
from wardline.operators.tfidf import default_model
from wardline.rules import archetypes as A
from wardline.rules import words as W
from wardline.rules.needles import DESCRIPTION_NEEDLES, RESPONSE_NEEDLES
from wardline.rules.signals import SIGNALS

NEEDLES = "needles"
STRUCTURAL_RELAY = "structural_relay"
STRUCTURAL_INCLUSION = "structural_inclusion"
VERB_RELAY = "verb_relay"
VERB_OVERRIDE = "verb_override"
SIMILARITY = "similarity"
ALL_PASSES = (NEEDLES, STRUCTURAL_RELAY, STRUCTURAL_INCLUSION, VERB_RELAY, VERB_OVERRIDE, SIMILARITY)

_ABOUT = {name: about for name, _, about in SIGNALS}


@dataclass(frozen=True)
class Pattern:
    """One literal rule. The needle is folded A-Z; ``detail`` explains it to a reader."""

    needle: str
    signal: str
    severity: str
    corpus_refs: tuple = ()
    detail: str | None = None

    @property
    def folded(self) -> str:
        return self.needle.encode().lower().decode()

    @property
    def explanation(self) -> str:
        return self.detail or f"{_ABOUT.get(self.signal, self.signal)}: '{self.needle}'"


DESCRIPTION_PATTERNS = [Pattern(n, s, v, tuple(r.split())) for n, s, v, r in DESCRIPTION_NEEDLES]
RESPONSE_PATTERNS = [Pattern(n, s, v, tuple(r.split())) for n, s, v, r in RESPONSE_NEEDLES]

# pass -> verbs, nouns, signal, references, wording of the detail
STRUCTURAL = {
    STRUCTURAL_RELAY: (
        W.RELAY_VERBS, W.COMMUNICATION_NOUNS, "message_hijacking", ("TPA-020",),
        "Relay verb with a word for 'all' and a word for messages close by",
    ),
    STRUCTURAL_INCLUSION: (
        W.INCLUSION_VERBS, W.REQUEST_NOUNS, "argument_interception", ("TPA-015",),
        "Inclusion verb with a word for 'all' and a word for requests close by",
    ),
}
VERBS = {
    VERB_RELAY: (
        W.RELAY_SYNONYMS, "message_hijacking", ("TPA-020",), "Relay-like verb after 'when using' or the like",
    ),
    VERB_OVERRIDE: (
        W.OVERRIDE_SYNONYMS, "argument_interception", ("TPA-015",),
        "Override-like verb after 'when using' or the like",
    ),
}


def scan_text(
    df: DataFrame,
    text: str = "text",
    name: str = "name",
    keep: Sequence[str] = (),
    path: str | None = None,
    patterns: Sequence[Pattern] = tuple(DESCRIPTION_PATTERNS),
    passes: Iterable[str] = ALL_PASSES,
    extra: Column | None = None,
    matcher: str = "arrow",
    rule_prefix: str = "WARD",
) -> DataFrame:
    """Findings of the chosen passes over a text column.

    ``keep`` names columns to carry along (ids, groups), ``path`` an optional
    column that is put in front of the evidence, and ``extra`` an array of
    finding structs computed from the same row. Rows without text give nothing.
    """
    passes = set(passes)
    unknown = passes - set(ALL_PASSES)
    if unknown:
        raise ValueError(f"unknown passes: {sorted(unknown)}")
    literals = _literals(patterns, passes)
    number = {w: i for i, w in enumerate(literals)}
    if matcher != "jvm":
        short_batches(df.sparkSession)
    kept = [F.col(c) for c in keep]
    staged = df.where(F.col(text).isNotNull()).select(
        *kept,
        F.col(name).alias("tool_name"),
        (F.col(path) if path else F.lit(None).cast("string")).alias("path"),
        F.col(text).alias("_text"),
        (extra if extra is not None else no_findings()).alias("_extra"),
        literal_hits(F.col(text), literals, matcher).alias("_hits"),
    )
    worded = sorted(passes & (set(STRUCTURAL) | set(VERBS)))
    staged = staged.select("*", *[_windows(p, number).alias(f"_{p}") for p in worded])
    parts = [F.col("_extra")]
    if NEEDLES in passes:
        parts.append(_needle_findings(patterns, literals))
    parts += [_structural(p) if p in STRUCTURAL else _verbs(p) for p in worded]
    if SIMILARITY in passes:
        parts.append(_similarity(number))
    parts = [p.cast(f"array<{FINDING_TYPE}>") for p in parts]
    return staged.select(*kept, "tool_name", "path", F.explode(F.concat(*parts)).alias("f")).select(
        *kept, "tool_name", *finding_columns("f", rule_prefix)
    )


def scan_needles(df: DataFrame, **options) -> DataFrame:
    """Literal needles only (pass ``patterns`` to choose the set)."""
    return scan_text(df, passes=[NEEDLES], **options)


def scan_responses(df: DataFrame, text: str = "text", name: str = "tool", **options) -> DataFrame:
    """Response needles over text blocks; no other pass applies to responses."""
    return scan_text(df, text=text, name=name, patterns=RESPONSE_PATTERNS, passes=[NEEDLES], **options)


def scan_surface(df: DataFrame, name: str = "name", description: str = "description", **options) -> DataFrame:
    """All description passes over (name, description) rows; null descriptions give nothing."""
    return scan_text(df, text=description, name=name, **options)


def _gate_words(pass_: str) -> list[str]:
    """Words without which a wording pass cannot fire."""
    return STRUCTURAL[pass_][0] if pass_ in STRUCTURAL else VERBS[pass_][0]


def _literals(patterns: Sequence[Pattern], passes: set[str]) -> list[str]:
    """Every literal the chosen passes look at, once each."""
    out: list[str] = []
    if NEEDLES in passes:
        out += [p.folded for p in patterns]
    for p in sorted(passes & (set(STRUCTURAL) | set(VERBS))):
        out += _gate_words(p)
    if SIMILARITY in passes:
        out += list(default_model().idf)
    return list(dict.fromkeys(out))


def _windows(pass_: str, number: dict[str, int]) -> Column:
    """Word lists a wording pass has to look at; null unless one of its gate words is in the text.

    Each list opens with a verb (structural passes) or with the trigger words.
    """
    ids = [number[w] for w in _gate_words(pass_)]
    gate = F.exists("_hits", lambda h: (h["tokens"] > 0) & h["literal"].isin(ids))
    if pass_ in STRUCTURAL:
        pieces = T.windows(F.col("_text"), [STRUCTURAL[pass_][0]], W.STRUCTURAL_WINDOW - 1)
    else:
        pieces = T.windows(F.col("_text"), [[W.TRIGGER], W.TRIGGER_VERBS], W.VERB_WINDOW - 2)
    return F.when(gate, F.transform(pieces, lambda piece: T.words(T.ascii_lower(piece))))


def _needle_findings(patterns: Sequence[Pattern], literals: list[str]) -> Column:
    rules: dict[str, list[Pattern]] = {}
    for p in patterns:
        rules.setdefault(p.folded, []).append(p)
    table = constant(
        [
            [
                {"signal": p.signal, "severity": p.severity, "detail": p.explanation, "size": len(p.folded),
                 "refs": list(p.corpus_refs)}
                for p in rules[w]
            ]
            for w in literals if w in rules  # needles come first in the literal list
        ],
        "array<array<struct<signal:string,severity:string,detail:string,size:int,refs:array<string>>>>",
    )
    hits = F.filter("_hits", lambda h: h["literal"] < len(rules))
    return F.flatten(F.transform(hits, lambda h: F.transform(
        F.element_at(table, h["literal"] + 1),
        lambda p: finding(
            NEEDLES, p["signal"], p["severity"], T.snippet(F.col("_text"), h["start"], p["size"]), p["detail"],
            p["refs"],
        ),
    )))


def _at_word(pass_: str, found: Column, signal: str, refs: Sequence[str], detail: str) -> Column:
    """At most one finding, anchored at the first of the ``found`` words."""
    def build(word: Column) -> Column:
        start = T.word_start(F.col("_text"), word)
        return finding(
            pass_, signal, "medium", T.snippet(F.col("_text"), start, F.char_length(word)), detail, refs
        )

    return F.transform(F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, 1), build)


def _structural(pass_: str) -> Column:
    _, nouns, signal, refs, detail = STRUCTURAL[pass_]
    quantifiers, nouns = strings(W.QUANTIFIERS), strings(nouns)
    hits = F.filter(
        f"_{pass_}", lambda words: F.arrays_overlap(words, quantifiers) & F.arrays_overlap(words, nouns)
    )
    return _at_word(pass_, F.transform(hits, lambda words: words[0]), signal, refs, detail)


def _verbs(pass_: str) -> Column:
    verbs, signal, refs, detail = VERBS[pass_]
    found = F.flatten(F.transform(f"_{pass_}", lambda words: F.filter(
        F.slice(words, 3, W.VERB_WINDOW - 2), lambda w: w.isin(verbs)
    )))
    return _at_word(pass_, found, signal, refs, detail)


def _similarity(number: dict[str, int]) -> Column:
    model = default_model()
    ids = [number[t] for t in model.idf]
    words = list(number)  # in literal order
    idf = constant([model.idf.get(w) for w in words], "array<double>")
    archetypes = constant(
        [
            {"label": label, "signal": signal, "refs": refs.split(), "weights": [weight.get(w, 0.0) for w in words]}
            for (label, _, signal, refs), weight in zip(A.ARCHETYPES, model.weights, strict=True)
        ],
        "array<struct<label:string,signal:string,refs:array<string>,weights:array<double>>>",
    )
    shared = F.transform(
        F.filter("_hits", lambda h: (h["tokens"] > 0) & h["literal"].isin(ids)),
        lambda h: F.struct(h["literal"].alias("id"), (h["tokens"] * F.get(idf, h["literal"])).alias("raw")),
    )
    zero = F.lit(0.0)

    def near(terms: Column) -> Column:
        norm = F.sqrt(F.aggregate(terms, zero, lambda acc, t: acc + t["raw"] * t["raw"]))
        scored = F.transform(archetypes, lambda a: F.struct(
            a["label"].alias("label"), a["signal"].alias("signal"), a["refs"].alias("refs"),
            (F.aggregate(terms, zero, lambda acc, t: acc + t["raw"] * F.get(a["weights"], t["id"])) / norm).alias(
                "cosine"
            ),
        ))
        return F.filter(scored, lambda s: s["cosine"] >= A.MIN_COSINE)

    def first_per_signal(scored: Column) -> Column:
        return F.filter(scored, lambda s, i: ~F.exists(
            F.slice(scored, F.lit(1), i), lambda earlier: earlier["signal"] == s["signal"]
        ))

    hits = bind(shared, lambda terms: F.when(
        F.size(terms) >= A.MIN_SHARED_TERMS, bind(near(terms), first_per_signal)
    ))
    found = F.transform(hits, lambda s: finding(
        SIMILARITY, s["signal"], "low", T.head(F.col("_text")),
        F.concat(
            F.lit("Wording is close to archetype '"), s["label"], F.lit("' (cosine "),
            F.format_number(s["cosine"], 2), F.lit(")"),
        ),
        s["refs"],
    ))
    return F.coalesce(found, no_findings())
