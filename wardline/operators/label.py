"""Labels of upstream rows: field spellings, aliases and wording patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.constants import lookup
from wardline.functions.findings import bind
from wardline.rules import labels as L


def _normal(raw: Column) -> Column:
    return F.lower(F.trim(raw))


def paradigm_alias(raw: Column) -> Column:
    """One of three names for a known spelling, else the value as it is."""
    return F.coalesce(lookup(L.PARADIGM_ALIASES, _normal(raw)), raw)


def risk_alias(raw: Column) -> Column:
    """One of ten names for a known spelling, else the value as it is."""
    return F.coalesce(lookup(L.RISK_ALIASES, _normal(raw)), raw)


def paradigm_heuristic(description: Column) -> Column:
    """Paradigm by wording: argument hijacking, else fake enabling, else unrelated."""
    any_of = lambda patterns: "(?iuUd)" + "|".join(patterns)
    return (
        F.when(description.rlike(any_of(L.ARGUMENT_HIJACKING_PATTERNS)), "argument-hijacking")
        .when(description.rlike(any_of(L.FAKE_ENABLING_PATTERNS)), "fake-enabling-prerequisite")
        .otherwise("unrelated-prerequisite")
    )


#: What may stand between the literal parts of a label pattern: a class that may be absent, or any signs of a line.
_BETWEEN = re.compile(r"\[[^\]]*\]\??|\.[*?]?")
_ESCAPED = re.compile(r"\\(\W)")


def literal_parts(pattern: str) -> tuple[list[str], bool]:
    """Strings that every match of a pattern holds, and whether holding it is all there is to a match.

    A pattern with other signs of regular expressions than those between literal parts has no such strings.
    """
    held: list[str] = []
    plain = _ESCAPED.sub(lambda m: held.append(m[1]) or f"\0{len(held) - 1}\1", pattern)
    pieces = _BETWEEN.split(plain)
    if any(c in piece for piece in pieces for c in "\\|()[]{}^$*+?."):
        return [], False
    whole = [re.sub("\0(\\d+)\1", lambda m: held[int(m[1])], piece) for piece in pieces]
    return [w for w in whole if w], len(pieces) == 1


def risk_heuristic(description: Column) -> Column:
    """Risk category by wording; the first group that hits wins, else null.

    A pattern is only run on texts that hold all its literal parts; one that is nothing else is not run at all.
    """
    def category(lower: Column) -> Column:
        out = F
        for name, patterns in L.RISK_PATTERNS:
            hits = []
            for pattern in patterns:
                parts, whole = literal_parts(pattern)
                held = [F.contains(lower, F.lit(p)) for p in parts]
                hits.append(reduce(and_, held if whole else [*held, lower.rlike("(?Ud)" + pattern)]))
            out = out.when(reduce(or_, hits), name)
        return out

    return bind(F.lower(description), category)


def _text(value: Column) -> Column:
    """A VARIANT as text: strings as they are, other values as JSON."""
    return F.when(value.isNull(), None).otherwise(
        F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    )


def _present(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def first_present(item: Column, names: Sequence[str]) -> Column:
    """Text of the first field that is there."""
    return F.coalesce(*[_text(_present(item, n)) for n in names])


def first_filled(item: Column, names: Sequence[str]) -> Column:
    """Text of the first field that is there and holds something."""
    empty = ['""', "null", "false", "0", "{}", "[]"]
    return F.coalesce(*[F.when(~F.to_json(_present(item, n)).isin(empty), _text(_present(item, n))) for n in names])


def pick_fields(rows: DataFrame, item: str = "item", keep: Sequence[str] = ()) -> DataFrame:
    """name, description, inputSchema, paradigm_raw, risk_raw from a VARIANT row under any known field spelling."""
    v = F.col(item)
    return rows.select(
        *keep,
        F.coalesce(first_filled(v, L.NAME_FIELDS), F.lit("")).alias("name"),
        F.coalesce(first_filled(v, L.DESCRIPTION_FIELDS), F.lit("")).alias("description"),
        F.coalesce(first_filled(v, L.SCHEMA_FIELDS), F.lit(L.DEFAULT_SCHEMA)).alias("inputSchema"),
        first_present(v, L.PARADIGM_FIELDS).alias("paradigm_raw"),
        first_present(v, L.RISK_FIELDS).alias("risk_raw"),
    )


def upstream_shape(doc: Column) -> Column:
    """'list', 'paradigm', 'risk', 'wrapper' or null, in that order of precedence. The document is read once."""

    def shape(row: Column) -> Column:
        known = lambda names: F.exists(row["keys"], lambda k: k.isin(list(names)))
        wrapped = F.coalesce(*[
            F.when(F.to_json(_present(row["doc"], k)).startswith("["), F.lit(k)) for k in L.WRAPPER_FIELDS
        ])
        return (
            F.when(row["listed"], "list")
            .when(known([*L.PARADIGM_ALIASES, *L.PARADIGMS]), "paradigm")
            .when(known(L.RISK_ALIASES), "risk")
            .when(wrapped.isNotNull(), "wrapper")
        )

    def parts(v: Column) -> Column:
        return bind(F.struct(v.alias("doc"), F.to_json(v).alias("text")), lambda d: F.struct(
            d["doc"].alias("doc"), d["text"].startswith("[").alias("listed"),
            F.transform(F.json_object_keys(d["text"]), _normal).alias("keys"),
        ))

    return bind(bind(doc, parts), shape)


def normalise_upstream(docs: DataFrame, doc: str = "doc", keep: Sequence[str] = ()) -> DataFrame:
    """One row per tool of upstream documents (JSON text): keep, item (VARIANT), key_paradigm, key_risk.

    Accepts a list, a wrapped list, a map by paradigm, and a map by risk of maps
    by paradigm. The map keys are labels for rows that have none of their own.
    Documents of another shape give nothing; ``unrecognised_upstream`` lists them.
    """
    base = docs.select(*keep, F.try_parse_json(F.col(doc)).alias("v"))
    base = base.select(*keep, "v", upstream_shape(F.col("v")).alias("shape"))
    items = lambda v: F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")
    )
    entries = lambda v: F.map_entries(F.coalesce(
        F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")
    ))
    row = lambda item, paradigm, risk: F.struct(
        item.alias("item"), paradigm.alias("key_paradigm"), risk.alias("key_risk")
    )
    none = F.lit(None).cast("string")
    alias = lambda k: lookup({**L.PARADIGM_ALIASES, **{p: p for p in L.PARADIGMS}}, _normal(k))
    risk_of = lambda k: lookup(L.RISK_ALIASES, _normal(k))
    flat = lambda v, paradigm, risk: F.transform(items(v), lambda i: row(i, paradigm, risk))
    by_paradigm = lambda v, risk: F.flatten(F.transform(
        entries(v), lambda e: flat(e["value"], alias(e["key"]), risk)
    ))
    v = F.col("v")
    wrapped = F.coalesce(*[
        F.when(F.to_json(_present(v, k)).startswith("["), _present(v, k)) for k in L.WRAPPER_FIELDS
    ])
    rows = (
        F.when(F.col("shape") == "list", flat(v, none, none))
        .when(F.col("shape") == "paradigm", by_paradigm(v, none))
        .when(F.col("shape") == "risk", F.flatten(F.transform(
            entries(v), lambda e: by_paradigm(e["value"], risk_of(e["key"]))
        )))
        .when(F.col("shape") == "wrapper", flat(wrapped, none, none))
    )
    return base.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.item", "r.key_paradigm", "r.key_risk")


def unrecognised_upstream(docs: DataFrame, doc: str = "doc") -> DataFrame:
    return docs.where(upstream_shape(F.try_parse_json(F.col(doc))).isNull())


def label_rows(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Final labels of picked rows: adds paradigm, risk_category and where each came from.

    A given label is mapped by its alias; without one the wording decides.
    """
    given_p = F.nullif(F.col("paradigm_raw"), F.lit(""))
    given_r = F.nullif(F.col("risk_raw"), F.lit(""))
    guessed = risk_heuristic(F.col("description"))
    return rows.select(
        *keep, "name", "description", "inputSchema",
        F.lit(True).alias("is_attack"),
        F.coalesce(paradigm_alias(given_p), paradigm_heuristic(F.col("description"))).alias("paradigm"),
        F.coalesce(risk_alias(given_r), guessed).alias("risk_category"),
        F.when(given_p.isNotNull(), "given").otherwise("heuristic").alias("paradigm_source"),
        F.when(given_r.isNotNull(), "given").when(guessed.isNotNull(), "heuristic").otherwise("unknown").alias(
            "risk_source"
        ),
    )


def label_upstream(docs: DataFrame, doc: str = "doc", keep: Sequence[str] = ()) -> DataFrame:
    """Upstream documents to labelled rows."""
    rows = normalise_upstream(docs, doc, keep)
    picked = pick_fields(rows, "item", [*keep, "key_paradigm", "key_risk"])
    filled = picked.withColumn(
        "paradigm_raw",
        F.when(F.coalesce("paradigm_raw", F.lit("")) == "", F.coalesce("key_paradigm", "paradigm_raw")).otherwise(
            F.col("paradigm_raw")
        ),
    ).withColumn(
        "risk_raw",
        F.when(F.coalesce("risk_raw", F.lit("")) == "", F.coalesce("key_risk", "risk_raw")).otherwise(
            F.col("risk_raw")
        ),
    )
    return label_rows(filled, keep)


def label_stats(labelled: DataFrame) -> DataFrame:
    """One row: total and the counts of given, heuristic and unknown labels."""
    return labelled.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("paradigm_source") == "given").alias("paradigm_given"),
        F.count_if(F.col("paradigm_source") == "heuristic").alias("paradigm_heuristic"),
        F.count_if(F.col("risk_source") == "given").alias("risk_given"),
        F.count_if(F.col("risk_source") == "heuristic").alias("risk_heuristic"),
        F.count_if(F.col("risk_source") == "unknown").alias("risk_unknown"),
    )


def label_counts(labelled: DataFrame) -> DataFrame:
    """kind ('paradigm' or 'risk_category'), value, total, from one pass over the rows."""
    pairs = F.array(
        F.struct(F.lit("paradigm").alias("kind"), F.col("paradigm").alias("value")),
        F.struct(F.lit("risk_category").alias("kind"), F.col("risk_category").alias("value")),
    )
    return (
        labelled.select(F.explode(pairs).alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy("p.kind", "p.value")
        .agg(F.count("*").alias("total"))
    )
