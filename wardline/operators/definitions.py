"""Scans of whole definitions: descriptions, schema texts and annotation hints together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.constants import strings
from wardline.functions.findings import FINDING_TYPE, bind, finding, no_findings
from wardline.functions.jsontext import schema_texts
from wardline.functions.text import ascii_lower
from wardline.operators.scan import scan_text
from wardline.rules import words as W

ANNOTATIONS = "annotations"


def annotation_findings(annotations: Column, description: Column) -> Column:
    """Findings where a hint (a real JSON boolean) contradicts the wording of the description."""

    def contradiction(lower: Column, hints: Column, hint: str, value: str, words: Sequence[str], severity: str) -> Column:
        listed = strings(words)
        # of a text that cannot be read, such as one with a repeated key, the last value in it counts
        stated = F.when(
            hints.isNull(), F.regexp_extract(annotations, f'(?s).*"{hint}"\\s*:\\s*(true|false)\\b', 1)
        ).otherwise(F.to_json(F.try_variant_get(hints, f"$.{hint}", "variant")))
        hit = (stated == value) & F.exists(
            listed, lambda w: F.contains(lower, w)
        )
        return F.when(hit, finding(
            ANNOTATIONS, "annotation_deception", severity, F.lit(f"{hint}: {value}"),
            f"Hint {hint}={value} does not fit what the description says the tool does", (),
        ))

    once = F.struct(ascii_lower(F.coalesce(description, F.lit(""))).alias("lower"), F.try_parse_json(annotations).alias("hints"))
    found = bind(once, lambda row: F.array_compact(
        F.array(*[contradiction(row["lower"], row["hints"], *rule) for rule in W.ANNOTATION_RULES])
    ))
    return F.when(annotations.isNull(), no_findings()).otherwise(found.cast(f"array<{FINDING_TYPE}>"))


def scan_tools(
    df: DataFrame,
    name: str = "name",
    description: str = "description",
    schema: str | None = "inputSchema",
    annotations: str | None = "annotations",
    keep: Sequence[str] = (),
    surface: bool = True,
    **options,
) -> DataFrame:
    """All findings of tool definitions.

    Description and schema texts become one list per row and go through one
    scan; the annotation rules ride along on the description entry.
    """
    own = F.struct(F.lit(None).cast("string").alias("path"), F.col(description).alias("text"))
    lists = [F.array(own)] if surface else []
    if schema:
        lists.append(schema_texts(F.col(schema)))
    texts = df.select(
        *keep,
        F.col(name).alias("_name"),
        (F.col(annotations) if annotations else F.lit(None).cast("string")).alias("_annotations"),
        F.explode(F.concat(*lists)).alias("_t"),
    ).select(*keep, "_name", "_annotations", "_t.path", "_t.text")
    extra = F.when(
        F.col("path").isNull(), annotation_findings(F.col("_annotations"), F.col("text"))
    ).otherwise(no_findings()) if annotations and surface else None
    return scan_text(texts, text="text", name="_name", path="path", keep=keep, extra=extra, **options)


def scan_schema_text(df: DataFrame, **options) -> DataFrame:
    """Findings in schema texts only; the evidence starts with the path."""
    return scan_tools(df, surface=False, annotations=None, **options)


def scan_annotations(df: DataFrame, **options) -> DataFrame:
    """Annotation contradictions only."""
    return scan_tools(df, schema=None, passes=(), **options)
