"""JSON text helpers: canonical form, string leaves, schema texts, keys.

JSON columns are strings. Two documents count as equal when their canonical
text is equal; ``1`` and ``1.0`` print alike and so count as equal.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.rules import words as W

# One JSON string in canonical text: a key (with its colon) or a value (captured without quotes).
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+":|"([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def _surely_unreadable(doc: Column) -> Column:
    """Whether a document that begins as an object is broken or too deep, or repeats a key of its own. One pass that fails at no
    cost, where the parser needs two exceptions with the whole text; all else is left to the parser."""
    keys = F.json_object_keys(doc)
    return doc.startswith("{") & (keys.isNull() | (F.size(F.array_distinct(keys)) < F.size(keys)))


def _parsed(doc: Column) -> Column:
    """A document as variant; null for null or unreadable input."""
    return F.when(~_surely_unreadable(doc), F.try_parse_json(doc))


def canonical_json(doc: Column) -> Column:
    """Compact JSON text with sorted keys; null for null or unreadable input."""
    return F.to_json(_parsed(doc))


def json_key(doc: Column) -> Column:
    """Text by which JSON documents are compared: canonical, or the raw text where it cannot be read.

    Unreadable means broken, deeper than the parser goes, or with a repeated key. Null stays null.
    """
    return F.coalesce(canonical_json(doc), F.concat(F.lit("\u0000"), doc))


def unreadable(doc: Column) -> Column:
    """Whether a document is there but cannot be read."""
    return doc.isNotNull() & _parsed(doc).isNull()


def unreadable_json(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("name",)) -> DataFrame:
    """One row per unreadable document: keep columns, ``column`` and its whole ``text``."""
    entries = [
        F.when(unreadable(F.col(c)), F.struct(F.lit(c).alias("column"), F.col(c).alias("text"))) for c in columns
    ]
    # told before they are listed: a generator's own expressions are interpreted, and repeated parts are evaluated again
    told = df.select(*keep, *[entry.alias(f"_bad_{k}") for k, entry in enumerate(entries)])
    listed = F.array(*[F.col(f"_bad_{k}") for k in range(len(entries))])
    return told.select(*keep, F.explode(F.array_compact(listed)).alias("_bad")).select(*keep, "_bad.column", "_bad.text")


def raw_leaves(canonical: Column) -> Column:
    """String values at any depth of canonical JSON, still JSON-escaped; keys come out as ''."""
    return F.regexp_extract_all(canonical, F.lit(_STRING), F.lit(1))


def json_leaves(doc: Column) -> Column:
    """All non-empty string values at any depth (not keys), in document order of the canonical text.

    Of an unreadable document, those that stand whole in its raw text.
    """
    return unescaped(raw_leaves(F.coalesce(canonical_json(doc), doc)))


def unescaped(leaves: Column) -> Column:
    """Non-empty ones of JSON-escaped strings, without their escapes."""
    quoted = F.transform(F.filter(leaves, lambda s: s != ""), lambda s: F.concat(F.lit('"'), s, F.lit('"')))
    as_list = F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))
    return F.coalesce(F.from_json(as_list, "array<string>"), F.array().cast("array<string>"))


def object_keys(doc: Column) -> Column:
    """Sorted top-level keys; an empty array for anything but an object. A repeated key counts once."""
    keys = F.coalesce(F.json_object_keys(canonical_json(doc)), F.array_distinct(F.json_object_keys(doc)))
    return F.coalesce(F.array_sort(keys), F.array().cast("array<string>"))


def json_string(value: Column) -> Column:
    """A string as JSON text, quoted and escaped."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def _schema_walker(root: str):
    """Arrow UDF over JSON text. A closure over plain values, so workers need no copy of this package."""
    content = frozenset(W.CONTENT_KEYS)

    def walk(doc):
        if not doc:
            return []
        try:
            todo = [(root, json.loads(doc))]
        except (ValueError, RecursionError):
            return [{"path": f"{root} (unreadable)", "text": doc}]  # scanned as it stands
        out = []
        while todo:
            path, node = todo.pop()
            if isinstance(node, list):
                todo += [(f"{path}[{i}]", v) for i, v in enumerate(node)]
            elif isinstance(node, dict):
                for key, child in node.items():
                    here = f"{path}.{key}"
                    if key in content and isinstance(child, str):
                        out.append((here, child))
                    elif key in content and isinstance(child, list):
                        out += [(f"{here}[{i}]", v) for i, v in enumerate(child) if isinstance(v, str)]
                    elif isinstance(child, (dict, list)):
                        todo.append((here, child))
        return [{"path": p, "text": t} for p, t in sorted(out)]

    def texts(docs: pd.Series) -> pd.Series:
        return docs.map(walk)

    return F.pandas_udf(texts, "array<struct<path:string,text:string>>")


def schema_texts(doc: Column, root: str = "inputSchema") -> Column:
    """Strings under content keys at any depth, with their path.

    A content key holding an array gives its string items; objects inside such
    an array are not entered. Other objects and arrays are. Strings under other
    keys are structure, not text. Of a repeated key the last value counts. A
    schema that is broken or too deep to read is one text as a whole.
    """
    return _schema_walker(root)(doc)


def walk_schema(df: DataFrame, schema: str = "inputSchema", keep=("name",), root: str = "inputSchema") -> DataFrame:
    """One row per schema text: keep columns, path, text."""
    return df.where(F.col(schema).isNotNull()).select(
        *keep, F.explode(schema_texts(F.col(schema), root)).alias("s")
    ).select(*keep, "s.path", "s.text")


def walk_schema_sql(df: DataFrame, schema: str = "inputSchema", keep=("name",), root: str = "inputSchema") -> DataFrame:
    """The same rows as ``walk_schema`` from a recursive query on VARIANT.

    Needs ``spark.sql.cteRecursionRowLimit=-1`` on large inputs and stops at
    ``spark.sql.cteRecursionLevelLimit`` levels, so it is the option, not the default.
    """
    keys = ", ".join(f"'{k}'" for k in W.CONTENT_KEYS)
    kept = ", ".join(keep)
    carried = ", ".join(f"w.{c}" for c in keep)
    return df.sparkSession.sql(
        f"""
        WITH RECURSIVE walk AS (
          SELECT {kept}, '{root}' AS path, try_parse_json({schema}) AS v, false AS leaf_ok, false AS stop
          FROM {{docs}} WHERE {schema} IS NOT NULL
          UNION ALL
          SELECT {carried},
                 CASE WHEN e.key IS NULL THEN concat(w.path, '[', e.pos, ']') ELSE concat(w.path, '.', e.key) END,
                 e.value,
                 CASE WHEN e.key IS NULL THEN w.leaf_ok ELSE e.key IN ({keys}) END,
                 e.key IS NULL AND w.leaf_ok
          FROM walk w, LATERAL variant_explode(w.v) e
          WHERE NOT w.stop
        )
        SELECT {kept}, path, CAST(v AS STRING) AS text FROM walk
        WHERE leaf_ok AND schema_of_variant(v) = 'STRING'
        """,
        docs=df,
    )
