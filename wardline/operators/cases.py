"""Argument cases from tool schemas: one row per (tool, case) with the full argument object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.constants import lookup
from wardline.functions.jsontext import json_string
from wardline.rules import mutations as M

_SCHEMA = "struct<properties:map<string,string>,required:array<string>>"


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    """Add _properties (field -> JSON text of its schema) and _required (distinct names)."""
    canonical = F.to_json(F.try_parse_json(F.col(schema)))
    return df.withColumn("_s", F.from_json(canonical, _SCHEMA)).select(
        *df.columns,
        F.col("_s.properties").alias("_properties"),
        F.array_distinct(F.coalesce(F.col("_s.required"), F.array().cast("array<string>"))).alias("_required"),
    )


def _field_type(prop: Column) -> Column:
    """The declared type; anything but one plain type name counts as string."""
    declared = F.try_variant_get(F.try_parse_json(prop), "$.type", "variant")
    return F.when(
        F.to_json(declared).startswith('"'), F.try_variant_get(F.try_parse_json(prop), "$.type", "string")
    ).otherwise("string")


def _enum(prop: Column) -> Column:
    """Declared values as JSON texts; null if there is no enum array."""
    values = F.try_variant_get(F.try_parse_json(prop), "$.enum", "array<variant>")
    return F.transform(values, lambda v: F.to_json(v))


def _default(prop: Column) -> Column:
    """JSON text of the value a field gets when another one is mutated."""
    by_type = {t: M.to_json_text(v) for t, v in M.TYPE_DEFAULTS.items()}
    return F.coalesce(F.get(_enum(prop), F.lit(0)), lookup(by_type, _field_type(prop)), F.lit("null"))


def _object(fields: Column) -> Column:
    """JSON object text of a map name -> JSON text, keys sorted."""
    keys = F.array_sort(F.map_keys(fields))
    parts = F.transform(keys, lambda k: F.concat(json_string(k), F.lit(":"), F.element_at(fields, k)))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def schema_fields(df: DataFrame, tool: str = "name", schema: str = "inputSchema") -> DataFrame:
    """tool, field, type, enum (JSON texts), required, default_value (JSON text)."""
    fields = _parsed(df, schema).select(
        F.col(tool).alias("tool"), "_required", F.explode("_properties").alias("field", "_prop")
    )
    return fields.select(
        "tool", "field", _field_type(F.col("_prop")).alias("type"), _enum(F.col("_prop")).alias("enum"),
        F.array_contains("_required", F.col("field")).alias("required"),
        _default(F.col("_prop")).alias("default_value"),
    )


def mutation_catalog(spark: SparkSession) -> DataFrame:
    """The fixed mutations: type_group, label, value (JSON text). About 120 rows."""
    return spark.createDataFrame(M.catalog(), "type_group string, label string, value string")


def _type_group(type_: Column) -> Column:
    return F.when(type_.isin("string", "boolean", "array", "object"), type_).when(
        type_.isin("integer", "number"), "number"
    ).otherwise("other")


def _catalog_entries(group: Column) -> Column:
    """The fixed mutations of a type group as a constant array of (label, value)."""
    groups: dict[str, list[Column]] = {}
    for name, label, value in M.catalog():
        groups.setdefault(name, []).append(F.struct(F.lit(label).alias("label"), F.lit(value).alias("value")))
    entries = F.array().cast("array<struct<label:string,value:string>>")
    for name, listed in groups.items():
        entries = F.when(group == name, F.array(*listed)).otherwise(entries)
    return entries


def boundary_cases(
    df: DataFrame, tool: str = "name", schema: str = "inputSchema", catalog: DataFrame | None = None
) -> DataFrame:
    """tool, field, label, args: every field takes every mutation of its type, the others keep their default.

    Each schema is read once, into its sorted fields with type, enum and
    default. What stands before and after a field in the arguments is the same
    for all of its mutations, so a case only puts three texts together. The
    fixed catalog is a constant of the plan; a table passed in is joined by
    type. Nothing else is shuffled.
    """
    entry = lambda label, value: F.struct(label.alias("label"), value.alias("value"))

    def read(prop: Column) -> Column:
        """(type, enum, default) of the JSON text of a property."""
        return F.struct(_field_type(prop).alias("type"), _enum(prop).alias("enum"), _default(prop).alias("default"))

    ordered = F.transform(F.array_sort(F.map_entries("_properties")), lambda e: F.struct(
        e["key"].alias("field"), read(e["value"]).alias("own")
    ))
    # each explode of one element keeps what is below it from being worked out again above it
    parsed = _parsed(df, schema).select(F.col(tool).alias("tool"), F.explode(F.array(ordered)).alias("_fields"))
    pairs = F.transform("_fields", lambda f: F.concat(json_string(f["field"]), F.lit(":"), f["own"]["default"]))
    parsed = parsed.where(F.col("_fields").isNotNull()).select("tool", "_fields", F.explode(F.array(pairs)).alias("_pairs"))
    fields = parsed.select("tool", "_pairs", F.posexplode("_fields").alias("_i", "_f")).select(
        "tool", F.col("_f.field").alias("field"), F.col("_f.own.enum").alias("_enum"),
        _type_group(F.col("_f.own.type")).alias("type_group"),
        F.concat(
            F.lit("{"), F.array_join(F.slice("_pairs", F.lit(1), F.col("_i")), ","), F.when(F.col("_i") > 0, ",").otherwise(""),
            json_string(F.col("_f.field")), F.lit(":"),
        ).alias("_before"),
        F.concat(
            F.when(F.col("_i") + 1 < F.size("_pairs"), ",").otherwise(""),
            F.array_join(F.slice("_pairs", F.col("_i") + 2, F.size("_pairs")), ","), F.lit("}"),
        ).alias("_after"),
    )
    declared = F.when((F.col("type_group") == "string") & F.col("_enum").isNotNull(), F.concat(
        F.transform("_enum", lambda v, i: entry(F.concat(F.lit("enum_valid:"), i.cast("string")), v)),
        F.array(entry(F.lit("enum_invalid"), F.lit(M.to_json_text(M.INVALID_ENUM)))),
    )).otherwise(F.array().cast("array<struct<label:string,value:string>>"))
    kept = ("tool", "field", "_before", "_after")
    if catalog is None:
        entries = F.concat(_catalog_entries(F.col("type_group")), declared)
        cases = fields.select(*kept, F.explode(entries).alias("m")).select(*kept, "m.label", "m.value")
    else:
        own = fields.select(*kept, F.explode(declared).alias("m")).select(*kept, "m.label", "m.value")
        cases = fields.join(catalog, "type_group").select(*kept, "label", "value").unionByName(own)
    return cases.select(
        "tool", "field", F.concat_ws(":", "field", "label").alias("label"), F.concat("_before", "value", "_after").alias("args")
    )


def base_cases(df: DataFrame, tool: str = "name", schema: str = "inputSchema") -> DataFrame:
    """tool, label, args of the cases that belong to the whole object.

    Empty and null arguments always; with declared properties also one case per
    required name left out, and one with an unknown extra field.
    """
    defaults = F.transform_values("_properties", lambda _, p: _default(p))
    entry = lambda label, args: F.struct(label.alias("label"), args.alias("args"))
    extra_name, extra_value = M.UNKNOWN_FIELD
    always = F.array(entry(F.lit("empty_args"), F.lit("{}")), entry(F.lit("null_args"), F.lit("null")))
    none = F.array().cast("array<struct<label:string,args:string>>")
    dropped = F.when(F.col("_defaults").isNotNull(), F.transform("_required", lambda r: entry(
        F.concat(F.lit("missing_required:"), r), _object(F.map_filter("_defaults", lambda k, _: k != r))
    )))
    unknown = F.when(F.size("_defaults") > 0, F.array(entry(F.lit("extra_unknown_field"), _object(F.map_concat(
        F.map_filter("_defaults", lambda k, _: k != extra_name),
        F.create_map(F.lit(extra_name), F.lit(M.to_json_text(extra_value))),
    )))))
    cases = F.concat(always, F.coalesce(dropped, none), F.coalesce(unknown, none))
    return (
        _parsed(df, schema)
        .select(F.col(tool).alias("tool"), "_required", defaults.alias("_defaults"))
        .select("tool", F.explode(cases).alias("c"))
        .select("tool", "c.label", "c.args")
    )


def all_cases(df: DataFrame, tool: str = "name", schema: str = "inputSchema") -> DataFrame:
    """Base and boundary cases together: tool, label, args."""
    return base_cases(df, tool, schema).unionByName(boundary_cases(df, tool, schema).drop("field"))
