"""Readers. JSON documents become rows; JSON leaves stay JSON text columns.

One listing document is one row while it is read, as the format has a single
top-level value; collections of many documents, NDJSON and Parquet tables
spread over tasks as usual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.corpus import RECORD_SCHEMA, split_records

TOOL_COLUMNS = "name string, description string, inputSchema string, annotations string"
SUPPRESSION_SCHEMA = "tool string, signal string, reason string"
_STEP = "struct<tool:string,args:variant>"


def read_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per file: path, doc (the whole text)."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc")
    )


def _field(v: Column, name: str, as_text: bool) -> Column:
    if as_text:
        return F.try_variant_get(v, f"$.{name}", "string")
    return F.to_json(F.try_variant_get(v, f"$.{name}", "variant"))


def _refuse(what: str, text: Column, kind: str) -> Column:
    """Fails the job with a reason and the head of the text at fault, where it is evaluated."""
    return F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.substring(text, 1, 80), F.lit("null")))).cast(kind)


def listing_items(docs: DataFrame, field: str, doc: str = "doc", keep: Sequence[str] = ()) -> DataFrame:
    """Items of a listing, ``{field: [...]}`` or a bare array, as VARIANT column ``item``.

    A document that is unreadable or holds no such list fails the job, as a scan
    of half a listing would mislead.
    """
    v = F.parse_json(F.col(doc))
    items = F.coalesce(
        F.try_variant_get(v, f"$.{field}", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"),
        F.when(F.col(doc).isNotNull(), _refuse(f"a listing without {field}", F.col(doc), "array<variant>")),
    )
    return docs.select(*keep, F.explode(items).alias("item"))


def tools_from_documents(docs: DataFrame, doc: str = "doc", keep: Sequence[str] = ()) -> DataFrame:
    """keep, name, description, inputSchema, annotations, and the labels of ``_meta`` where there are any."""
    item = F.col("item")
    meta = lambda name: F.try_variant_get(item, f"$._meta.{name}", "string")
    return listing_items(docs, "tools", doc, keep).select(
        *keep,
        F.coalesce(_field(item, "name", True), _refuse("a tool without a name", F.to_json(item), "string")).alias("name"),
        _field(item, "description", True).alias("description"),
        _field(item, "inputSchema", False).alias("inputSchema"),
        F.nullif(_field(item, "annotations", False), F.lit("null")).alias("annotations"),
        F.coalesce(F.try_variant_get(item, "$._meta.is_attack", "boolean"), F.lit(False)).alias("is_attack"),
        meta("paradigm").alias("paradigm"),
        meta("risk_category").alias("risk_category"),
    )


def read_tools(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Tool definitions of listing documents."""
    return tools_from_documents(read_documents(spark, path)).drop("is_attack", "paradigm", "risk_category")


def read_labelled(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Tool definitions with is_attack (default false), paradigm and risk_category."""
    return tools_from_documents(read_documents(spark, path))


def surfaces(prompts: DataFrame | None = None, resources: DataFrame | None = None) -> DataFrame:
    """surface, name, description of prompts and resources; rows without a description have no text to scan."""
    parts = [
        df.select(F.lit(kind).alias("surface"), "name", "description")
        for kind, df in (("prompt", prompts), ("resource", resources)) if df is not None
    ]
    if not parts:
        raise ValueError("give prompts, resources or both")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.where(F.col("description").isNotNull())


def read_surfaces(spark: SparkSession, prompts: str | None = None, resources: str | None = None) -> DataFrame:
    """Surfaces from a prompts listing and a resources listing."""
    def rows(path: str | None, field: str) -> DataFrame | None:
        if path is None:
            return None
        item = F.col("item")
        return listing_items(read_documents(spark, path), field).select(
            _field(item, "name", True).alias("name"), _field(item, "description", True).alias("description")
        )

    return surfaces(rows(prompts, "prompts"), rows(resources, "resources"))


def response_texts(responses: DataFrame, content: str = "content", keep: Sequence[str] = ("tool",)) -> DataFrame:
    """One row per text block of tool results: keep, block (position), text."""
    return (
        responses.select(*keep, F.posexplode(content).alias("block", "_b"))
        .where(F.col("_b.type") == "text")
        .select(*keep, "block", F.col("_b.text").alias("text"))
    )


def read_records(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` attack records of all ``*.json`` files below the given folders.

    Files that are not JSON, or break the record rules, land in ``bad`` with
    their errors. Several folders give base and extra records together.
    """
    texts = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True)
        .text(list(paths))
    )
    return split_records(records_from_documents(texts, "value"))


def records_from_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Attack records from JSON texts, with ``type_errors``: fields of a wrong type, and texts that are no object.

    Types are strict: a number is no string, and a paradigm is an integer from 0 to 255.
    """
    v = F.try_parse_json(F.col(doc))
    raw = lambda name: F.to_json(F.try_variant_get(F.col("_v"), f"$.{name}", "variant"))
    fields, wrong = [], []
    for part in RECORD_SCHEMA.split(", "):
        name, kind = part.split(" ")
        there = raw(name).isNotNull() & (raw(name) != "null")
        value = F.try_variant_get(F.col("_v"), f"$.{name}", kind)
        if kind == "string":
            good = raw(name).startswith('"')
        elif kind.startswith("array"):
            good = raw(name).startswith("[") & value.isNotNull() & ~F.exists(value, lambda x: x.isNull())
            good = good & (F.size(F.try_variant_get(F.col("_v"), f"$.{name}", "array<variant>")) == F.size(
                F.regexp_extract_all(raw(name), F.lit(r'"(?:[^"\\]|\\.)*+"'), F.lit(0))
            ))
        else:
            good = raw(name).rlike("^[0-9]{1,3}$") & value.between(0, 255)
        wrong.append(F.when(there & ~F.coalesce(good, F.lit(False)), f"wrong type of {name}"))
        fields.append(F.when(good, value).alias(name))
    broken = F.when(~F.coalesce(F.to_json(F.col("_v")).startswith("{"), F.lit(False)), "not a JSON object")
    return docs.select(v.alias("_v")).select(*fields, F.array_compact(F.array(broken, *wrong)).alias("type_errors"))


def read_chains(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Chains (path, position, id, description, corpus_record_id, baseline, steps) in file name order.

    A document holds one chain or an array of chains. Arguments are JSON text.
    """
    return chains_from_documents(read_documents(spark, path)).orderBy("path", "position")


def _chain_items(docs: DataFrame) -> DataFrame:
    """path, position, item (VARIANT) of documents that hold a chain or an array of chains; item is null if unreadable."""
    v = F.try_parse_json(F.col("doc"))
    one_or_many = F.when(F.to_json(v).startswith("["), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    return docs.select("path", F.posexplode(one_or_many).alias("position", "item"))


def chain_errors(item: Column) -> Column:
    """What is wrong with a chain: an array of texts, empty for a good one.

    A chain needs an id and steps. Steps and baseline are arrays of objects with
    a tool; id, description, corpus_record_id and tool are strings. A field may be
    absent but for id and steps; only corpus_record_id may be null.
    """
    part = lambda name: F.to_json(F.try_variant_get(item, f"$.{name}", "variant"))
    is_text = lambda text: text.startswith('"')
    good_step = lambda s: F.coalesce(is_text(F.to_json(F.try_variant_get(s, "$.tool", "variant"))), F.lit(False))

    def steps(name: str) -> Column:
        listed = F.try_variant_get(item, f"$.{name}", "array<variant>")
        return F.when(listed.isNull(), F.lit(f"{name} is not an array")).when(~F.forall(listed, good_step), f"{name} has an entry without a tool")

    errors = [
        F.when(~F.coalesce(F.to_json(item).startswith("{"), F.lit(False)), "not a JSON object"),
        F.when(~F.coalesce(is_text(part("id")), F.lit(False)), "id is not a string"),
        F.when(~is_text(part("description")), "description is not a string"),
        F.when(~is_text(part("corpus_record_id")) & (part("corpus_record_id") != "null"), "corpus_record_id is not a string"),
        F.when(part("baseline").isNotNull(), steps("baseline")),
        steps("steps"),
    ]
    return F.when(errors[0].isNotNull(), F.array(errors[0])).otherwise(F.array_compact(F.array(*errors[1:])))


def broken_chains(docs: DataFrame) -> DataFrame:
    """path, position, errors of the chains of documents (path, doc) that ``chains_from_documents`` refuses."""
    return _chain_items(docs).select("path", "position", chain_errors(F.col("item")).alias("errors")).where(F.size("errors") > 0)


def chains_from_documents(docs: DataFrame) -> DataFrame:
    """The chains of documents (path, doc).

    A broken chain fails the job, as a chain without its steps would count as
    clean; ``broken_chains`` lists all of them.
    """
    steps = lambda name: F.coalesce(
        F.transform(
            F.try_variant_get(F.col("item"), f"$.{name}", f"array<{_STEP}>"),
            lambda s: F.struct(s["tool"].alias("tool"), F.coalesce(F.to_json(s["args"]), F.lit("null")).alias("args")),
        ),
        F.array().cast("array<struct<tool:string,args:string>>"),
    )
    text = lambda name: F.try_variant_get(F.col("item"), f"$.{name}", "string")
    errors = chain_errors(F.col("item"))
    checked = F.when(F.size(errors) == 0, text("id")).otherwise(
        _refuse("a broken chain", F.concat_ws(", ", errors, F.to_json("item")), "string"))
    return _chain_items(docs).select(
        "path", "position", checked.alias("id"), F.coalesce(text("description"), F.lit("")).alias("description"),
        text("corpus_record_id").alias("corpus_record_id"), steps("baseline").alias("baseline"), steps("steps").alias("steps"),
    )


def server_inventory(docs: DataFrame, doc: str = "doc", keep: Sequence[str] = ()) -> DataFrame:
    """server, command, args, spawn_command of configuration documents. Environment values are never read."""
    parsed = F.from_json(F.col(doc), "struct<mcpServers:map<string,struct<command:string,args:array<string>>>>")
    return (
        docs.select(*keep, F.explode(parsed["mcpServers"]).alias("server", "_c"))
        .select(
            *keep, "server", F.col("_c.command").alias("command"),
            F.coalesce("_c.args", F.array().cast("array<string>")).alias("args"),
        )
        .withColumn("spawn_command", F.concat_ws(" ", "command", "args"))
    )


def read_server_inventory(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Servers of configuration files, in name order."""
    return server_inventory(read_documents(spark, path)).orderBy("server")


def read_suppressions(spark: SparkSession, path: str) -> DataFrame:
    """Suppression table; a path that never held one is an empty table.

    A path with tables but no pointer to one of them fails, as an empty table
    would accept nothing that was accepted before.
    """
    from wardline.sources.sinks import suppression_versions

    found = suppression_versions(spark, path)
    if found:
        return spark.read.schema(SUPPRESSION_SCHEMA).parquet(f"{path}/{found[-1][1]}")
    make = spark._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.globStatus(make(f"{path}/table-*")):
        raise OSError(f"the suppression table at {path} was never put in place")
    return spark.createDataFrame([], SUPPRESSION_SCHEMA)
