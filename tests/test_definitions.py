import json

from tests.conftest import rows
from wardline.functions import jsontext as J
from wardline.operators import definitions, drift
from wardline.sources import readers

TOOLS = "name string, description string, inputSchema string, annotations string"


def tool(spark, description=None, schema=None, annotations=None):
    dump = lambda v: None if v is None else json.dumps(v)
    return spark.createDataFrame([("t", description, dump(schema), dump(annotations))], TOOLS)


def paths(df):
    return [r[0].split(":")[0] for r in rows(definitions.scan_tools(df), "matched_text")]


def test_schema_evidence_starts_with_the_path(spark):
    schema = {"properties": {"q": {"description": "you must", "title": "MANDATORY", "enum": ["a", "must first"]}}}
    assert paths(tool(spark, None, schema)) == [
        "inputSchema.properties.q.description", "inputSchema.properties.q.enum[1]", "inputSchema.properties.q.title",
    ]


def test_structural_keys_and_objects_in_content_arrays_are_not_text(spark):
    schema = {"type": "you must", "format": "you must", "required": ["you must"],
              "enum": [{"description": "you must"}], "description": {"note": "you must"}}
    assert paths(tool(spark, None, schema)) == []


def test_other_arrays_and_objects_are_entered(spark):
    schema = {"anyOf": [{"const": "you must"}], "description": {"title": "you must"}, "default": [["you must"]]}
    assert paths(tool(spark, None, schema)) == ["inputSchema.anyOf[0].const", "inputSchema.description.title"]


def test_a_bad_schema_has_no_texts(spark):
    df = spark.createDataFrame([("t", "you must", "not json", None)], TOOLS)
    assert rows(definitions.scan_tools(df), "signal") == [("imperative_override",)]


def test_both_walkers_agree(spark):
    docs = [{"title": "a", "x": [{"examples": ["b", 1, None, ["c"]]}, [[{"const": "d"}]]]}, ["e", {"pattern": "f"}], "g",
            {"enum": [["h"], {"title": "i"}], "properties": {"description": {"description": "j"}}}, 5, None]
    df = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "name string, inputSchema string")
    assert rows(J.walk_schema(df)) == rows(J.walk_schema_sql(df))


def test_annotation_contradictions(spark):
    def hints(description, annotations):
        found = definitions.scan_annotations(tool(spark, description, None, annotations))
        return rows(found, "matched_text", "severity")

    assert hints("Deletes files", {"readOnlyHint": True}) == [("readOnlyHint: true", "high")]
    assert hints("Adds a row", {"destructiveHint": False}) == [("destructiveHint: false", "high")]
    assert hints("Fetch a page", {"openWorldHint": False}) == [("openWorldHint: false", "medium")]
    assert hints("Shows the time", {"readOnlyHint": True, "openWorldHint": False}) == []
    assert hints("Deletes files", {"readOnlyHint": "true"}) == []
    assert hints("Deletes files", {"readOnlyHint": False, "destructiveHint": True}) == []
    assert hints("Deletes files", None) == []
    assert hints(None, {"readOnlyHint": True}) == []


def test_surfaces_without_description(spark):
    from wardline.operators.scan import scan_surface

    df = spark.createDataFrame([("a", None), ("b", "you must")], "name string, description string")
    assert rows(scan_surface(df), "tool_name") == [("b",)]
    assert readers.surfaces(df, df).count() == 2


def listing(spark, *tools):
    return spark.createDataFrame([("s", *t) for t in tools], "server string, " + TOOLS)


def test_drift(spark):
    base = listing(spark, ("a", "x", '{"p":1,"q":2}', None), ("b", "y", "{}", None), ("gone", "z", "{}", None))
    same = listing(spark, ("a", "x", '{"q":2, "p":1}', None), ("b", "y", "{}", None))
    names = lambda before, after, **o: [r[0] for r in rows(drift.definition_drift(before, after, **o), "tool_name")]
    assert names(base, same) == []
    changed = listing(spark, ("a", "x!", '{"p":1,"q":2}', None), ("b", "y", "{}", '{"readOnlyHint":true}'), ("new", "", "{}", None))
    assert names(base, changed) == ["a", "b", "new"]
    assert names(base, changed, group=["server"]) == ["a", "b", "new"]
    assert names(base.where("false"), changed) == []
    assert names(base.where("false"), changed, group=["server"]) == []
    null_and_empty = listing(spark, ("a", None, "{}", None)), listing(spark, ("a", "", "{}", None))
    assert names(*null_and_empty) == ["a"]


def test_json_helpers(spark):
    docs = [('{"b":1.0,"a":{"d":"x","c":["y\\n\\"z\\"","\\u00e9",{"k":"v:"}]},"e":":","":""}',), ("[1]",), ("oops",), (None,)]
    df = spark.createDataFrame(docs, "d string")
    got = df.select(J.canonical_json(df.d).alias("c"),
                    J.json_leaves(df.d).alias("l"), J.object_keys(df.d).alias("k")).collect()
    assert sorted(got[0].l) == sorted(["x", 'y\n"z"', "é", "v:", ":"])
    assert got[0].k == ["", "a", "b", "e"] and got[0].c.startswith('{"":"","a":{"c":')
    assert [tuple(r) for r in got[1:]] == [("[1]", [], []), (None, [], []), (None, [], [])]
