"""Queries on text: primitives, needles, wording, similarity, annotations, schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as Q
from checks.inputs import cte, source, table
from wardline.functions import jsontext as J
from wardline.functions import severity as sev
from wardline.functions import text as T
from wardline.operators import corpus, definitions, drift, patterns, scan, tfidf
from wardline.rules import words as W
from wardline.sources import readers
from wardline.sources.staging import stage

CHECKS: dict = {}


def check(sql: str | None = None):
    """Register a query under its function name, with the SQL it must agree with."""
    def add(fn):
        CHECKS[fn.__name__] = (fn, sql)
        return fn

    return add


def flat(findings: DataFrame, *keys: str) -> DataFrame:
    """The columns of findings that the checks compare, references as text."""
    return findings.select(
        *keys, "tool_name", "signal", "severity", "pass", "matched_text", "detail",
        F.array_join("corpus_refs", ",").alias("refs"),
    )


_FLAT = "tool_name, signal, severity, pass, matched_text, detail, refs"


def surfaces(spark, sf):
    return source(spark, sf, "surfaces")


# ---- primitives ----

@check(f"WITH {cte('surfaces')} SELECT doc_id, {Q.lower('text')} AS lowered FROM surfaces")
def ascii_lower(spark, sf):
    return surfaces(spark, sf).select("doc_id", T.ascii_lower(F.col("text")).alias("lowered"))


@check(f"WITH {cte('surfaces')}, {Q.word_relations('surfaces', 'doc_id')} "
       "SELECT doc_id, array_to_string(w, '|') AS words, len(w) AS n FROM split")
def words(spark, sf):
    w = T.words(T.ascii_lower(F.col("text")))
    return surfaces(spark, sf).select("doc_id", w.alias("w")).select(
        "doc_id", F.array_join("w", "|").alias("words"), F.size("w").cast("bigint").alias("n")
    )


@check(f"""WITH {cte('surfaces')} SELECT doc_id, array_to_string(list_filter(
  string_split_regex({Q.lower('text')}, '[^0-9A-Za-z]+'),
  lambda t: length(t) >= 2 AND NOT list_contains({Q.listing(tfidf.A.STOP_WORDS)}, t)), ' ') AS terms FROM surfaces""")
def terms(spark, sf):
    return surfaces(spark, sf).select("doc_id", F.array_join(T.terms(T.ascii_lower(F.col("text"))), " ").alias("terms"))


@check(f"WITH {cte('surfaces')} SELECT doc_id, {Q.snippet('text', 'doc_id % 90 + 1', '7')} AS snippet FROM surfaces")
def snippet(spark, sf):
    start = (F.col("doc_id") % 90 + 1).cast("int")
    return surfaces(spark, sf).select("doc_id", T.snippet(F.col("text"), start, F.lit(7)).alias("snippet"))


@check(f"""WITH {cte('surfaces')}, t AS (SELECT doc_id, repeat('😀', CAST(doc_id % 40 AS INT)) || ' ' || text AS text FROM surfaces)
  SELECT doc_id, CAST({Q.word_start(Q.lower('text'), chr(39) + 'when' + chr(39))} AS INT) AS start FROM t""")
def word_start_behind_other_planes(spark, sf):
    """Places in whole texts with signs of two UTF-16 units in front are counted in characters."""
    text = F.concat(F.repeat(F.lit("😀"), (F.col("doc_id") % 40).cast("int")), F.lit(" "), "text")
    return surfaces(spark, sf).select("doc_id", T.word_start(T.ascii_lower(text), F.lit("when")).alias("start"))


@check(f"WITH {cte('surfaces')} SELECT doc_id, CAST({Q.word_start(Q.lower('text'), chr(39) + 'when' + chr(39))} AS INT) "
       "AS start FROM surfaces")
def word_start(spark, sf):
    return surfaces(spark, sf).select("doc_id", T.word_start(T.ascii_lower(F.col("text")), F.lit("when")).alias("start"))


@check(f"""WITH {cte('surfaces')} SELECT doc_id, substr(text, 1, 80) AS head,
  CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS head_ellipsis FROM surfaces""")
def heads(spark, sf):
    t = F.col("text")
    return surfaces(spark, sf).select("doc_id", T.head(t).alias("head"), T.head_ellipsis(t).alias("head_ellipsis"))


_FINGERPRINT = """list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, strlen(m)),
  lambda i: CAST(('0x' || substr(hex(encode(m)), CAST(i * 2 + 1 AS BIGINT), 2)) AS BIGINT))),
  lambda a, b: (a * 31 + b) & 4294967295)"""


@check(f"""WITH {cte('surfaces')}, s AS (SELECT doc_id, name, source, CASE WHEN doc_id % 50 = 0 THEN '' ELSE lang || ' é😀 ' || name END AS m FROM surfaces)
SELECT doc_id, name || '/' || 'stealth_language' AS finding_id,
  CASE WHEN m = '' THEN name || '/stealth_language'
    ELSE name || '/stealth_language/' || printf('%08x', {_FINGERPRINT}) END AS fingerprint,
  source || '/' || name AS tagged FROM s""")
def finding_id_and_fingerprint(spark, sf):
    name, signal = F.col("name"), F.lit("stealth_language")
    m = F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.concat("lang", F.lit(" é😀 "), "name"))
    return surfaces(spark, sf).withColumn("m", m).select(
        "doc_id", T.finding_id(name, signal).alias("finding_id"), T.fingerprint(name, signal, F.col("m")).alias("fingerprint"),
        T.tag_server(F.col("source"), name).alias("tagged"),
    )


@check(f"""WITH {cte('surfaces')}, {Q.pattern_values(scan.DESCRIPTION_PATTERNS)}, f AS ({Q.needle_rows('surfaces', 't.doc_id', 't.name')}),
  s AS (SELECT doc_id, tool_name, signal, matched_text AS m FROM f)
  SELECT doc_id, signal, tool_name || '/' || signal || '/' || printf('%08x', {_FINGERPRINT}) AS fingerprint FROM s""")
def fingerprint_of_evidence(spark, sf):
    """The fingerprint of each needle finding's evidence."""
    found = scan.scan_needles(surfaces(spark, sf), keep=["doc_id"])
    return found.select("doc_id", "signal", T.fingerprint(F.col("tool_name"), F.col("signal"), F.col("matched_text")).alias("fingerprint"))


@check()
def fingerprint_whole_text(spark, sf):
    """The fingerprint of each whole document; held against brute force in the tests, as SQL is too slow on whole texts."""
    name, signal = F.col("name"), F.lit("stealth_language")
    return surfaces(spark, sf).select("doc_id", T.fingerprint(name, signal, F.col("text")).alias("fingerprint"))


# ---- needles and wording ----

_PATTERNS = Q.pattern_values(scan.DESCRIPTION_PATTERNS)
_RESPONSES = Q.pattern_values(scan.RESPONSE_PATTERNS)


@check(f"WITH {cte('surfaces')}, {_PATTERNS} {Q.needle_rows('surfaces', 't.doc_id', 't.name')}")
def scan_needles_description(spark, sf):
    return flat(scan.scan_needles(surfaces(spark, sf), keep=["doc_id"]), "doc_id")


@check(f"WITH {cte('surfaces')}, {_PATTERNS} {Q.needle_rows('surfaces', 't.doc_id', 't.name')}")
def scan_needles_builtin_expressions(spark, sf):
    return flat(scan.scan_needles(surfaces(spark, sf), keep=["doc_id"], matcher="jvm"), "doc_id")


@check(f"WITH {cte('responses')}, {_RESPONSES} {Q.needle_rows('responses', 't.conv_id, t.turn', 't.tool')}")
def scan_needles_response(spark, sf):
    return flat(scan.scan_responses(source(spark, sf, "responses"), keep=["conv_id", "turn"]), "conv_id", "turn")


@check(f"WITH {cte('web_pages')}, {_RESPONSES} {Q.needle_rows('web_pages', 't.page_id', 't.tool')}")
def scan_needles_pages(spark, sf):
    return flat(scan.scan_responses(source(spark, sf, "web_pages"), keep=["page_id"]), "page_id")


_OWN = [scan.Pattern("the", "stealth_language", "info", (), "the"), scan.Pattern("ERE", "value_substitution", "low", ("X-1", "X-2"), "ere"),
        scan.Pattern("the", "session_persistence", "high", (), "again")]


@check(f"WITH {cte('surfaces')}, {Q.pattern_values(_OWN)} {Q.needle_rows('surfaces', 't.doc_id', 't.name')}")
def scan_needles_own_patterns(spark, sf):
    return flat(scan.scan_needles(surfaces(spark, sf), patterns=_OWN, keep=["doc_id"]), "doc_id")


_PATTERN_TABLE = """patterns AS (SELECT DISTINCT substr(p_name, 1, 3) AS needle, 'stealth_language' AS signal, 'low' AS severity,
    'stealth_language: ' || chr(39) || substr(p_name, 1, 3) || chr(39) AS detail, '' AS refs FROM part WHERE length(p_name) >= 3
  UNION SELECT DISTINCT 'xq' || CAST(p_partkey AS STRING), 'session_persistence', 'high',
    'session_persistence: ' || chr(39) || 'xq' || CAST(p_partkey AS STRING) || chr(39), '' FROM part)"""


@check(f"""WITH {cte('surfaces')}, p AS ({_PATTERN_TABLE.removeprefix('patterns AS (').removesuffix(')')}),
  patterns AS (SELECT {Q.lower('needle')} AS needle, signal, severity, detail, refs FROM p) {Q.needle_rows('surfaces', 't.doc_id', 't.name')}""")
def scan_pattern_table(spark, sf):
    """A pattern or two for each part, looked up by their grams."""
    part = table(spark, sf, "part")
    refs = F.array().cast("array<string>").alias("corpus_refs")
    short = part.where("length(p_name) >= 3").select(F.substring("p_name", 1, 3).alias("needle"), F.lit("stealth_language").alias("signal"), F.lit("low").alias("severity"), refs)
    keyed = part.select(F.concat(F.lit("xq"), F.col("p_partkey").cast("string")).alias("needle"), F.lit("session_persistence").alias("signal"), F.lit("high").alias("severity"), refs)
    found = patterns.scan_pattern_table(surfaces(spark, sf), short.unionByName(keyed).distinct(), "doc_id")
    return flat(found, "doc_id")


@check(f"""WITH l AS (SELECT doc_id, source, text, {Q.lower('text')} AS l FROM documents WHERE text IS NOT NULL),
  needles AS (SELECT DISTINCT substr(l, i, 24) AS needle FROM (SELECT l, unnest(range(1, length(l) - 22, 97)) AS i FROM l)),
  hits AS (SELECT doc_id, needle, min(i) AS i FROM (SELECT doc_id, i, substr(l, i, 24) AS needle FROM (SELECT doc_id, l, unnest(range(1, length(l) - 22)) AS i FROM l))
    JOIN needles USING (needle) GROUP BY ALL)
  SELECT doc_id, source AS tool_name, 'fragment: ' || chr(39) || needle || chr(39) AS detail, {Q.snippet('text', 'i', '24')} AS matched_text FROM hits JOIN l USING (doc_id)""")
def scan_pattern_table_of_fragments(spark, sf):
    """A pattern from every 97 characters of every document, searched in all documents."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    # one pass over a text: substring would read it from its start for each piece, and fold it again
    pieces = F.regexp_extract_all(T.ascii_lower(F.col("text")), F.lit("(?s)(.{24}).{0,73}"), F.lit(1))
    cut = docs.select(F.explode(pieces).alias("needle")).distinct()
    rules = stage(cut).select("needle", F.lit("fragment").alias("signal"), F.lit("low").alias("severity"), F.array().cast("array<string>").alias("corpus_refs"))
    found = patterns.scan_pattern_table(docs, rules, "doc_id", name="source", dense=True)
    return found.select("doc_id", "tool_name", "detail", "matched_text")


def _wording(pass_):
    rows = Q.structural_rows if pass_ in scan.STRUCTURAL else Q.verb_rows
    sql = f"WITH {cte('surfaces')}, {Q.word_relations('surfaces', 'doc_id')} {rows(pass_, 'doc_id', 'name')}"
    return sql, lambda spark, sf: flat(scan.scan_text(surfaces(spark, sf), passes=[pass_], keep=["doc_id"]), "doc_id")


for _pass in (*scan.STRUCTURAL, *scan.VERBS):
    _sql, _fn = _wording(_pass)
    CHECKS[_pass] = (_fn, _sql)


@check(f"""WITH {cte('surfaces')}, tf AS (SELECT lang AS position, term, count(*) AS n FROM (
  SELECT lang, unnest(list_filter(string_split_regex({Q.lower('text')}, '[^0-9A-Za-z]+'),
    lambda t: length(t) >= 2 AND NOT list_contains({Q.listing(tfidf.A.STOP_WORDS)}, t))) AS term FROM surfaces) GROUP BY ALL),
  dfs AS (SELECT term, count(DISTINCT position) AS df FROM tf GROUP BY term),
  i AS (SELECT term, ln((SELECT count(DISTINCT lang) FROM surfaces) / df) + 1 AS idf FROM dfs),
  raw AS (SELECT position, term, idf, n * idf AS r FROM tf JOIN i USING (term))
  SELECT position, term, round(idf, 6) AS idf, round(r / sqrt(sum(r * r) OVER (PARTITION BY position)), 6) AS weight FROM raw""")
def tfidf_fit(spark, sf):
    """Fit over texts grouped by language: the terms of each group are counted before any shuffle."""
    groups = surfaces(spark, sf)
    idf, weights = tfidf.fit(groups, position="lang")
    return weights.join(idf, "term").select(
        "position", "term", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight")
    )


_SIMILAR = f"""WITH {cte('surfaces')}, lowered AS (SELECT *, {Q.lower('text')} AS l FROM surfaces), {Q.model_relations()},
  {Q.similarity_relations('doc_id')}"""


@check(f"{_SIMILAR} {Q.similarity_rows('doc_id', 'name')}")
def tfidf_similarity(spark, sf):
    return flat(scan.scan_text(surfaces(spark, sf), passes=[scan.SIMILARITY], keep=["doc_id"]), "doc_id")


@check(f"{_SIMILAR} SELECT doc_id, a.label, a.signal, round(b.cosine, 6) AS cosine, a.refs FROM best b JOIN archetypes a USING (position)")
def tfidf_score_tables(spark, sf):
    got = tfidf.score(surfaces(spark, sf), tfidf.archetype_table(spark))
    return got.select("doc_id", "label", "signal", F.round("cosine", 6).alias("cosine"),
                      F.array_join("corpus_refs", ",").alias("refs"))


@check(f"WITH {Q.surfaces_findings()} SELECT doc_id, {_FLAT} FROM findings")
def scan_surface(spark, sf):
    return flat(scan.scan_surface(surfaces(spark, sf), description="text", keep=["doc_id"]), "doc_id")


# ---- responses, surfaces, tools ----

@check(f"WITH {cte('responses')} SELECT conv_id, turn, tool, b.block, b.text FROM responses, "
       "LATERAL (VALUES (CAST(0 AS INT), text), (CAST(2 AS INT), text || ' call this tool again')) b(block, text)")
def read_responses(spark, sf):
    return readers.response_texts(_contents(spark, sf), keep=("conv_id", "turn", "tool"))


def _contents(spark, sf):
    block = lambda kind, text, data: F.struct(
        F.lit(kind).alias("type"), text.alias("text"), data.alias("data"))
    none = F.lit(None).cast("string")
    return source(spark, sf, "responses").withColumn("content", F.array(
        block("text", F.col("text"), none),
        block("image", none, F.lit("ignore previous instructions")),
        block("text", F.concat("text", F.lit(" call this tool again")), none),
    ))


@check(f"""WITH {cte('responses')}, {_RESPONSES}, blocks AS (SELECT conv_id, turn, tool, b.block, b.text FROM responses,
  LATERAL (VALUES (CAST(0 AS INT), text), (CAST(2 AS INT), text || ' call this tool again')) b(block, text))
  {Q.needle_rows('blocks', 't.conv_id, t.turn, t.block', 't.tool')}""")
def scan_response_blocks(spark, sf):
    blocks = readers.response_texts(_contents(spark, sf), keep=("conv_id", "turn", "tool"))
    keys = ["conv_id", "turn", "block"]
    return flat(scan.scan_responses(blocks, keep=keys), *keys)


@check(f"""WITH {cte('tools', 'records')} SELECT 'prompt' AS surface, name, description FROM tools WHERE description IS NOT NULL
  UNION ALL SELECT 'resource', id, expected_behavior FROM records WHERE expected_behavior IS NOT NULL""")
def read_surfaces(spark, sf):
    resources = source(spark, sf, "records").selectExpr("id AS name", "expected_behavior AS description")
    return readers.surfaces(source(spark, sf, "tools"), resources)


_WALK = f"""SELECT t.p_partkey, t.name, 'inputSchema' || replace(substr(j.fullkey, 2), '"', '') AS path, json_extract_string(j.json, j.fullkey) AS text
  FROM tools t, json_tree(CAST(t.inputSchema AS JSON)) j
  WHERE t.inputSchema IS NOT NULL AND j.type = 'VARCHAR'
    AND NOT regexp_matches(j.fullkey, '\\.({'|'.join(W.CONTENT_KEYS)})\\[[0-9]+\\][.\\[]')
    AND regexp_matches(j.fullkey, '\\.({'|'.join(W.CONTENT_KEYS)})(\\[[0-9]+\\])?$')"""


@check(f"WITH {cte('tools')} SELECT p_partkey, path, text FROM ({_WALK})")
def walk_schema(spark, sf):
    return J.walk_schema(source(spark, sf, "tools"), keep=["p_partkey"])


@check(f"WITH {cte('tools')} SELECT p_partkey, path, text FROM ({_WALK})")
def walk_schema_recursive_sql(spark, sf):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the whole table, whatever its size
    return J.walk_schema_sql(source(spark, sf, "tools"), keep=["p_partkey"])


_SCHEMA_SCAN = f"""{cte('tools')}, walked AS (SELECT p_partkey || path AS k, p_partkey, name, path, text FROM ({_WALK})),
  {Q.scan_relations('walked', 'k', 'name', 'raw_found')},
  schema_found AS (SELECT p_partkey, f.tool_name, f.signal, f.severity, f.pass, w.path || ': ' || f.matched_text AS matched_text,
    f.detail, f.refs FROM raw_found f JOIN walked w USING (k))"""


@check(f"WITH {_SCHEMA_SCAN} SELECT * FROM schema_found")
def scan_schema_text(spark, sf):
    return flat(definitions.scan_schema_text(source(spark, sf, "tools"), keep=["p_partkey"]), "p_partkey")


def _annotation_rows() -> str:
    out = []
    for hint, value, listed, severity in W.ANNOTATION_RULES:
        out.append(f"""SELECT p_partkey, name AS tool_name, 'annotation_deception' AS signal, '{severity}' AS severity,
          'annotations' AS pass, '{hint}: {value}' AS matched_text,
          'Hint {hint}={value} does not fit what the description says the tool does' AS detail, '' AS refs
          FROM tools WHERE annotations IS NOT NULL AND CAST(json_extract(annotations, '$.{hint}') AS VARCHAR) = '{value}'
          AND len(list_filter({Q.listing(listed)}, lambda w: contains({Q.lower('description')}, w))) > 0""")
    return " UNION ALL ".join(out)


@check(f"WITH {cte('tools')} {_annotation_rows()}")
def annotation_hints(spark, sf):
    return flat(definitions.scan_annotations(source(spark, sf, "tools"), keep=["p_partkey"]), "p_partkey")


_OWN_TEXTS = "own AS (SELECT p_partkey || '' AS k, p_partkey, name, NULL AS path, description AS text FROM tools WHERE description IS NOT NULL)"


@check(f"""WITH {cte('tools')}, {_OWN_TEXTS}, texts AS (SELECT * FROM own UNION ALL SELECT p_partkey || path, p_partkey, name, path, text FROM ({_WALK})),
  {Q.scan_relations('texts', 'k', 'name', 'raw_found')}
  SELECT p_partkey, f.tool_name, f.signal, f.severity, f.pass, coalesce(w.path || ': ', '') || f.matched_text AS matched_text,
    f.detail, f.refs FROM raw_found f JOIN texts w USING (k) UNION ALL {_annotation_rows()}""")
def scan_tools(spark, sf):
    return flat(definitions.scan_tools(source(spark, sf, "tools"), keep=["p_partkey"]), "p_partkey")


@check(f"""WITH {cte('records')}, peers AS (SELECT id, 'peer_' || translate(lower(id), '-.', '__') AS name, payload AS text FROM records WHERE paradigm IS NOT NULL),
  {Q.scan_relations('peers', 'id', 'name')}
  SELECT tool_name, signal, severity, pass, matched_text, '[peer-inject: ' || id || '] ' || detail AS detail, refs FROM findings
  UNION ALL SELECT name, 'unexpected_tool_sequence', 'high', 'sequence', 'call to ' || name || ' has no counterpart in the baseline run',
    '[peer-inject: ' || id || '] chain step 1: ' || name || '()', '' FROM peers""")
def corpus_selfscan(spark, sf):
    return flat(corpus.corpus_selfscan(source(spark, sf, "records")))


_CANON = "to_json(struct_pack(a := json_extract(inputSchema, '$.a'), b := json_extract(inputSchema, '$.b')))"


@check(f"""WITH {cte('listing_before', 'listing_after')}, b AS (SELECT *, {_CANON} AS c FROM listing_before),
  a AS (SELECT *, {_CANON} AS c FROM listing_after)
  SELECT a.server, a.name AS tool_name, 'conditional_activation' AS signal, 'critical' AS severity FROM a
  LEFT JOIN b ON a.server = b.server AND a.name = b.name
  WHERE a.server IN (SELECT server FROM b) AND (b.name IS NULL OR b.description <> a.description OR b.c <> a.c
    OR b.annotations IS DISTINCT FROM a.annotations)""")
def definition_drift(spark, sf):
    got = drift.definition_drift(source(spark, sf, "listing_before"), source(spark, sf, "listing_after"), group=["server"])
    return got.select("server", "tool_name", "signal", "severity")


FIRST_LISTINGS = "2024-01-08"


def listing_versions(spark, sf):
    """First listings, and later ones of the same definitions, which often change."""
    versions = source(spark, sf, "listing_versions").withColumn("ts", F.col("ts").cast("timestamp"))
    return versions.where(F.col("ts") < FIRST_LISTINGS), versions.where(F.col("ts") >= FIRST_LISTINGS)


@check(f"""WITH {cte('listing_versions')}, v AS (SELECT *, description || '|' || inputSchema AS d FROM listing_versions),
  b AS (SELECT server, name, arg_max(d, ts) AS d FROM v WHERE ts < TIMESTAMP '{FIRST_LISTINGS}' GROUP BY ALL),
  u AS (SELECT server, name, ts, d FROM v WHERE ts >= TIMESTAMP '{FIRST_LISTINGS}' UNION ALL SELECT server, name, NULL, d FROM b),
  w AS (SELECT *, lag(d) OVER (PARTITION BY server, name ORDER BY ts NULLS FIRST) AS o FROM u)
  SELECT server, name AS tool_name, epoch_us(ts) AS micros FROM w WHERE ts IS NOT NULL AND (d <> o OR (o IS NULL AND server IN (SELECT server FROM b)))""")
def definition_changes(spark, sf):
    first, later = listing_versions(spark, sf)
    return drift.definition_changes(later, first).select("server", "tool_name", F.unix_micros("ts").alias("micros"))


@check(f"""WITH {cte('surfaces')}, {_PATTERNS}, {Q.rules_values()}, f AS ({Q.needle_rows('surfaces', 't.doc_id', 't.name')})
  SELECT doc_id, signal, rule_id, severity, {Q.rank('severity')} AS severity_rank, description, tags,
  CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'none' END AS level
  FROM f JOIN rules USING (signal)""")
def rule_lookup(spark, sf):
    found = scan.scan_needles(surfaces(spark, sf), keep=["doc_id"]).drop("rule_id")
    return sev.rule_lookup(found).select(
        "doc_id", "signal", "rule_id", "severity", "severity_rank", "description", F.array_join("tags", ",").alias("tags"),
        sev.sarif_level(F.col("severity")).alias("level"),
    )
