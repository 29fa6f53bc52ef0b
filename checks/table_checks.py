"""Queries on findings tables, labels, records, upstream documents, cases and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import sql as Q
from checks import text_checks
from checks.inputs import cte, source, table
from wardline.operators import cases, corpus, evaluate, label, scan, suppress
from wardline.plans import reports
from wardline.rules import labels as L
from wardline.rules import mutations as M
from wardline.rules import records as R
from wardline.rules import signals as S
from wardline.sources import readers, sinks
from wardline.sources.staging import shared_folder, stage

CHECKS: dict = {}


def check(sql: str | None = None):
    def add(fn):
        CHECKS[fn.__name__] = (fn, sql)
        return fn

    return add


def surfaces(spark, sf):
    return source(spark, sf, "surfaces")


def found(spark, sf, *keep):
    return scan.scan_surface(surfaces(spark, sf), description="text", keep=keep)


def labelled(spark, sf):
    """Documents with a toxicity label, under their surface name."""
    return surfaces(spark, sf).select("doc_id", "name", "lang", "source").join(
        table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_attack")), "doc_id"
    )


_FOUND = f"WITH {Q.surfaces_findings()}"
_LABELLED = """labelled AS (SELECT s.doc_id, s.name, s.lang, s.source, l.toxic = 1 AS is_attack FROM surfaces s JOIN labels l USING (doc_id)),
  marked AS (SELECT *, name IN (SELECT tool_name FROM findings) AS hit FROM labelled)"""
_CONFUSION = """counts AS (SELECT count(*) AS tools_total, count(*) FILTER (WHERE is_attack AND hit) AS tp,
  count(*) FILTER (WHERE NOT is_attack AND hit) AS fp, count(*) FILTER (WHERE is_attack AND NOT hit) AS fn,
  count(*) FILTER (WHERE NOT is_attack AND NOT hit) AS tn FROM marked)"""
_REPORT = """pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM counts),
  report AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


# ---- evaluation ----

@check(f"{_FOUND} SELECT signal, severity, count(*) AS findings, count(DISTINCT tool_name) AS names FROM findings GROUP BY ALL")
def findings_by_signal(spark, sf):
    return found(spark, sf).groupBy("signal", "severity").agg(
        F.count("*").alias("findings"), F.count_distinct("tool_name").alias("names")
    )


@check(f"{_FOUND}, {_LABELLED}, {_CONFUSION} SELECT * FROM counts")
def confusion(spark, sf):
    return evaluate.confusion(labelled(spark, sf), found(spark, sf))


@check(f"""{_FOUND}, {_LABELLED}, {_CONFUSION}, {_REPORT} SELECT tools_total, tp, fp, fn, tn, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report""")
def precision_recall_f1(spark, sf):
    r = evaluate.benchmark_report(labelled(spark, sf), found(spark, sf))
    return r.select("tools_total", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@check(f"{_FOUND}, {_LABELLED}, {_CONFUSION}, {_REPORT} SELECT recall >= 1.0 AND precision >= 0.9 AS passed, recall >= 0.5 AND precision >= 0.01 AS passed_low FROM report")
def regression_gate(spark, sf):
    r = evaluate.benchmark_report(labelled(spark, sf), found(spark, sf))
    strict = evaluate.regression_gate(r)
    return evaluate.regression_gate(
        strict.withColumnRenamed("passed", "strict"), min_recall=0.5, min_precision=0.01
    ).select(F.col("strict").alias("passed"), F.col("passed").alias("passed_low"))


def _rate(group: str, name: str) -> str:
    return f"""{_FOUND}, {_LABELLED} SELECT {group} AS {name}, count(*) AS total, count(*) FILTER (WHERE hit) AS detected,
      round(count(*) FILTER (WHERE hit) * 100 / count(*), 6) AS percent FROM marked GROUP BY 1"""


@check(_rate("lang", "paradigm"))
def rate_by_paradigm(spark, sf):
    r = evaluate.rate_by_paradigm(labelled(spark, sf), found(spark, sf), paradigm="lang")
    return r.withColumn("percent", F.round("percent", 6))


@check(_rate("coalesce(nullif(source, 'src3'), 'Unknown')", "risk_category"))
def rate_by_risk(spark, sf):
    rows = labelled(spark, sf).withColumn("risk_category", F.nullif("source", F.lit("src3")))
    return evaluate.rate_by_risk(rows, found(spark, sf)).withColumn("percent", F.round("percent", 6))


@check(f"{_FOUND} SELECT severity, count(*) AS findings FROM findings GROUP BY severity")
def severity_histogram(spark, sf):
    return evaluate.severity_histogram(found(spark, sf))


@check(f"""{_FOUND}, {_LABELLED} SELECT count(*) AS clean_total, count(*) FILTER (WHERE hit) AS flagged,
  round(count(*) FILTER (WHERE hit) / count(*), 6) AS rate FROM marked WHERE NOT is_attack""")
def false_positive_rate(spark, sf):
    return evaluate.false_positive_rate(labelled(spark, sf), found(spark, sf)).withColumn("rate", F.round("rate", 6))


@check(f"""WITH {Q.surfaces_findings()}, {cte('servers')} SELECT s.server, count(f.tool_name) AS findings
  FROM (SELECT DISTINCT server FROM servers) s LEFT JOIN (SELECT source, tool_name FROM findings JOIN surfaces USING (doc_id)) f ON f.source = s.server
  GROUP BY s.server""")
def per_server_counts(spark, sf):
    return evaluate.per_server_counts(
        source(spark, sf, "servers"), found(spark, sf, "source").withColumnRenamed("source", "server")
    )


# ---- suppression ----

_MARKED = f"""WITH {Q.surfaces_findings()}, {cte('entries')},
  kept AS (SELECT f.*, EXISTS (SELECT 1 FROM entries e WHERE e.tool = f.tool_name AND e.signal = f.signal) AS suppressed FROM findings f)"""


def marked(spark, sf):
    return suppress.apply_suppressions(found(spark, sf, "doc_id"), source(spark, sf, "entries"))


@check(f"{_MARKED} SELECT doc_id, tool_name, signal, matched_text, suppressed FROM kept")
def apply_suppressions(spark, sf):
    return marked(spark, sf).select("doc_id", "tool_name", "signal", "matched_text", "suppressed")


@check(f"""{_MARKED} SELECT e.tool, e.signal, e.reason FROM entries e
  WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.tool_name = e.tool AND f.signal = e.signal)""")
def stale_suppressions(spark, sf):
    return suppress.stale_suppressions(source(spark, sf, "entries"), found(spark, sf))


@check(f"""WITH {cte('entries', 'new_entries')}, taken AS (SELECT n.*, EXISTS (SELECT 1 FROM entries e WHERE e.tool = n.tool AND e.signal = n.signal) AS rejected FROM new_entries n)
  SELECT *, false AS rejected FROM entries UNION ALL SELECT * FROM taken""")
def add_suppressions(spark, sf):
    entries, rejected = suppress.add_suppressions(source(spark, sf, "entries"), source(spark, sf, "new_entries"))
    return entries.withColumn("rejected", F.lit(False)).unionByName(rejected.withColumn("rejected", F.lit(True)))


@check(f"""WITH {cte('entries', 'new_entries')} SELECT *, 2 AS version FROM entries
  UNION ALL SELECT *, 2 FROM new_entries n WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.tool = n.tool AND e.signal = n.signal)""")
def suppressions_round_trip(spark, sf):
    """A suppression table written, read, added to and read again."""
    path = f"{shared_folder(spark)}/suppressions-{uuid.uuid4().hex}"
    sinks.write_suppressions(source(spark, sf, "entries"), path)
    sinks.update_suppressions(spark, path, source(spark, sf, "new_entries"))
    return readers.read_suppressions(spark, path).withColumn("version", F.lit(sinks.suppression_version(spark, path)))


@check(f"""{_MARKED} SELECT count(*) FILTER (WHERE NOT suppressed) AS active, count(*) FILTER (WHERE suppressed) AS suppressed,
  (SELECT count(*) FROM surfaces) AS tools_scanned FROM kept""")
def scan_totals(spark, sf):
    return evaluate.scan_totals(marked(spark, sf), surfaces(spark, sf))


@check(f"""{_MARKED} SELECT count(*) FILTER (WHERE NOT suppressed) AS active, count(*) FILTER (WHERE suppressed) AS suppressed,
  (SELECT count(*) FROM surfaces) AS tools_scanned FROM kept""")
def scan_totals_in_one_pass(spark, sf):
    """The totals of a scan, its rows counted while they are scanned."""
    return reports.scan_with_totals(surfaces(spark, sf), lambda rows: scan.scan_surface(rows, description="text"), source(spark, sf, "entries"))[1]


@check(f"""{_MARKED} SELECT bool_or(NOT suppressed AND severity IN ('high', 'critical')) AS blocking,
  coalesce(bool_or(NOT suppressed AND severity = 'critical') FILTER (WHERE signal = 'fake_prerequisite'), false) AS blocking_one FROM kept""")
def gate(spark, sf):
    rows = marked(spark, sf)
    one = evaluate.gate(rows.where(F.col("signal") == "fake_prerequisite"), "critical")
    return evaluate.gate(rows).withColumn("blocking_one", one.scalar())


# ---- reports ----

@check(f"""{_MARKED} SELECT tool_name AS tool, signal, severity, matched_text AS matched, detail, refs AS corpus_refs, suppressed FROM kept""")
def findings_json(spark, sf):
    rows = sinks.findings_json(marked(spark, sf))
    return rows.withColumn("corpus_refs", F.array_join("corpus_refs", ","))


@check(f"""{_MARKED}, totals AS (SELECT count(*) FILTER (WHERE NOT suppressed) AS a, count(*) FILTER (WHERE suppressed) AS s, (SELECT count(*) FROM surfaces) AS n FROM kept)
  SELECT CAST(0 AS INT) AS section, '' AS tool_name, '' AS signal, a || ' finding(s) in ' || n || ' tool(s):' || chr(10) AS text FROM totals
  UNION ALL SELECT 2, '', '', s || ' suppressed finding(s):' FROM totals WHERE s > 0
  UNION ALL SELECT CASE WHEN suppressed THEN 3 ELSE 1 END, tool_name, signal, CASE WHEN suppressed THEN '  [suppressed] ' || tool_name || ' — ' || signal
    ELSE '[' || severity || '] ' || tool_name || ' — ' || signal || ' (' || detail || ')' || chr(10) || '  matched: ' || matched_text ||
      CASE WHEN refs <> '' THEN chr(10) || '  refs:    ' || replace(refs, ',', ', ') ELSE '' END || chr(10) END FROM kept""")
def findings_report(spark, sf):
    return sinks.findings_report(stage(marked(spark, sf)), surfaces(spark, sf))


_SARIF_LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'none' END"


@check(f"""{_MARKED}, {Q.rules_values()} SELECT doc_id, rule_id, {_SARIF_LEVEL} AS level, detail || ': ' || matched_text AS message,
  tool_name AS location, suppressed FROM kept JOIN rules USING (signal)""")
def sarif_results(spark, sf):
    shape = ("ruleId string, level string, message struct<text:string>, "
             "locations array<struct<logicalLocations:array<struct<name:string,kind:string>>>>, "
             "suppressions array<struct<kind:string>>")
    r = sinks.sarif_results(marked(spark, sf)).withColumn("r", F.from_json("result", shape))
    return r.select(
        "doc_id", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), F.col("r.message.text").alias("message"),
        F.col("r.locations")[0]["logicalLocations"][0]["name"].alias("location"), F.col("r.suppressions").isNotNull().alias("suppressed"),
    )


@check(f"""{_MARKED}, {Q.rules_values()}, r AS (SELECT CAST(doc_id % 7 AS STRING) AS run_id, rule_id, {_SARIF_LEVEL} AS level,
    detail || ': ' || matched_text AS message, tool_name AS location, suppressed FROM kept JOIN rules USING (signal))
  SELECT run_id, 1 AS part, 0 AS rules, rule_id, level, message, location, suppressed FROM r
  UNION ALL SELECT DISTINCT run_id, 0, {len(S.SIGNALS)}, NULL, NULL, NULL, NULL, false FROM r
  UNION ALL SELECT DISTINCT run_id, 3, 0, NULL, NULL, NULL, NULL, false FROM r""")
def sarif_documents(spark, sf):
    """Every line of every run's document, read as JSON: results (all but one per run behind a comma), opening, closing."""
    run = marked(spark, sf).withColumn("run", F.col("doc_id") % 7)
    lines = sinks.sarif_documents(stage(run), "run")
    shape = ("ruleId string, level string, message struct<text:string>, "
             "locations array<struct<logicalLocations:array<struct<name:string,kind:string>>>>, "
             "suppressions array<struct<kind:string>>")
    opening = "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>>>"
    result = F.from_json(F.when(F.col("part") == 2, F.expr("substring(line, 2)")).when(F.col("part") == 1, F.col("line")), shape)
    rules = F.size(F.from_json(F.when(F.col("part") == 0, F.concat("line", F.lit("]}]}"))), opening)["runs"][0]["tool"]["driver"]["rules"])
    r = lines.withColumns({"r": result, "rules": F.when(F.col("part") == 0, rules).otherwise(0)})
    return r.select(
        "run_id", F.when(F.col("part") == 2, 1).otherwise(F.col("part")).alias("part"), "rules", F.col("r.ruleId").alias("rule_id"),
        F.col("r.level").alias("level"), F.col("r.message.text").alias("message"),
        F.col("r.locations")[0]["logicalLocations"][0]["name"].alias("location"),
        F.coalesce(F.col("r.suppressions").isNotNull(), F.lit(False)).alias("suppressed"),
    )


@check(f"""{_FOUND}, {_LABELLED}, {_CONFUSION}, {_REPORT} SELECT unnest([
    'Benchmark results (' || tools_total || ' tools):', '', '  True positives:  ' || tp, '  False positives: ' || fp,
    '  False negatives: ' || fn, '  True negatives:  ' || tn, '', '  Precision: ' || format('{{:.3f}}', CAST(precision AS DOUBLE)),
    '  Recall:    ' || format('{{:.3f}}', CAST(recall AS DOUBLE)), '  F1:        ' || format('{{:.3f}}', CAST(f1 AS DOUBLE))]) AS text FROM report""")
def benchmark_lines(spark, sf):
    return sinks.benchmark_lines(evaluate.benchmark_report(labelled(spark, sf), found(spark, sf))).select("text")


@check(f"""{_FOUND}, {_LABELLED}, {_CONFUSION}, {_REPORT} SELECT tools_total, tp, fp, fn, tn, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report""")
def benchmark_json(spark, sf):
    doc = sinks.benchmark_json(evaluate.benchmark_report(labelled(spark, sf), found(spark, sf)))
    shape = "tools_total long, tp long, fp long, fn long, tn long, precision double, recall double, f1 double"
    r = doc.select(F.from_json("report", shape).alias("r")).select("r.*")
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# ---- records ----

def records(spark, sf, name="records"):
    """Records with their two array columns; every fourth new or old record lacks its tags."""
    some = F.split("category", "_")
    return source(spark, sf, name).select(
        "*", some.alias("detection_signals"), F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("string").alias("cve"), F.when(~F.col("id").like("%3"), some).alias("tags"),
    )


_ERRORS = f"""concat_ws('|', CASE WHEN expected_behavior IS NULL THEN 'missing expected_behavior' END,
  CASE WHEN id LIKE '%3' THEN 'missing tags' END,
  CASE WHEN category NOT IN ({', '.join(Q.quote(c) for c in R.CATEGORIES)}) THEN 'unknown category ' || category END,
  CASE WHEN vector NOT IN ({', '.join(Q.quote(c) for c in R.VECTORS)}) THEN 'unknown vector ' || vector END,
  CASE WHEN severity NOT IN ({', '.join(Q.quote(c) for c in S.SEVERITIES)}) THEN 'unknown severity ' || severity END)"""


@check(f"WITH {cte('records')} SELECT id, {_ERRORS} AS errors, {_ERRORS} = '' AS valid FROM records")
def validate_records(spark, sf):
    return corpus.validate_records(records(spark, sf)).select("id", F.array_join("errors", "|").alias("errors"), "valid")


@check(f"""WITH {cte('records', 'new_records')}, latest AS (SELECT * FROM (SELECT *, 1 AS age FROM new_records UNION ALL SELECT *, 0 FROM records)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY age DESC) = 1) SELECT id, version, category, coalesce(CAST(paradigm AS VARCHAR), '-') AS paradigm, payload FROM latest""")
def add_records(spark, sf):
    got = corpus.add_records(records(spark, sf), records(spark, sf, "new_records"))
    paradigm = F.coalesce(F.col("paradigm").cast("string"), F.lit("-"))
    return got.select("id", "version", "category", paradigm.alias("paradigm"), "payload")


@check(f"""WITH {cte('records', 'new_records')}, b AS (SELECT * FROM records UNION ALL SELECT * FROM new_records)
  SELECT id, category, severity, coalesce(CAST(paradigm AS VARCHAR), '-') AS paradigm, subcategory FROM b
  WHERE category = 'protocol' AND severity IN ('low', 'medium', 'high', 'critical')""")
def extend_and_list_corpus(spark, sf):
    both = corpus.extend_corpus(records(spark, sf), records(spark, sf, "new_records"))
    return corpus.corpus_list(both, category="protocol", severity="low")


@check(f"""WITH {cte('records')} SELECT id, category, severity, coalesce(CAST(paradigm AS VARCHAR), '-') AS paradigm, subcategory FROM records
  WHERE severity IN ('high', 'critical')""")
def corpus_min_severity(spark, sf):
    return corpus.corpus_list(records(spark, sf), severity="high")


# ---- labels ----

def _spellings(aliases: dict, key: str) -> str:
    """CASE over the known spellings with odd case and blanks, and one unknown."""
    names = list(aliases)
    whens = " ".join(f"WHEN {i} THEN ' {n.title()} '" for i, n in enumerate(names))
    return f"CASE {key} % {len(names) + 1} {whens} ELSE 'Odd-' || CAST({key} AS STRING) END"


def _alias_sql(aliases: dict) -> str:
    raw = _spellings(aliases, "doc_id")
    return f"""WITH {Q.values(list(aliases.items()), 'aliases', 'spelling, alias_name')}, r AS (SELECT doc_id, {raw} AS raw FROM documents)
      SELECT doc_id, coalesce(alias_name, raw) AS alias FROM r LEFT JOIN aliases ON spelling = lower(trim(raw))"""


@check(_alias_sql(L.PARADIGM_ALIASES))
def paradigm_alias(spark, sf):
    raw = F.expr(_spellings(L.PARADIGM_ALIASES, "doc_id"))
    return table(spark, sf, "documents").select("doc_id", label.paradigm_alias(raw).alias("alias"))


@check(_alias_sql(L.RISK_ALIASES))
def risk_alias(spark, sf):
    raw = F.expr(_spellings(L.RISK_ALIASES, "doc_id"))
    return table(spark, sf, "documents").select("doc_id", label.risk_alias(raw).alias("alias"))


def _paradigm_case(text: str) -> str:
    any_of = lambda ps: Q.quote("(?i)" + "|".join(ps))
    return f"""CASE WHEN regexp_matches({text}, {any_of(L.ARGUMENT_HIJACKING_PATTERNS)}) THEN 'argument-hijacking'
      WHEN regexp_matches({text}, {any_of(L.FAKE_ENABLING_PATTERNS)}) THEN 'fake-enabling-prerequisite' ELSE 'unrelated-prerequisite' END"""


def _risk_case(text: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({text}), {Q.quote('|'.join(ps))}) THEN '{c}'" for c, ps in L.RISK_PATTERNS)
    return f"CASE {whens} END"


@check(f"WITH {cte('surfaces')} SELECT doc_id, {_paradigm_case('text')} AS paradigm FROM surfaces")
def paradigm_heuristic(spark, sf):
    return surfaces(spark, sf).select("doc_id", label.paradigm_heuristic(F.col("text")).alias("paradigm"))


@check(f"WITH {cte('surfaces')} SELECT doc_id, {_risk_case('text')} AS risk FROM surfaces")
def risk_heuristic(spark, sf):
    return surfaces(spark, sf).select("doc_id", label.risk_heuristic(F.col("text")).alias("risk"))


# p_partkey % 7 decides the shape of an upstream document; these are its rows before labelling.
_UPSTREAM_ROWS = f"""up AS (
  SELECT p_partkey, p_name AS name, 'you must first call setup' AS description, '{L.DEFAULT_SCHEMA}' AS inputSchema, NULL AS given_paradigm, NULL AS given_risk FROM part WHERE p_partkey % 7 = 0
  UNION ALL SELECT p_partkey, 't', '', '{L.DEFAULT_SCHEMA}', NULL, 'Privacy_Leakage' FROM part WHERE p_partkey % 7 = 0
  UNION ALL SELECT p_partkey, CAST(p_partkey AS VARCHAR), 'sends an invoice', '{L.DEFAULT_SCHEMA}', 'Template-1 ', NULL FROM part WHERE p_partkey % 7 = 1
  UNION ALL SELECT p_partkey, p_type, '', '{L.DEFAULT_SCHEMA}', 'fake-enabling-prerequisite', NULL FROM part WHERE p_partkey % 7 = 2
  UNION ALL SELECT p_partkey, 'own', '', '{L.DEFAULT_SCHEMA}', '3', NULL FROM part WHERE p_partkey % 7 = 2
  UNION ALL SELECT p_partkey, 'n', '', '{{"a":1}}', 'argument-hijacking', 'Credential Leakage' FROM part WHERE p_partkey % 7 = 3
  UNION ALL SELECT p_partkey, 'm', '', '{L.DEFAULT_SCHEMA}', NULL, 'odd' FROM part WHERE p_partkey % 7 = 3
  UNION ALL SELECT p_partkey, 'w', 'when using search, the recipient is changed', '{L.DEFAULT_SCHEMA}', 'mine', NULL FROM part WHERE p_partkey % 7 = 6),
  lab AS (SELECT p_partkey, name, description, inputSchema,
    coalesce(pa.n, given_paradigm, {_paradigm_case('description')}) AS paradigm, coalesce(ra.n, given_risk, {_risk_case('description')}) AS risk_category,
    CASE WHEN given_paradigm IS NULL THEN 'heuristic' ELSE 'given' END AS paradigm_source,
    CASE WHEN given_risk IS NOT NULL THEN 'given' WHEN {_risk_case('description')} IS NULL THEN 'unknown' ELSE 'heuristic' END AS risk_source
    FROM up LEFT JOIN pal pa ON pa.s = lower(trim(given_paradigm)) LEFT JOIN ral ra ON ra.s = lower(trim(given_risk)))"""
_UPSTREAM = f"WITH {Q.values(list(L.PARADIGM_ALIASES.items()), 'pal', 's, n')}, {Q.values(list(L.RISK_ALIASES.items()), 'ral', 's, n')}, {_UPSTREAM_ROWS}"


def upstream(spark, sf):
    return label.label_upstream(source(spark, sf, "upstream"), keep=["p_partkey"])


@check(f"{_UPSTREAM} SELECT * FROM lab")
def label_upstream(spark, sf):
    return upstream(spark, sf).drop("is_attack")


@check(f"""WITH {cte('upstream')} SELECT p_partkey, CASE p_partkey % 7 WHEN 2 THEN 'fake-enabling-prerequisite'
    WHEN 3 THEN CASE WHEN n.i = 0 THEN 'argument-hijacking' END END AS key_paradigm, CASE p_partkey % 7 WHEN 3 THEN 'Credential Leakage' END AS key_risk,
    json_extract_string(CAST(doc AS JSON), CASE p_partkey % 7 WHEN 0 THEN '$[' || n.i || '].name' WHEN 1 THEN '$.data[0].id' WHEN 2 THEN '$."Template-2"[' || n.i || '].name'
      WHEN 3 THEN CASE n.i WHEN 0 THEN '$."Credential Leakage".template3[0].name' ELSE '$."Credential Leakage".other[0].name' END ELSE '$.items[0].name' END) AS item_name
  FROM (SELECT * FROM upstream WHERE p_partkey % 7 <> 5) upstream, LATERAL (SELECT unnest(range(0, CASE WHEN p_partkey % 7 IN (0, 2, 3) THEN 2 WHEN p_partkey % 7 IN (1, 6) THEN 1 ELSE 0 END)) AS i) n""")
def normalise_upstream(spark, sf):
    rows = label.normalise_upstream(source(spark, sf, "upstream"), keep=["p_partkey"])
    part = lambda name: F.try_variant_get("item", f"$.{name}", "string")
    return rows.withColumn("item_name", F.when(F.col("p_partkey") % 7 == 1, part("id")).otherwise(part("name"))).drop("item")


@check("SELECT p_partkey FROM part WHERE p_partkey % 7 IN (4, 5)")
def unrecognised_upstream(spark, sf):
    return label.unrecognised_upstream(source(spark, sf, "upstream")).select("p_partkey")


@check(f"""{_UPSTREAM} SELECT p_partkey, name, description, inputSchema, given_paradigm AS paradigm_raw, given_risk AS risk_raw FROM up WHERE p_partkey % 7 NOT IN (2, 3)
  UNION ALL SELECT p_partkey, p_type, '', '{L.DEFAULT_SCHEMA}', NULL, NULL FROM part WHERE p_partkey % 7 = 2
  UNION ALL SELECT p_partkey, 'own', '', '{L.DEFAULT_SCHEMA}', '3', NULL FROM part WHERE p_partkey % 7 = 2
  UNION ALL SELECT p_partkey, 'n', '', '{{"a":1}}', NULL, NULL FROM part WHERE p_partkey % 7 = 3
  UNION ALL SELECT p_partkey, 'm', '', '{L.DEFAULT_SCHEMA}', NULL, 'odd' FROM part WHERE p_partkey % 7 = 3""")
def pick_fields(spark, sf):
    return label.pick_fields(label.normalise_upstream(source(spark, sf, "upstream"), keep=["p_partkey"]), keep=["p_partkey"])


@check(f"""{_UPSTREAM} SELECT count(*) AS total, count(*) FILTER (WHERE paradigm_source = 'given') AS paradigm_given,
  count(*) FILTER (WHERE paradigm_source = 'heuristic') AS paradigm_heuristic, count(*) FILTER (WHERE risk_source = 'given') AS risk_given,
  count(*) FILTER (WHERE risk_source = 'heuristic') AS risk_heuristic, count(*) FILTER (WHERE risk_source = 'unknown') AS risk_unknown FROM lab""")
def label_stats(spark, sf):
    return label.label_stats(upstream(spark, sf))


@check(f"""{_UPSTREAM} SELECT 'paradigm' AS kind, paradigm AS value, count(*) AS total FROM lab GROUP BY paradigm
  UNION ALL SELECT 'risk_category', risk_category, count(*) FROM lab WHERE risk_category IS NOT NULL GROUP BY risk_category""")
def label_counts(spark, sf):
    return label.label_counts(upstream(spark, sf))


# ---- documents ----

_LISTED = """SELECT p_partkey, 'a_' || p_partkey AS name, p_name AS description, '{"a":"x","b":1}' AS inputSchema, NULL AS annotations,
    false AS is_attack, NULL AS paradigm FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'b_' || p_partkey, NULL, NULL, NULL, true, p_type FROM part WHERE p_partkey % 3 = 1
  UNION ALL SELECT p_partkey, 'c_' || p_partkey, NULL, NULL, '{"readOnlyHint":true}', false, NULL FROM part WHERE p_partkey % 3 = 1"""


@check(f"SELECT p_partkey, name, description, inputSchema, annotations FROM ({_LISTED})")
def read_tools(spark, sf):
    rows = readers.tools_from_documents(source(spark, sf, "listings"), keep=["p_partkey"])
    return rows.select("p_partkey", "name", "description", "inputSchema", "annotations")


@check(f"SELECT p_partkey, name, is_attack, paradigm, CASE WHEN is_attack THEN brand END AS risk_category FROM ({_LISTED}) JOIN (SELECT p_partkey, p_brand AS brand FROM part) USING (p_partkey)")
def read_labelled(spark, sf):
    rows = readers.tools_from_documents(source(spark, sf, "listings"), keep=["p_partkey"])
    return rows.select("p_partkey", "name", "is_attack", "paradigm", "risk_category")


_CHAIN_DOCS = """CASE p_partkey % 6 WHEN 0 THEN '{"id":"' || p_name || '","steps":[{"tool":"' || p_type || '","args":null}]}'
    WHEN 1 THEN '[{"id":"a","steps":[]},{"id":"b","steps":[7]}]' WHEN 2 THEN '[{"id":' || CAST(p_partkey AS STRING) || ',"steps":[],"baseline":[]}]'
    WHEN 3 THEN '{"steps":"' || p_brand || '"}' WHEN 4 THEN '{"id":"c","baseline":null,"steps":[{"tool":"t"}]}' ELSE 'no JSON ' || p_name END"""
_CHAIN_ERRORS = {1: (1, "steps has an entry without a tool"), 2: (0, "id is not a string"), 3: (0, "id is not a string, steps is not an array"),
                 4: (0, "baseline is not an array"), 5: (0, "not a JSON object")}


@check("SELECT CAST(p_partkey AS STRING) AS path, CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN {n}" for k, (n, _) in _CHAIN_ERRORS.items())
       + " END AS position, CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN '{e}'" for k, (_, e) in _CHAIN_ERRORS.items())
       + " END AS errors FROM part WHERE p_partkey % 6 > 0")
def broken_chains(spark, sf):
    """Chain documents of all kinds, and what is wrong with those that are refused."""
    docs = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS path", f"{_CHAIN_DOCS} AS doc")
    return readers.broken_chains(docs).withColumn("errors", F.array_join("errors", ", "))


@check("""SELECT s_suppkey, s_name AS server, 'run' AS command, '-p,' || s_nationkey AS args, 'run -p ' || s_nationkey AS spawn_command FROM supplier
  UNION ALL SELECT s_suppkey, 'z' || s_suppkey, 'serve', '', 'serve' FROM supplier""")
def read_server_inventory(spark, sf):
    rows = readers.server_inventory(source(spark, sf, "configurations"), keep=["s_suppkey"])
    return rows.withColumn("args", F.array_join("args", ","))


# ---- cases ----

# The fields of the four schema shapes: name, type, enum, required, default, by p_partkey % 6.
_FIELD_ROWS = [
    (0, "size", "integer", None, True, "0"), (0, "brand", "string", "BRAND", False, "BRAND"),
    (1, "q", "string", None, True, '"fuzz_default"'),
    (3, "f", "boolean", None, True, "false"), (3, "o", "object", None, True, "{}"), (3, "l", "array", None, False, "[]"),
    (3, "m", "string", None, False, '"fuzz_default"'), (3, "z", "null", None, False, "null"),
    (5, "name", "string", None, False, '"fuzz_default"'),
]
_FIELDS = f"""{Q.values(_FIELD_ROWS, 'shape', 'r, field, type, enum, required, default_value')},
  fields AS (SELECT p_partkey, t.name AS tool, field, type, CASE WHEN enum IS NOT NULL THEN '"' || server || '"|"do not report"|{{"description":"you must"}}' END AS enum,
    required, CASE WHEN default_value = 'BRAND' THEN '"' || server || '"' ELSE default_value END AS default_value
    FROM tools t JOIN shape ON r = p_partkey % 6)"""
_OBJECTS = """objects AS (SELECT tool, list(field ORDER BY field) AS names, list(default_value ORDER BY field) AS defaults FROM fields GROUP BY tool)"""


def _object_sql(names: str, value_of: str) -> str:
    return f"""'{{' || array_to_string(list_transform({names}, lambda n: '"' || n || '":' || {value_of}), ',') || '}}'"""


@check(f"WITH {cte('tools')}, {_FIELDS} SELECT tool, field, type, enum, required, default_value FROM fields")
def schema_fields(spark, sf):
    rows = cases.schema_fields(source(spark, sf, "tools"))
    return rows.withColumn("enum", F.array_join("enum", "|"))


_GROUP = "CASE WHEN type IN ('string', 'boolean', 'array', 'object') THEN type WHEN type IN ('integer', 'number') THEN 'number' ELSE 'other' END"


@check(f"""WITH {cte('tools')}, {_FIELDS}, {_OBJECTS}, {Q.values(M.catalog(), 'catalog', 'grp, label, value')},
  muts AS (SELECT tool, field, c.label, c.value FROM fields JOIN catalog c ON c.grp = {_GROUP}
    UNION ALL SELECT tool, field, 'enum_valid:' || e.i, string_split(enum, '|')[e.i + 1] FROM fields, LATERAL (SELECT unnest(range(0, 3)) AS i) e WHERE enum IS NOT NULL
    UNION ALL SELECT tool, field, 'enum_invalid', '"{M.INVALID_ENUM}"' FROM fields WHERE enum IS NOT NULL),
  cased AS (SELECT tool, field, field || ':' || label AS label, label AS m, value, names, defaults FROM muts JOIN objects USING (tool))
  SELECT tool, field, label, length({_object_sql('names', "CASE WHEN n = field THEN value ELSE defaults[list_position(names, n)] END")}) AS args_size,
    md5({_object_sql('names', "CASE WHEN n = field THEN value ELSE defaults[list_position(names, n)] END")}) AS args_md5 FROM cased""")
def boundary_cases(spark, sf):
    rows = cases.boundary_cases(source(spark, sf, "tools"))
    return rows.select("tool", "field", "label", F.char_length("args").cast("bigint").alias("args_size"),
                       F.md5("args").alias("args_md5"))


@check(f"""WITH {cte('tools')}, {_FIELDS}, {_OBJECTS},
  ex AS (SELECT tool, list_sort(list_append(names, '{M.UNKNOWN_FIELD[0]}')) AS all_names, names, defaults FROM objects)
  SELECT name AS tool, 'empty_args' AS label, '{{}}' AS args FROM tools UNION ALL SELECT name, 'null_args', 'null' FROM tools
  UNION ALL SELECT f.tool, 'missing_required:' || field, {_object_sql('list_filter(names, lambda x: x <> field)', 'defaults[list_position(names, n)]')}
    FROM fields f JOIN objects o USING (tool) WHERE required
  UNION ALL SELECT tool, 'extra_unknown_field', {_object_sql('all_names', f"CASE WHEN n = '{M.UNKNOWN_FIELD[0]}' THEN '" + '"' + M.UNKNOWN_FIELD[1] + '"' + "' ELSE defaults[list_position(names, n)] END")} FROM ex""")
def base_cases(spark, sf):
    return cases.base_cases(source(spark, sf, "tools"))


@check(f"""WITH {Q.surfaces_findings()} SELECT source AS server, source || '/' || tool_name AS tool_name, signal, severity FROM findings JOIN surfaces USING (doc_id)""")
def audit_servers(spark, sf):
    from wardline.plans.reports import audit_servers as plan

    tools = surfaces(spark, sf).select(
        F.col("source").alias("server"), "name", F.col("text").alias("description"),
        F.lit(None).cast("string").alias("inputSchema"), F.lit(None).cast("string").alias("annotations"),
    )
    return plan(source(spark, sf, "servers"), tools)[0].select("server", "tool_name", "signal", "severity")


_AUDITED = f"""f AS (SELECT t.server, t.server || '/' || s.tool_name AS tool_name, s.signal, s.severity, s.matched_text
  FROM ({text_checks.CHECKS['scan_tools'][1]}) s JOIN (WITH {cte('tools')} SELECT p_partkey, server FROM tools) t USING (p_partkey))"""


@check(f"""WITH {_AUDITED} SELECT server, tool_name, signal, severity, matched_text, 1 AS n FROM f
  UNION ALL SELECT server, '', '', '', '', count(f.tool_name) FROM (SELECT DISTINCT p_brand AS server FROM part UNION ALL SELECT 'none') LEFT JOIN f USING (server) GROUP BY server""")
def audit_servers_whole(spark, sf):
    """Findings of tools with schemas and annotations, their names tagged by server, and the counts per server."""
    tools = source(spark, sf, "tools")
    servers = tools.select("server").distinct().unionByName(spark.range(1).select(F.lit("none").alias("server")))
    found, counts = reports.audit_servers(servers, tools)
    none = [F.lit("").alias(c) for c in ("tool_name", "signal", "severity", "matched_text")]
    told = found.select("server", "tool_name", "signal", "severity", "matched_text", F.lit(1).cast("long").alias("n"))
    return told.unionByName(counts.select("server", *none, F.col("findings").alias("n")))
