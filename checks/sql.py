"""Building blocks of the check SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Sequence

from checks.inputs import cte
from wardline.operators import scan
from wardline.rules import archetypes as A
from wardline.rules import signals as S
from wardline.rules import words as W


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listing(items: Sequence[str]) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"


def values(rows: Sequence[Sequence], name: str, columns: str) -> str:
    def cell(v):
        return "NULL" if v is None else quote(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def lower(expr: str) -> str:
    return f"translate({expr}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def snippet(text: str, start: str, size: str) -> str:
    c = W.SNIPPET_CONTEXT
    first = f"greatest({start} - {c}, 1)"
    stop = f"({start} + {size} + {c})"
    return (
        f"(CASE WHEN {start} - {c} > 1 THEN '…' ELSE '' END || substr({text}, {first}, {stop} - {first}) || "
        f"CASE WHEN {stop} <= length({text}) THEN '…' ELSE '' END)"
    )


def pattern_values(patterns: Sequence[scan.Pattern], name: str = "patterns") -> str:
    rows = [(p.folded, p.signal, p.severity, p.explanation, ",".join(p.corpus_refs)) for p in patterns]
    return values(rows, name, "needle, signal, severity, detail, refs")


def rules_values() -> str:
    rows = [(n, S.rule_id(n), about, tags.replace(" ", ",")) for n, tags, about in S.SIGNALS]
    return values(rows, "rules", "signal, rule_id, description, tags")


def rank(expr: str) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(S.SEVERITIES)) + " END"


def needle_rows(texts: str, keys: str, name: str, patterns: str = "patterns") -> str:
    """SELECT of needle findings over a relation with a ``text`` column."""
    return f"""SELECT {keys}, {name} AS tool_name, p.signal, p.severity, 'needles' AS pass,
      {snippet('t.text', 'strpos(t.l, p.needle)', 'length(p.needle)')} AS matched_text, p.detail, p.refs
      FROM (SELECT *, {lower('text')} AS l FROM {texts} WHERE text IS NOT NULL) t
      JOIN {patterns} p ON contains(t.l, p.needle)"""


def word_relations(texts: str, key: str) -> str:
    """CTEs lowered(key, text, l) and tokens(key, word, i) of a relation with a unique key."""
    return f"""lowered AS (SELECT *, {lower('text')} AS l FROM {texts} WHERE text IS NOT NULL),
    split AS (SELECT {key}, list_transform(list_filter(string_split_regex(l, '[ \\t\\n\\f\\r]+'), lambda x: x <> ''),
      lambda w: regexp_replace(w, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', '', 'g')) AS w FROM lowered),
    tokens AS (SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split)"""


def word_start(l: str, word: str) -> str:
    return (
        f"(length(regexp_extract({l}, '(?s)^((?:.*?[ \\t\\n\\f\\r])?)' || {word} || '(?:[^0-9A-Za-z]|$)', 1)) + 1)"
    )


def _anchored(pass_: str, first: str, key: str, name: str, signal: str, refs: Sequence[str], detail: str) -> str:
    start = word_start("t.l", "h.word")
    return f"""SELECT {', '.join('t.' + k for k in key.split(', '))}, t.{name} AS tool_name, '{signal}' AS signal,
      'medium' AS severity, '{pass_}' AS pass, {snippet('t.text', start, 'length(h.word)')} AS matched_text,
      {quote(detail)} AS detail, '{','.join(refs)}' AS refs
      FROM lowered t JOIN ({first}) h USING ({key})"""


def structural_rows(pass_: str, key: str, name: str) -> str:
    verbs, nouns, signal, refs, detail = scan.STRUCTURAL[pass_]
    first = f"""SELECT {key}, min_by(word, i) AS word FROM (
      SELECT v.{key}, v.word, v.i FROM tokens v JOIN tokens t ON t.{key} = v.{key}
        AND t.i BETWEEN v.i AND v.i + {W.STRUCTURAL_WINDOW - 1}
      WHERE list_contains({listing(verbs)}, v.word)
      GROUP BY v.{key}, v.word, v.i
      HAVING bool_or(list_contains({listing(W.QUANTIFIERS)}, t.word))
         AND bool_or(list_contains({listing(nouns)}, t.word))) GROUP BY {key}"""
    return _anchored(pass_, first, key, name, signal, refs, detail)


def verb_rows(pass_: str, key: str, name: str) -> str:
    verbs, signal, refs, detail = scan.VERBS[pass_]
    first = f"""SELECT a.{key}, min_by(v.word, (a.i, v.i)) AS word FROM tokens a
      JOIN tokens b ON b.{key} = a.{key} AND b.i = a.i + 1 AND list_contains({listing(W.TRIGGER_VERBS)}, b.word)
      JOIN tokens v ON v.{key} = a.{key} AND v.i BETWEEN a.i + 2 AND a.i + {W.VERB_WINDOW - 1}
        AND list_contains({listing(verbs)}, v.word)
      WHERE a.word = '{W.TRIGGER}' GROUP BY a.{key}"""
    return _anchored(pass_, first, key, name, signal, refs, detail)


def archetype_values() -> str:
    rows = [(i, label, text, signal, refs.replace(" ", ",")) for i, (label, text, signal, refs)
            in enumerate(A.ARCHETYPES, 1)]
    return values(rows, "archetypes", "position, label, text, signal, refs")


def model_relations() -> str:
    """CTEs idf(term, idf) and weights(position, term, weight)."""
    return f"""{archetype_values()},
    atf AS (SELECT position, term, count(*) AS n FROM (SELECT position, unnest(string_split(text, ' ')) AS term
      FROM archetypes) GROUP BY ALL),
    idf AS (SELECT term, ln({len(A.ARCHETYPES)} / count(*)) + 1 AS idf FROM atf GROUP BY term),
    weights AS (SELECT position, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY position)) AS weight
      FROM atf JOIN idf USING (term))"""


def similarity_relations(key: str) -> str:
    """CTEs up to best(key, position, cosine); needs lowered and the model."""
    return f"""terms AS (SELECT {key}, unnest(list_filter(string_split_regex(l, '[^0-9a-z]+'), lambda t: length(t) >= 2))
      AS term FROM lowered),
    dtf AS (SELECT {key}, term, count(*) * any_value(idf) AS raw FROM terms JOIN idf USING (term) GROUP BY {key}, term),
    norms AS (SELECT {key}, sqrt(sum(raw * raw)) AS norm FROM dtf GROUP BY {key}
      HAVING count(*) >= {A.MIN_SHARED_TERMS}),
    near AS (SELECT {key}, position, sum(raw * weight) / any_value(norm) AS cosine
      FROM dtf JOIN weights USING (term) JOIN norms USING ({key}) GROUP BY {key}, position
      HAVING sum(raw * weight) / any_value(norm) >= {A.MIN_COSINE}),
    best AS (SELECT {key}, a.signal, min_by(n.position, n.position) AS position, min_by(n.cosine, n.position) AS cosine
      FROM near n JOIN archetypes a USING (position) GROUP BY {key}, a.signal)"""


def similarity_rows(key: str, name: str) -> str:
    return f"""SELECT t.{key}, t.{name} AS tool_name, a.signal, 'low' AS severity, 'similarity' AS pass,
      substr(t.text, 1, {W.SIMILARITY_EVIDENCE}) AS matched_text,
      'Wording is close to archetype ''' || a.label || ''' (cosine ' || format('{{:.2f}}', b.cosine) || ')' AS detail, a.refs
      FROM best b JOIN archetypes a USING (position) JOIN lowered t USING ({key})"""


def scan_relations(texts: str, key: str, name: str, out: str = "findings") -> str:
    """CTEs ending in ``out`` with all passes over ``texts`` (which must have a unique ``key``)."""
    parts = [needle_rows(texts, f"t.{key}", f"t.{name}")]
    parts += [structural_rows(p, key, name) for p in scan.STRUCTURAL]
    parts += [verb_rows(p, key, name) for p in scan.VERBS]
    parts.append(similarity_rows(key, name))
    return f"""{pattern_values(scan.DESCRIPTION_PATTERNS)}, {word_relations(texts, key)}, {model_relations()},
    {similarity_relations(key)}, {out} AS ({' UNION ALL '.join(parts)})"""


def surfaces_findings() -> str:
    """CTEs surfaces and findings (doc_id, tool_name, signal, severity, pass, matched_text, detail, refs)."""
    return f"{cte('surfaces')}, {scan_relations('surfaces', 'doc_id', 'name')}"
