"""The registered queries of the training-data operators, and the SQL that each must agree with."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import (
    bpe, collision_nn, decontaminate, html_text, lattice_lm, line_dedup, merkle, nbsvm, near_dedup, pfor, token_align, token_counts, warc,
)
from wardline.llm.common import Scratch, hashed_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), scratch.path("streams"), scratch)
    index = warc.normalise(spark, scratch.path("streams"), scratch.path("archives"))
    found = warc.read(spark, scratch.path("archives"), index)
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(F.col(c)) != "", page(F.col(c)).cast("long"))
    return found.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload"), F.col("http_length")).cast("long").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.substring_index("digest", ":", -1)).alias("payload_digest"),
        F.col("type").alias("record_type"), number("refers_to").alias("refers_to"),
    )


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = lattice_lm.score(docs, hashed_out("doc_id", 10) != 0, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_collision_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collision_nn.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))


def op4_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(hashed_out("doc_id", 5) != 0)
    model = nbsvm.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return nbsvm.score(docs, model).select(
        "doc_id", (hashed_out("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op5_pfor(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "ids").path("files")
    files = pfor.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return pfor.read(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = line_dedup.find(_table(spark, sf_dir, "documents"), near_chars=20)
    return found.select(
        F.col("key").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
        "dropped", "copies_of",
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.find(_table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_align.report(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = lambda text: merkle.leaf_digest(*[F.col(c) for c in fields[:-1]], text)
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(
        F.col("doc_id").alias("key"), F.col("source").alias("group"), leaf(F.col("text")).alias("leaf"),
        F.when(hashed_out("doc_id", 5) == 0, leaf(lowered)).alias("tampered"),
    )
    manifest = merkle.build(rows, claim="tampered")
    root = F.lit(manifest.root and manifest.root.hex()).cast("string")
    folded = merkle.prove(manifest).select(
        F.col("key").alias("doc_id"), merkle.hexed(F.col("leaf")).alias("leaf"), merkle.hexed(F.col("subroot")).alias("subroot"),
        root.alias("root"), merkle.siblings_digest(F.col("path")).alias("proof_sha256"),
        merkle.fold(F.coalesce("claim", "leaf"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_lattice": op2_lattice,
    "op3_collision_nn": op3_collision_nn,
    "op4_nbsvm": op4_nbsvm,
    "op5_pfor": op5_pfor,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_superminhash": op8_superminhash,
    "op9_bpe": op9_bpe,
    "op10_html_text": op10_html_text,
    "op11_token_align": op11_token_align,
    "op12_merkle": op12_merkle,
    "op13_token_counts": op13_token_counts,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS n, sha256(body) AS digest FROM p),
        f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
        SELECT page_id, n::BIGINT AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100
    """,
    "op7_decontaminate": f"""
        WITH low AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
        iw AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM iw)),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
            SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM low, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
        hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN win USING (k, s)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(x)), ',') AS l FROM (
            SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT low.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
        FROM low LEFT JOIN pos ON pos.doc_id = low.doc_id LEFT JOIN its ON its.doc_id = low.doc_id
    """,
    "op8_superminhash": f"""
        WITH RECURSIVE low AS (SELECT doc_id, {_SPACED} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS x FROM (
            SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM low WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM low UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r),
        c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
        FROM c LEFT JOIN n ON n.doc_id = c.doc_id
    """,
    "op12_merkle": r"""
        WITH RECURSIVE f AS (
            SELECT doc_id, source, text,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT),
                    lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT) AS crc
            FROM documents),
        d AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered
            FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM d),
        lv(source, k, i, m, h) AS (
            SELECT source, 0, i, m, leaf FROM r
            UNION ALL
            SELECT source, k + 1, i // 16, (m + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE m > 1 GROUP BY source, k, i // 16, m),
        s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS m FROM lv WHERE m = 1),
        up(k, i, m, h) AS (
            SELECT 0, i, m, subroot FROM s
            UNION ALL
            SELECT k + 1, i // 16, (m + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE m > 1 GROUP BY k, i // 16, m),
        lside AS (SELECT source, k, i,
            coalesce(string_agg(h, '') OVER (PARTITION BY source, k, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(h, '') OVER (PARTITION BY source, k, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM lv WHERE m > 1),
        uside AS (SELECT k, i,
            coalesce(string_agg(h, '') OVER (PARTITION BY k, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(h, '') OVER (PARTITION BY k, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM up WHERE m > 1),
        steps AS (
            SELECT r.source, r.i, z.k, z.l, z.r FROM r JOIN lside z ON z.source IS NOT DISTINCT FROM r.source AND z.i = r.i >> (4 * z.k)
            UNION ALL
            SELECT r.source, r.i, 100 + z.k, z.l, z.r FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source JOIN uside z ON z.i = s.i >> (4 * z.k)),
        p AS (SELECT source, i, list(l ORDER BY k) AS l, list(r ORDER BY k) AS r FROM steps GROUP BY source, i),
        q AS (
            SELECT doc_id, leaf, subroot, (SELECT h FROM up WHERE m = 1) AS root,
                sha256(coalesce(array_to_string(list_transform(range(1, len(p.l) + 1), lambda x: p.l[x] || p.r[x]), ''), '')) AS proof_sha256,
                coalesce(list_reduce(list_prepend(coalesce(tampered, leaf), list_transform(range(1, len(p.l) + 1), lambda x: p.l[x] || '/' || p.r[x])),
                    lambda h, x: sha256(split_part(x, '/', 1) || h || split_part(x, '/', 2))), coalesce(tampered, leaf)) AS folded_root
            FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN p ON p.source IS NOT DISTINCT FROM r.source AND p.i = r.i)
        SELECT *, folded_root = root AS verified FROM q
    """,
}
