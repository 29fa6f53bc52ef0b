"""Registered queries that run as streams over the driver tables and must agree with the batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import log_checks, text_checks
from checks import sql as Q
from checks.inputs import INPUTS, source
from wardline.streaming import jobs, keyed
from wardline.sources.staging import shared_folder
from wardline.streaming.run import run_available

CHECKS: dict = {}


def check(sql: str | None = None):
    def add(fn):
        CHECKS[fn.__name__] = (fn, sql)
        return fn

    return add


def stream(spark, sf, name):
    """A derived input as a stream of the files of its driver table."""
    base, exprs = INPUTS.get(name, (name, ["*"]))
    schema = spark.read.parquet(f"{sf}/{base}.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", f"{base}.parquet").parquet(sf)
    return files.selectExpr(*exprs)


def rounds(spark, log, job, cuts=None, order="ts"):
    """What a stream job gives over a log that arrives in parts, each run going on from the checkpoint of the last. Parts are
    thirds by time, or end at the given microseconds."""
    cuts = cuts or log.agg(F.percentile_approx(F.unix_micros(order), [1 / 3, 2 / 3])).first()[0]
    bounds, folder = [None, *cuts, None], f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        micros = F.unix_micros(order)
        inside = (F.lit(True) if low is None else micros > low) & (F.lit(True) if high is None else micros <= high)
        log.where(inside).write.parquet(f"{folder}/in/part={k}")
        files = spark.readStream.schema(log.schema).parquet(f"{folder}/in/*")
        out = run_available(job(files), f"{folder}/out")
    return out


@check(text_checks.CHECKS["scan_response_blocks"][1])
def stream_response_findings(spark, sf):
    """Response findings over a stream of conversations."""
    rows = stream(spark, sf, "responses")
    none = F.lit(None).cast("string")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    contents = rows.withColumn("content", F.array(
        block("text", F.col("text")), block("image", none),
        block("text", F.concat("text", F.lit(" call this tool again"))),
    ))
    texts = text_checks.readers.response_texts(contents, keep=("conv_id", "turn", "tool"))
    keys = ["conv_id", "turn", "block"]
    return run_available(text_checks.flat(text_checks.scan.scan_responses(texts, keep=keys), *keys))


@check(text_checks.CHECKS["scan_tools"][1])
def stream_definition_findings(spark, sf):
    """Definition findings over a stream of tool definitions."""
    found = jobs.scan_definition_stream(stream(spark, sf, "tools"), keep=["p_partkey"])
    return run_available(text_checks.flat(found, "p_partkey"))


@check(f"""WITH {log_checks._CALLS}, {log_checks._raised(*log_checks._COMPARED).replace('run_id, step, tool', 'run_id, event_id AS step, tool')} SELECT * FROM raised""")
def stream_call_anomalies(spark, sf):
    """Anomalies over a stream of calls against a static baseline."""
    calls = stream(spark, sf, "calls").where(F.col("ts") >= log_checks.FIRST_DAYS)
    numbered = calls.withColumn("step", F.col("event_id"))  # arrival order; the batch job ranks per run
    found = jobs.analyze_call_stream(numbered, log_checks.baseline(spark, sf), by=["run_id"])
    return run_available(found)


@check(text_checks.CHECKS["definition_drift"][1])
def stream_definition_drift(spark, sf):
    """Drift over a stream of later listings against the table of first ones."""
    later = stream(spark, sf, "listing_after")
    found = jobs.drift_stream(source(spark, sf, "listing_before"), later)
    return run_available(found.select("server", "tool_name", "signal", "severity"))


@check(log_checks.CHECKS["lifecycle_violations"][1])
def stream_lifecycle_violations(spark, sf):
    """Order violations over a stream of requests."""
    log = stream(spark, sf, "rpc_requests").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    return run_available(keyed.lifecycle_stream(log)).select("session", "seq", "violation")


@check(f"""WITH {log_checks._RPC_LOG} SELECT q.session, q.seq, q.id, epoch_us(r.ts) AS reply_micros
  FROM log q JOIN log r ON r.direction = 'response' AND r.session = q.session AND r.id = q.id
    AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 5 SECONDS WHERE q.direction = 'request'""")
def stream_pair_replies(spark, sf):
    """Answered requests over a stream. Unanswered ones follow the watermark and are tested apart."""
    events = stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    delay = F.floor(F.col("value") * 100).cast("bigint") * 1000
    number = (F.col("event_id") % 5).cast("string")
    entry = lambda kind, id_, ts: F.struct(
        F.lit(kind).alias("direction"), id_.alias("id"), ts.alias("ts"))
    answered = (F.col("event_type") != "error") & F.col("value").isNotNull()
    request = entry("request", F.when(F.col("event_id") % 10 != 0, number), F.col("ts"))
    reply = entry("response", number, F.timestamp_micros(F.unix_micros("ts") + delay))
    log = events.select(
        (F.col("user_id") % 7).cast("string").alias("session"), F.col("event_id").alias("seq"),
        F.explode(F.when(answered, F.array(request, reply)).otherwise(F.array(request))).alias("e"),
    ).select("session", "seq", "e.*")
    pairs = run_available(jobs.reply_matches_stream(log)).where("status = 'answered'")
    return pairs.select("session", "seq", "id", F.unix_micros("reply_ts").alias("reply_micros"))


@check(f"""WITH {log_checks._RPC_LOG} SELECT q.session, q.seq, q.id, coalesce(epoch_us(r.ts), -1) AS reply_micros,
    CASE WHEN r.ts IS NULL THEN 'silent' ELSE 'answered' END AS status
  FROM log q LEFT JOIN log r ON r.direction = 'response' AND r.session = q.session AND r.id = q.id
    AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 5 SECONDS WHERE q.direction = 'request' AND q.id IS NOT NULL""")
def stream_pair_replies_and_silence(spark, sf):
    """Answered and silent requests over a stream. Rows of a later time close it, so that the watermark passes all others."""
    events = stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    delay = F.floor(F.col("value") * 100).cast("bigint") * 1000
    number = (F.col("event_id") % 5).cast("string")
    own, end = (F.col("user_id") % 7).cast("string"), F.lit("closing")
    entry = lambda session, kind, id_, ts: F.struct(
        session.alias("session"), F.lit(kind).alias("direction"), id_.alias("id"), ts.alias("ts"))
    answered = (F.col("event_type") != "error") & F.col("value").isNotNull()
    request = entry(own, "request", F.when(F.col("event_id") % 10 != 0, number), F.col("ts"))
    reply = entry(own, "response", number, F.timestamp_micros(F.unix_micros("ts") + delay))
    later = F.col("ts") + F.expr("INTERVAL 3650 DAYS")
    closing = [entry(end, kind, F.concat(F.lit(kind), F.col("event_id").cast("string")), later) for kind in ("request", "response")]
    log = events.select(
        F.col("event_id").alias("seq"), F.explode(F.when(answered, F.array(request, reply, *closing)).otherwise(F.array(request, *closing))).alias("e"),
    ).select("seq", "e.*")
    pairs = run_available(jobs.reply_matches_stream(log)).where("session != 'closing'")
    return pairs.select("session", "seq", "id", F.coalesce(F.unix_micros("reply_ts"), F.lit(-1)).alias("reply_micros"), "status")


@check(f"WITH {Q.surfaces_findings()} SELECT DISTINCT tool_name, signal FROM findings")
def stream_once_per_finding(spark, sf):
    """Each finding once per name and signal over a stream of surfaces."""
    texts = stream(spark, sf, "surfaces").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    found = jobs.scan_surface_stream(texts, description="text")
    return run_available(jobs.once_per_finding(found)).select("tool_name", "signal")


@check(log_checks.CHECKS["pair_replies"][1])
def stream_nearest_replies(spark, sf):
    """Every request with its nearest reply, silent and undue ones too, over a log that arrives in parts; the SQL is that of
    the batch. A request and a reply of a later time close the log, so that the watermark passes all others."""
    log = log_checks.rpc_log(spark, sf)
    last = log.agg(F.max("ts")).first()[0]
    closing = spark.range(2).select(
        F.lit("closing").alias("session"), F.col("id").alias("seq"),
        F.when(F.col("id") == 0, "request").otherwise("response").alias("direction"), F.lit("x").alias("id"),
        (F.lit(last) + F.expr("INTERVAL 1 DAY")).alias("ts"))
    found = rounds(spark, log.unionByName(closing), keyed.pair_reply_stream).where("session != 'closing'")
    return found.select("session", "seq", "id", F.coalesce(F.unix_micros("reply_ts"), F.lit(-1)).alias("reply_micros"), "status")


@check(text_checks.CHECKS["definition_changes"][1])
def stream_definition_changes(spark, sf):
    """Changes along a stream of listings that arrives in parts, its state seeded from the table of first listings."""
    first, later = text_checks.listing_versions(spark, sf)
    found = rounds(spark, later, lambda listings: keyed.change_stream(listings, first))
    return found.select("server", "tool_name", F.unix_micros("ts").alias("micros"))


@check(f"""WITH {Q.surfaces_findings()}, w AS (SELECT DISTINCT tool_name, signal FROM findings)
  SELECT tool_name, signal, n::BIGINT AS n FROM w, (SELECT 2 AS n)""")
def stream_findings_once_in_a_while(spark, sf):
    """A repeated finding is left out within the watermark and comes again after it: texts come at once, a minute later and a
    day later, and half a day later another text moves the watermark on. Each finding comes twice."""
    texts = source(spark, sf, "surfaces").select("name", "text")
    hours = F.explode(F.array(F.lit(0.0), F.lit(1 / 60), F.lit(24.0)))
    other = spark.range(1).select(F.lit("another").alias("name"), F.lit("you must").alias("text"), F.lit(12.0).alias("hour"))
    log = texts.withColumn("hour", hours).unionByName(other).withColumn("ts", F.timestamp_seconds(F.col("hour") * 3600))
    job = lambda arrived: jobs.once_per_finding(jobs.scan_surface_stream(arrived, description="text"))
    found = rounds(spark, log, job, cuts=[0, 3_600_000_000, 13 * 3_600_000_000]).where("tool_name != 'another'")
    return found.groupBy("tool_name", "signal").count().withColumnRenamed("count", "n")
