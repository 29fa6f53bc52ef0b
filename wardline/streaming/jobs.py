"""The same computations over streams.

These jobs are the batch functions on a streaming DataFrame, or joins and
duplicates under a watermark; ``keyed`` has those that keep state by key. Keys
are the finest that the rule allows, so no key holds a whole server or log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.definitions import scan_tools
from wardline.operators.drift import definition_drift
from wardline.operators.scan import scan_responses, scan_surface
from wardline.operators.sequence import analyze
from wardline.rules import records as R
from wardline.sources.readers import response_texts


def scan_response_stream(responses: DataFrame, keep: Sequence[str] = ("ts", "session", "tool")) -> DataFrame:
    """Response findings over a stream of tool results (append)."""
    texts = response_texts(responses, keep=keep)
    return scan_responses(texts, keep=[c for c in keep if c != "tool"])


def scan_definition_stream(definitions: DataFrame, keep: Sequence[str] = ("ts", "server"), **options) -> DataFrame:
    """Definition findings over a stream of snapshots (append)."""
    return scan_tools(definitions, keep=keep, **options)


def scan_surface_stream(surfaces: DataFrame, keep: Sequence[str] = ("ts",), **options) -> DataFrame:
    return scan_surface(surfaces, keep=keep, **options)


def analyze_call_stream(calls: DataFrame, baseline: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Sequence anomalies over a stream of calls against a static baseline on the right of its joins (append)."""
    return analyze(calls, baseline, by=by)


def drift_stream(base: DataFrame, listings: DataFrame, server: str = "server") -> DataFrame:
    """Definitions of a stream of listings that differ from a stored first listing, or are not in it.

    ``base`` is a table of first listings, such as an earlier run has written.
    The stream is joined with it, so there is no state that could be forgotten,
    late or early rows give what the batch gives, and a server without a stored
    listing gives nothing.
    """
    return definition_drift(base, listings, group=(server,))


def reply_matches_stream(log: DataFrame, late: str = "10 seconds", seconds: int = R.REPLY_SECONDS) -> DataFrame:
    """Requests with every reply in time, or with none once the watermark has passed (append).

    All matches, for the study of repeated replies; ``keyed.pair_reply_stream``
    gives each request its nearest reply, as the batch does. A stream-stream
    left join whose state both watermarks and the reply bound
    keep small. Requests and replies meet by session, id and a stretch of time
    of twice the bound; a reply just after its start is also offered to the
    stretch before, so a session that repeats one id is compared within
    stretches only. Requests without an id need no reply and are left out here.
    """
    width, reach = 2 * seconds * 1_000_000, seconds * 1_000_000
    stretch = lambda at: F.floor(F.unix_micros(F.col(at).cast("timestamp")) / width)
    near = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(width)) <= reach
    requests = log.where((F.col("direction") == "request") & F.col("id").isNotNull()).select(
        "session", "seq", "id", "ts", stretch("ts").alias("stretch")
    ).withWatermark("ts", late)
    replies = log.where(F.col("direction") == "response").select(
        F.col("session").alias("r_session"), F.col("id").alias("r_id"), F.col("ts").alias("reply_ts"),
        F.explode(F.when(near, F.array(stretch("ts"), stretch("ts") - 1)).otherwise(F.array(stretch("ts")))).alias("r_stretch"),
    ).withWatermark("reply_ts", late)
    joined = requests.join(
        replies,
        F.expr(
            f"session = r_session AND id = r_id AND stretch = r_stretch AND reply_ts >= ts AND reply_ts <= ts + INTERVAL {seconds} SECONDS"
        ),
        "leftOuter",
    )
    status = F.when(F.col("reply_ts").isNull(), "silent").otherwise("answered")
    return joined.select("session", "seq", "id", "ts", "reply_ts", status.alias("status"))


def once_per_finding(findings: DataFrame, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """The first finding per (tool_name, signal) within the watermark."""
    return findings.withWatermark(ts, late).dropDuplicatesWithinWatermark(["tool_name", "signal"])
