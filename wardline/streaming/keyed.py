"""Stream jobs with state by key: replies paired with requests, definitions that change, calls out of order.

They run on ``transformWithStateInPandas``, whose state lies in RocksDB and is
part of the checkpoint: it is as large as the disk, outlives lost executors and
restarts, and is read in parts. ``run_available`` starts streams with that
store. Processors are classes inside functions, so that they travel to the
workers by value, like the other functions sent there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from wardline.functions.keys import same_keys
from wardline.operators.drift import change_findings, definition_hash
from wardline.operators.rpc import SESSION, reply_status
from wardline.rules import records as R


#: Stands for a null number of a row, which comes after all others.
_LAST = (1 << 63) - 1


def _schema(df: DataFrame, keys: Sequence[str], more: str) -> StructType:
    """The key columns as they are in ``df``, and others."""
    return StructType([*[df.schema[k] for k in keys], *StructType.fromDDL(more).fields])


def _keyed(frame: pd.DataFrame, keys: Sequence[str], key: tuple) -> pd.DataFrame:
    for k, (name, value) in enumerate(zip(keys, key, strict=False)):
        frame.insert(k, name, pd.Series([value] * len(frame), dtype=object))
    return frame


def pair_reply_stream(
    log: DataFrame, session: Sequence[str] = SESSION, late: str = "10 seconds", seconds: int = R.REPLY_SECONDS,
    bucket_seconds: int = 600,
) -> DataFrame:
    """Each request with the time of its nearest reply (append); the rows of the batch ``pair_replies``.

    Open requests and replies wait in lists by session, id and time bucket; a
    reply just after a bucket's edge is also offered to the bucket before, so a
    session that repeats one id for long is many small keys. A request is
    decided once the watermark has passed the last time its reply may have: the
    nearest reply at or after it, or silence. A reply is dropped as soon as no
    request can need it. Requests without an id need no reply and pass at once.
    """
    width, reach = bucket_seconds * 1_000_000, seconds * 1_000_000
    keys = [*session, "open_id", "bucket"]
    timed = log.where(F.col("direction").isin("request", "response")).withColumn(
        "ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    request, at = F.col("direction") == "request", F.unix_micros("ts")
    bucket = F.floor(at / width)
    both = F.when(~request & (F.pmod(at, F.lit(width)) <= reach), F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    waiting = timed.where(F.col("id").isNotNull()).select(
        *session, F.col("id").alias("open_id"), F.explode(both).alias("bucket"), "ts", "seq", at.alias("at"), request.alias("request"))

    class Pairing(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getListState("open", "at bigint, seq bigint")
            self.replies = handle.getListState("replies", "at bigint")
            self.due = handle.getValueState("due", "at bigint")

        def _wake(self, due: int | None) -> None:
            """The next time at which something is decided or dropped."""
            held = self.due.get()[0] if self.due.exists() else None
            if held == due:
                return
            if held is not None:
                self.handle.deleteTimer(held)
                self.due.clear()
            if due is not None:
                self.handle.registerTimer(due)
                self.due.update((due,))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            due = self.due.get()[0] if self.due.exists() else None
            for part in rows:
                asked = part["request"].to_numpy(bool)
                requests, replies = part.loc[asked, ["at", "seq"]], part.loc[~asked, "at"]
                if len(requests):
                    self.open.appendList([(int(a), None if pd.isna(s) else int(s)) for a, s in requests.itertuples(index=False)])
                if len(replies):
                    self.replies.appendList([(int(a),) for a in replies])
                first = min([*(requests["at"] + reach), *replies]) // 1000 + 1
                due = first if due is None else min(due, first)
            self._wake(due)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            self.due.clear()
            requests = sorted(self.open.get(), key=lambda r: r[0]) if self.open.exists() else []
            replies = np.sort(np.array([r[0] for r in self.replies.get()] if self.replies.exists() else [], np.int64))
            asked = np.array([r[0] for r in requests], np.int64)
            n = int(np.searchsorted(asked + reach, passed, "left"))  # all up to here are decided
            # the last sign is a reply at the end of time
            near = np.append(replies, np.iinfo(np.int64).max)[np.searchsorted(replies, asked[:n])]
            met = near <= asked[:n] + reach
            left = requests[n:]
            kept = replies[replies >= min([passed, *[r[0] for r in left[:1]]])]
            self.open.put(left) if left else self.open.clear()
            self.replies.put([(int(a),) for a in kept]) if len(kept) else self.replies.clear()
            due = min([*[r[0] + reach for r in left[:1]], *[int(a) for a in kept[-1:]]], default=None)
            self._wake(None if due is None else max(due, passed) // 1000 + 1)
            if n:
                yield _keyed(pd.DataFrame({
                    "seq": pd.array([r[1] for r in requests[:n]], "Int64"), "at": asked[:n],
                    "reply_at": pd.array([int(r) if m else None for r, m in zip(near, met, strict=True)], "Int64"),
                }), [*session, "open_id"], key)

        def close(self) -> None:
            pass

    found = waiting.groupBy(*keys).transformWithStateInPandas(
        Pairing(), _schema(waiting, [*session, "open_id"], "seq bigint, at bigint, reply_at bigint"), "append", "eventTime")
    stamp = lambda c: F.timestamp_micros(F.col(c))
    paired = found.select(*session, "seq", F.col("open_id").alias("id"), stamp("at").alias("ts"), stamp("reply_at").alias("reply_ts"))
    alone = timed.where(request & F.col("id").isNull()).select(
        *session, "seq", "id", "ts", F.lit(None).cast("timestamp").alias("reply_ts"))
    rows = paired.unionByName(alone)
    return rows.withColumn("status", reply_status())


def change_stream(
    listings: DataFrame, base: DataFrame | None = None, group: Sequence[str] = ("server",), name: str = "name",
    description: str = "description", schema: str = "inputSchema", annotations: str = "annotations", at: str = "ts",
) -> DataFrame:
    """Each change of a definition along a stream of listings (append); the rows of the batch ``definition_changes``.

    State is the last hash per group and name, kept for good and seeded from a
    ``base`` table of first listings: a stored definition that comes back
    different, and then different again, is found twice. Rows of a micro-batch
    count in the order of ``at``, micro-batches in the order of arrival.
    """
    keys = [*group, "name"]
    hashed = lambda df: df.select(
        *group, F.col(name).alias("name"), definition_hash(name, description, schema, annotations).alias("h"), F.col(at).alias("version_at"))
    fresh, first = hashed(listings).withColumn("listed", F.lit(False)), None
    if base is not None:
        groups = base.select(*group).distinct().withColumn("_known", F.lit(True))
        joined = hashed(listings).alias("l").join(groups.alias("g"), same_keys("l", "g", group), "left") if group else (
            hashed(listings).alias("l").join(groups.alias("g"), F.lit(True), "left"))
        fresh = joined.select(*[f"l.{c}" for c in (*keys, "h", "version_at")], F.coalesce("g._known", F.lit(False)).alias("listed"))
        first = hashed(base).groupBy(*keys).agg(F.max_by("h", F.struct("version_at", "h")).alias("h")).groupBy(*keys)
    fresh = fresh.withColumn("micros", F.unix_micros(F.col("version_at").cast("timestamp")))

    class Last(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", "h bigint")

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.last.update((int(initialState["h"].iloc[0]),))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            parts = [(p["micros"].fillna(np.iinfo(np.int64).min).to_numpy(np.int64), p["h"].to_numpy(np.int64), p["listed"].to_numpy(bool)) for p in rows]
            micros, hashes, listed = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((hashes, micros))
            micros, hashes = micros[order], hashes[order]
            known = self.last.exists()
            before = np.concatenate([[self.last.get()[0] if known else hashes[0]], hashes[:-1]])
            changed = hashes != before
            if not known and listed.any():
                changed[0] = True  # a name that the group's first listing does not have
            self.last.update((int(hashes[-1]),))
            if changed.any():
                at = [None if m == np.iinfo(np.int64).min else int(m) for m in micros[changed]]
                yield _keyed(pd.DataFrame({"micros": pd.array(at, "Int64")}), keys, key)

        def close(self) -> None:
            pass

    found = fresh.groupBy(*keys).transformWithStateInPandas(
        Last(), _schema(fresh, keys, "micros bigint"), "append", "none", first)
    return change_findings(found.withColumn(at, F.timestamp_micros("micros")), [*group, at])


def lifecycle_stream(
    log: DataFrame, session: Sequence[str] = SESSION, quiet: str | None = None, late: str = "10 seconds"
) -> DataFrame:
    """Calls out of order per session (append): session columns, seq, ts, violation.

    State is two flags per session, kept for good. With ``quiet`` (such as "1
    hour") a timer drops them once the watermark is so long past a session's
    last row; a session that goes on later then counts as a new one, and rows
    more than ``late`` behind are left out. Rows need seq, direction and method;
    those of a micro-batch count in the order of seq. A session's part
    of a micro-batch is walked once; should it be larger than one Arrow batch,
    the rows before the last batch wait in the state's own list, not in memory.
    """
    hold = None if quiet is None else int(pd.Timedelta(quiet).total_seconds() * 1000)
    ts, method = F.col("ts").cast("timestamp"), F.col("method")
    # what a row is, as a number, so that a session's part is few plain arrays
    kind = F.when(F.col("direction") == "request", F.when(method == "initialize", 1).when(method == "tools/call", 2).when(method == "tools/list", 3).otherwise(0))
    kind = kind.when(F.col("direction").isin("closed", "crashed"), 4).otherwise(5).cast("long")
    narrow = log.select(*session, ts.alias("ts"), F.coalesce("seq", F.lit(_LAST)).cast("long").alias("seq"), F.unix_micros(ts).alias("micros"), kind.alias("kind"))
    if hold is None:
        narrow = narrow.where("kind < 5").drop("ts")  # other rows change nothing
    else:
        narrow = narrow.withWatermark("ts", late)
    last_seq, columns = _LAST, ["seq", "micros", "kind"]

    class Order(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.flags = handle.getValueState("flags", "opened boolean, closed boolean")
            self.until = handle.getValueState("until", "at bigint")
            self.held = handle.getListState("held", "seq bigint, micros bigint, kind bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            before = self.flags.get() if self.flags.exists() else None
            opened, closed = before or (False, False)
            # a null seq counts as the last number there is
            first, end, waiting = (-1 - last_seq if opened else last_seq), (-1 - last_seq if closed else last_seq), None
            spilled, latest = False, None
            for part in rows:
                seq, micros, kind = (part[c].to_numpy() for c in columns)
                if hold is not None and (known := ~pd.isna(micros)).any():
                    latest = max(int(micros[known].max()), latest or int(micros[known].max()))
                starts, ends = seq[kind == 1], seq[kind == 4]
                if len(starts):
                    opened, first = True, min(first, int(starts.min()))
                if len(ends):
                    closed, end = True, min(end, int(ends.min()))
                if waiting is not None and len(waiting[0]):
                    self.held.appendList([(int(q), None if pd.isna(m) else int(m), int(k)) for q, m, k in zip(*waiting, strict=True)])
                    spilled = True
                asked = kind < 4
                waiting = seq[asked], micros[asked], kind[asked]
            if before != (opened, closed):
                self.flags.update((opened, closed))
            if latest is not None:
                held = self.until.get()[0] if self.until.exists() else None
                if held is None or held < latest // 1000 + hold:
                    if held is not None:
                        self.handle.deleteTimer(held)
                    self.handle.registerTimer(latest // 1000 + hold)
                    self.until.update((latest // 1000 + hold,))
            yield from self._broken(key, *waiting, first, end)
            if spilled:
                some: list[tuple] = []
                for row in self.held.get():
                    some.append(row)
                    if len(some) == 10_000:
                        yield from self._again(key, some, first, end)
                        some = []
                if some:
                    yield from self._again(key, some, first, end)
                self.held.clear()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.flags.clear()
            self.until.clear()
            return iter(())

        def _again(self, key, some, first, end) -> Iterator[pd.DataFrame]:
            seq, micros, kind = zip(*some, strict=True)
            yield from self._broken(key, np.array(seq, np.int64), np.array(micros, object), np.array(kind, np.int64), first, end)

        def _broken(self, key, seq, micros, kind, first, end) -> Iterator[pd.DataFrame]:
            found = np.flatnonzero(np.concatenate((seq > end, (kind == 1) & (seq > first), (kind > 1) & (seq < first))))
            if len(found):
                at, rule = found % len(seq), found // len(seq)
                # 0: after the end, 1: a second start, 2 and 3: too early
                columns = {"seq": seq[at], "micros": micros[at], "rule": np.where(rule == 2, kind[at], rule)}
                if micros.dtype != np.int64:
                    columns["micros"] = pd.array([None if pd.isna(m) else int(m) for m in columns["micros"]], "Int64")
                yield pd.DataFrame({**{c: np.full(len(at), v, object) for c, v in zip(session, key, strict=False)}, **columns})

        def close(self) -> None:
            pass

    found = narrow.groupBy(*session).transformWithStateInPandas(
        Order(), _schema(narrow, session, "seq bigint, micros bigint, rule bigint"), "append",
        "none" if hold is None else "eventTime")
    rules = ("request_after_close", "second_initialize", "tools_call_before_initialize", "tools_list_before_initialize")
    violation = F.element_at(F.array(*map(F.lit, rules)), (F.col("rule") + 1).cast("int"))
    return found.select(*session, F.when(F.col("seq") != _LAST, F.col("seq")).alias("seq"), F.timestamp_micros("micros").alias("ts"), violation.alias("violation"))
