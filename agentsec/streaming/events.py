"""Structured Streaming forms: tailing audit logs, windowed counts, keyed session state, deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalar as S
from ..operators import analytics as A
from ..operators import sessions as W
from ..sources import logs
from ..sources.tail import AppendedLines


def tail_audit_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the *.jsonl files of a folder as they are appended, each once (`sources.tail`), bad ones in `_bad`."""
    spark.dataSource.register(AppendedLines)
    raw = spark.readStream.format("appended_lines").option("path", folder).load()
    entry = F.from_json("line", logs.AUDIT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")
    named = raw.select(F.element_at(F.split("file", "/"), -1).alias("file"), "at", entry).select("file", "at", "e.*").withColumn("log", logs.plain_log_name(F.col("file")))
    return logs.with_layer(named, logs.layer_map(spark))


def partial_statistics(events: DataFrame) -> dict[str, DataFrame]:
    """What `sink_metrics`, `sink_patterns` and `sink_layers` need to know of some events (id, ts, layer, action, severity, pattern_id): mergeable, so of each batch alone."""
    counts = [F.count(F.lit(1)).alias("events"), F.count_if(A.blocks()).alias("blocks"), F.count_if(A.warns()).alias("warnings")]
    return {
        "metrics": events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "layer").agg(*counts),
        "patterns": events.filter("pattern_id IS NOT NULL").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("matches"), F.max(F.struct("ts", "id", "severity", "layer")).alias("last")),
        "layers": events.groupBy("layer").agg(*counts, F.max("ts").alias("last_invoked")),
    }


def event_sink(events: DataFrame, path: str, checkpoint: str, statistics: bool = False, **trigger) -> StreamingQuery:
    """Append each micro-batch to Parquet under its batch id, so a batch written twice replaces itself.

    statistics: the batch's partial aggregates go beside it under the same id, so a repeated batch counts once, and reading them
    (`sink_metrics`, `sink_patterns`, `sink_layers`) folds a few rows a batch and never the events.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if not statistics:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            return
        batch = batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{path}/events/batch_id={batch_id}")
            for name, part in partial_statistics(batch).items():
                part.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sink_metrics(spark: SparkSession, path: str, unit: str = "day") -> DataFrame:
    """`analytics.metrics` of all events of a sink with statistics; units from an hour up."""
    hours = spark.read.parquet(f"{path}/metrics").select(F.date_trunc(unit, "hour").alias("bucket"), "layer", "events", "blocks", "warnings")
    total = lambda c: F.sum(c).cast("double").alias(c)
    wide = hours.groupingSets([["bucket", "layer"], ["bucket"]], "bucket", "layer").agg(total("events"), total("blocks"), total("warnings"))
    return wide.unpivot(["bucket", "layer"], ["events", "blocks", "warnings"], "metric", "value")


def sink_patterns(spark: SparkSession, path: str) -> DataFrame:
    """`analytics.pattern_statistics` of all events of a sink with statistics."""
    folded = spark.read.parquet(f"{path}/patterns").groupBy("pattern_id").agg(F.sum("matches").alias("matches"), F.max("last").alias("last"))
    return folded.select("pattern_id", "matches", F.col("last.ts").alias("last_matched"), F.col("last.severity").alias("severity"), F.col("last.layer").alias("layer"))


def sink_layers(spark: SparkSession, path: str, layers: DataFrame) -> DataFrame:
    """`analytics.layer_statistics` of all events of a sink with statistics."""
    folded = spark.read.parquet(f"{path}/layers").groupBy("layer").agg(F.sum("events").alias("invocations"), F.sum("blocks").alias("blocks"), F.sum("warnings").alias("warnings"), F.max("last_invoked").alias("last_invoked"))
    return layers.select("layer", "name").join(folded, "layer", "left").fillna(0, ["invocations", "blocks", "warnings"])


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session_id, start, end, n) of runs of events no further apart than `gap`."""
    return events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """At-least-once input made idempotent by session, time and content."""
    keyed = events.withColumn("content_hash", F.xxhash64(*[c for c in events.columns]))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "ts", "content_hash"])


STATE_FIELDS = "taint int, calls long, writes long, shells long, fetches long, mcps long, last_tool string, run long, bytes long, cost double, level int, detections long, near long"
START = {"taint": 0, "calls": 0, "writes": 0, "shells": 0, "fetches": 0, "mcps": 0, "last_tool": "", "run": 0, "bytes": 0, "cost": 0.0, "level": 0, "detections": 0, "near": 0}
OUTPUT = "session_id string, id long, taint_level int, calls long, file_writes long, shell_commands long, web_fetches long, mcp_calls long, consecutive long, total_bytes long, total_cost double, spend_level int, escalation string"


def step(state: dict, call: dict) -> dict:
    """The state of a session after one call; the batch windows of `operators.sessions` say the same in closed form."""
    s, tool = dict(state), call["tool_name"]
    s["taint"] = max(s["taint"], int(call["call_level"]))
    s["calls"] += 1
    s["writes"] += tool in ("Write", "Edit")
    s["shells"] += tool == "Bash"
    s["fetches"] += tool == "WebFetch"
    s["mcps"] += tool.startswith("mcp__")
    s["run"] = s["run"] + 1 if tool == s["last_tool"] else 1
    s["last_tool"] = tool
    s["bytes"] += int(call["bytes"])
    s["cost"] += float(call["cost"])
    if s["level"] < len(W.SPEND_LEVELS) and s["cost"] >= W.SPEND_LEVELS[s["level"]]:
        s["level"] += 1  # one level a call at most
    s["detections"] += bool(call["detected"])
    s["near"] += bool(call["near_miss"])
    return s


def escalation_of(state: dict) -> str:
    signals = state["detections"] + state["near"] // 2
    return "CRITICAL" if signals >= 5 else "ELEVATED" if signals >= 3 else "NORMAL"


OUT_ROWS = 1000
COLUMNS = [f.split()[0] for f in OUTPUT.split(", ")]


def row_of(session_id: str, call: dict, state: dict) -> tuple:
    return (session_id, call["id"], state["taint"], state["calls"], state["writes"], state["shells"], state["fetches"], state["mcps"], state["run"], state["bytes"], state["cost"], state["level"], escalation_of(state))


def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """Rows of all batches by (ts, id), nulls last. They are a session's share of one micro-batch, so the trigger bounds them."""
    frames = [b for b in batches if len(b)]
    if frames:
        rows = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        rows = rows.sort_values(["ts", "id"], kind="stable")
        for low in range(0, len(rows), OUT_ROWS):
            yield from rows.iloc[low : low + OUT_ROWS].to_dict("records")


def millis(ts) -> int | None:
    return None if pd.isna(ts) else int(pd.Timestamp(ts).value // 1_000_000)


class SessionState(StatefulProcessor):
    """Keyed state of a session; rows of a micro-batch are put in order first, batches count as they arrive.

    idle_ms: a session without a call for so long, in event time, is evicted: its state goes and a row with its last state
    says so. If it comes back it starts anew.
    """

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE_FIELDS + ", seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [*START, "seen"]
        state = dict(zip(names, self.state.get())) if self.state.exists() else START | {"seen": 0}
        out, columns = [], COLUMNS + ["evicted"] * bool(self.idle_ms)
        for call in in_order(iter(rows)):
            state = step(state, call)
            state["seen"] = max(state["seen"], millis(call["ts"]) or 0)
            out.append(row_of(key[0], call, state) + (False,) * bool(self.idle_ms))
            if len(out) == OUT_ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
        self.state.update(tuple(state[n] for n in names))
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(state["seen"] + self.idle_ms)
        yield pd.DataFrame(out, columns=columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        state = dict(zip([*START, "seen"], self.state.get()))
        self.state.clear()
        last = row_of(key[0], {"id": None}, state) + (True,)
        yield pd.DataFrame([last], columns=[*COLUMNS, "evicted"]).astype({"id": "Int64"})

    def close(self) -> None:
        pass


def prepared_calls(calls: DataFrame) -> DataFrame:
    """What `step` reads of a call, as columns; works on a stream and on a table."""
    level = F.when(F.col("tool_name") == "Read", S.path_sensitivity(F.coalesce("file_path", F.lit("")))).when(S.credential_command(F.col("command")), 3).otherwise(0)
    tokens = S.token_estimate(F.col("input_chars"))
    return calls.select("session_id", "id", "ts", "tool_name", level.cast("int").alias("call_level"), F.coalesce("bytes", F.lit(0)).alias("bytes"), S.call_cost(tokens, tokens).alias("cost"), F.col("severity").isin("CRITICAL").alias("detected"), F.col("severity").isin("HIGH").alias("near_miss"))


def session_states(calls: DataFrame, idle: str | None = None, late: str = "1 hour") -> DataFrame:
    """Streaming taint, counters, egress, spend and escalation of each call. Needs the RocksDB state store.

    idle: an interval such as `12 hours`. Sessions idle for longer, by event time and the watermark (`late`), are evicted, which a row with
    `evicted` and no id says; calls later than the watermark are dropped. Without it state has no limit and nothing is dropped.
    """
    if idle is None:
        return prepared_calls(calls).groupBy("session_id").transformWithStateInPandas(SessionState(), OUTPUT, "Append", "None")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = prepared_calls(calls.withWatermark("ts", late))
    return rows.groupBy("session_id").transformWithStateInPandas(SessionState(idle_ms), OUTPUT + ", evicted boolean", "Append", "EventTime")


def session_fold(calls: DataFrame) -> DataFrame:
    """The same step over a table, for parity with the stream: sorted rows pass once, only the state of the session at hand is kept."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for call in batch.to_dict("records"):
                session = None if pd.isna(call["session_id"]) else call["session_id"]
                if state is None or session != key:
                    key, state = session, dict(START)
                state = step(state, call)
                out.append(row_of(key, call, state))
            yield pd.DataFrame(out, columns=COLUMNS)

    order = [F.col("session_id"), F.col("ts").asc_nulls_last(), F.col("id").asc_nulls_last()]
    return prepared_calls(calls).repartition("session_id").sortWithinPartitions(*order).mapInPandas(fold, OUTPUT)
