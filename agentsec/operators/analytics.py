"""Aggregates, joins, set operations and reports over security events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S



def blocks() -> Column:
    return F.col("action") == "block"


def warns() -> Column:
    return F.col("action").isin("warn", "alert")


def dashboard(events: DataFrame, as_of: Column) -> DataFrame:
    """One row: total_events, blocks, warnings, active_layers, critical_24h; zeros for no events."""
    recent = (F.col("severity") == "CRITICAL") & (F.col("ts") >= as_of - F.expr("INTERVAL 24 HOURS"))
    return events.agg(F.count(F.lit(1)).alias("total_events"), F.count_if(blocks()).alias("blocks"), F.count_if(warns()).alias("warnings"), F.countDistinct("layer").alias("active_layers"), F.count_if(recent).alias("critical_24h"))


def as_of(events: DataFrame) -> DataFrame:
    """(as_of): the latest time, one row."""
    return events.agg(F.max("ts").alias("as_of"))


def with_as_of(events: DataFrame) -> DataFrame:
    """Each row with the latest time of all; the right side is one row."""
    return events.crossJoin(F.broadcast(as_of(events)))


def top_patterns(events: DataFrame, n: int = 10) -> DataFrame:
    return events.filter("pattern_id IS NOT NULL").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern_id").limit(n)


def events_per_hour(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def block_rate(events: DataFrame) -> DataFrame:
    return events.groupBy("layer").agg(F.count(F.lit(1)).alias("total"), F.count_if(blocks()).alias("blocks")).withColumn("block_rate", F.round(100.0 * F.col("blocks") / F.col("total"), 2))


def metrics(events: DataFrame, unit: str = "day") -> DataFrame:
    """(bucket, layer, metric, value) for events, blocks and warnings, by layer and, with a null layer, in all."""
    bucket = F.date_trunc(unit, "ts").alias("bucket")
    wide = events.select(bucket, "layer", "action").groupingSets([["bucket", "layer"], ["bucket"]], "bucket", "layer").agg(F.count(F.lit(1)).cast("double").alias("events"), F.count_if(blocks()).cast("double").alias("blocks"), F.count_if(warns()).cast("double").alias("warnings"))
    return wide.unpivot(["bucket", "layer"], ["events", "blocks", "warnings"], "metric", "value")


def pattern_statistics(events: DataFrame) -> DataFrame:
    latest = F.struct("ts", "id")
    return events.filter("pattern_id IS NOT NULL").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("matches"), F.max("ts").alias("last_matched"), F.max_by("severity", latest).alias("severity"), F.max_by("layer", latest).alias("layer"))


def session_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_events"), F.count_if(blocks()).alias("blocks"), F.count_if(warns()).alias("warnings"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))


def layer_statistics(layers: DataFrame, events: DataFrame) -> DataFrame:
    """Every layer with its counters, 0 without events."""
    counts = events.groupBy("layer").agg(F.count(F.lit(1)).alias("invocations"), F.count_if(blocks()).alias("blocks"), F.count_if(warns()).alias("warnings"), F.max("ts").alias("last_invoked"))
    return layers.select("layer", "name").join(counts, "layer", "left").fillna(0, ["invocations", "blocks", "warnings"])


#: Logs that a session report counts, and how many rows of each it shows. Fixed values.
REPORT_CAPS = {"governor": 50, "injection": 30, "imageSafety": 30, "secureCode": 30, "linter": 30, "leash": 50, "memory": 50, "securityRadar": 50}
#: Of these it shows the severest rows, of the others the first. Fixed values.
SEVEREST_FIRST = ["governor", "injection", "linter", "leash"]


def report_rows() -> Column:
    """Whether a row of the report's logs counts as a finding; linter and radar rows all do, rows of other logs never."""
    log = F.col("log")
    tests = {
        "governor": F.coalesce("policy_matched", F.lit("none")) != "none",
        "injection": F.col("detected"),
        "imageSafety": F.col("detected"),
        "secureCode": F.col("classification") == "SECURITY_SENSITIVE",
        "linter": F.lit(True),
        "leash": F.col("decision") == "DENY",
        "memory": F.col("n_findings") > 0,
        "securityRadar": F.lit(True),
    }
    out = F.lit(False)
    for name, test in tests.items():
        out = F.when(log == name, F.coalesce(test, F.lit(False))).otherwise(out)
    return out


def report_severity() -> Column:
    """The severity a finding counts with: an injection without one is MEDIUM."""
    return F.when(F.col("log") == "injection", F.coalesce(F.nullif("severity", F.lit("")), F.lit("MEDIUM"))).otherwise(F.col("severity"))


def report_shown(rows: DataFrame) -> DataFrame:
    """The findings that a report shows, each with the severity it counts with: of each session and log the first ones, up to its cap.

    Rows are ordered by the severity they have, so that those without any come last.
    """
    first = F.when(F.col("log").isin(*SEVEREST_FIRST), -S.severity_rank(F.col("severity"))).otherwise(0)
    place = F.row_number().over(Window.partitionBy("session_id", "log").orderBy(first, "ts", "id"))
    cap = F.lit(0)
    for name, n in REPORT_CAPS.items():
        cap = F.when(F.col("log") == name, n).otherwise(cap)
    return rows.filter(report_rows()).withColumn("_n", place).filter(F.col("_n") <= cap).drop("_n").withColumn("severity", report_severity())


def report_summary(rows: DataFrame) -> DataFrame:
    """A row for each session: eight counters of findings, errors, tool calls, duration in ms, tokens."""
    at = lambda name, *more: F.count_if(report_rows() & (F.col("log") == name) & (more[0] if more else F.lit(True)))
    return rows.groupBy("session_id").agg(
        at("governor", F.col("severity") != "LOW").alias("policy_violations"),
        at("injection").alias("injection_detections"),
        at("imageSafety").alias("image_detections"),
        at("secureCode").alias("sensitive_writes"),
        at("linter", F.col("reverted")).alias("code_reverts"),
        at("leash").alias("leash_blocks"),
        at("memory").alias("memory_attempts"),
        at("securityRadar").alias("radar_findings"),
        F.count_if(F.col("log") == "error").alias("errors"),
        F.count_if(F.col("log") == "tool").alias("tool_calls"),
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).cast("long").alias("duration_ms"),
        F.sum(S.token_estimate(F.col("input_chars"))).alias("tokens"),
    )


def severity_matrix(rows: DataFrame, display: bool = False) -> DataFrame:
    """(severity, a column for each of the eight logs, total) of the findings. display: of those that reports show."""
    found, names = report_shown(rows) if display else rows.filter(report_rows()).withColumn("severity", report_severity()), sorted(REPORT_CAPS)
    wide = found.groupBy("severity").pivot("log", names).agg(F.count(F.lit(1))).fillna(0)
    return wide.withColumn("total", sum((F.col(c) for c in names), F.lit(0)).cast("long"))


def overall_status(rows: DataFrame) -> DataFrame:
    """(session_id, status): DETECTED with a critical finding shown, a revert, a denial, or a finding of injection, image, memory or radar; WARNINGS with a high one shown or more than two policy violations; else CLEAN."""
    shown = report_shown(rows).groupBy("session_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"))
    all_ = report_summary(rows).join(shown, "session_id", "left").fillna(0, ["critical", "high"])
    bad = sum((F.col(c) for c in ("code_reverts", "leash_blocks", "injection_detections", "image_detections", "memory_attempts", "radar_findings")), F.col("critical"))
    return all_.select("session_id", F.when(bad > 0, "DETECTED").when((F.col("high") > 0) | (F.col("policy_violations") > 2), "WARNINGS").otherwise("CLEAN").alias("status"))


def posture(events: DataFrame, by: str = "session_id") -> DataFrame:
    top = F.max(S.severity_rank(F.col("severity")))
    return events.groupBy(by).agg(top.alias("top")).select(by, F.when(F.col("top") == 4, "CRITICAL").when(F.col("top") == 3, "AT_RISK").otherwise("SECURE").alias("posture"))


ASI = [f"ASI{n:02d}" for n in range(1, 11)]


def agentic_coverage(status: DataFrame, report_map: DataFrame) -> DataFrame:
    """(project, risk, layers, coverage): covered from two active layers, partial from one, else gap; ASI06 is at most partial where L3 is active."""
    covers = report_map.select("layer", F.explode("agentic").alias("risk"))
    risks = status.sparkSession.createDataFrame([(r,) for r in ASI], "risk string")  # ten rows
    active = status.filter("status = 'active'")
    l3 = active.filter("layer = 'L3'").select("project", F.lit(1).alias("l3")).distinct()
    counts = active.join(F.broadcast(covers), "layer").groupBy("project", "risk").agg(F.countDistinct("layer").alias("layers"))
    every = status.select("project").distinct().crossJoin(F.broadcast(risks)).join(counts, ["project", "risk"], "left").join(l3, "project", "left").fillna(0, ["layers", "l3"])
    cover = F.when((F.col("layers") >= 2) & ~((F.col("risk") == "ASI06") & (F.col("l3") == 1)), "covered").when(F.col("layers") >= 1, "partial").otherwise("gap")
    return every.select("project", "risk", "layers", cover.alias("coverage"))


def framework_totals(status: DataFrame, layers: DataFrame, techniques: int = 16, applicable: int = 9) -> DataFrame:
    """(project, active_layers, atlas, atlas_percent, owasp, owasp_percent) of active layers."""
    known = status.filter("status = 'active'").join(F.broadcast(layers.select("layer", "owasp", "atlas")), "layer")
    ids = known.select("project", "layer", F.explode_outer(F.concat(F.transform("owasp", lambda x: F.struct(F.lit("o").alias("k"), x.alias("id"))), F.transform("atlas", lambda x: F.struct(F.lit("a").alias("k"), x.alias("id"))))).alias("x"))
    wide = ids.groupBy("project").agg(F.countDistinct("layer").alias("active_layers"), F.countDistinct(F.when(F.col("x.k") == "a", F.col("x.id"))).alias("atlas"), F.countDistinct(F.when(F.col("x.k") == "o", F.col("x.id"))).alias("owasp"))
    return wide.select("project", "active_layers", "atlas", F.round(100.0 * F.col("atlas") / techniques).cast("long").alias("atlas_percent"), "owasp", F.round(100.0 * F.col("owasp") / applicable).cast("long").alias("owasp_percent"))


def framework_map(layers: DataFrame) -> DataFrame:
    """(layer, technique), many to many."""
    return layers.select("layer", F.explode("atlas").alias("technique"))


def layer_inventory(status: DataFrame) -> DataFrame:
    """(project, status, n), with a null status for all of a project."""
    return status.rollup("project", "status").agg(F.count(F.lit(1)).alias("n")).filter("project IS NOT NULL")


def egress_totals(calls: DataFrame, limit: int = 100) -> DataFrame:
    """(session_id, bytes, requests, destinations): totals and the first `limit` distinct urls in order.

    Urls are counted by session before anything else, and of a session's distinct ones each task sends its first `limit` only.
    """
    urls = calls.filter("url IS NOT NULL").groupBy(F.coalesce("session_id", F.lit("")).alias("_k"), "session_id", "url").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("requests"))
    totals = urls.groupBy("_k").agg(F.first("session_id").alias("session_id"), F.sum("bytes").alias("bytes"), F.sum("requests").alias("requests"))
    place = F.row_number().over(Window.partitionBy("_k").orderBy("url"))
    first = urls.select("_k", "url", place.alias("n")).filter(F.col("n") <= limit)
    names = first.groupBy("_k").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("destinations"))
    return totals.join(names, "_k").drop("_k")


def scan_summary(events: DataFrame) -> DataFrame:
    """(layer, critical, high, medium, low, exit_code): 2 with a critical finding, 1 with a high one, else 0."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
    return events.groupBy("layer").agg(*counts).withColumn("exit_code", F.when(F.col("critical") > 0, 2).when(F.col("high") > 0, 1).otherwise(0))


def evaluator_summary(rows: DataFrame) -> DataFrame:
    """(status, commits, issues) of evaluator results."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("commits"), F.sum("issues").alias("issues"))


def trend(events: DataFrame, days: int = 7) -> DataFrame:
    """(day, n, share) of the last days before the latest event; share is of all those days."""
    recent = with_as_of(events).filter(F.col("ts") >= F.col("as_of") - F.expr(f"INTERVAL {days} DAYS"))
    daily = recent.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row a day


def trend_share(events: DataFrame, by: str, days: int = 7) -> DataFrame:
    """(by, n, share) of the last days: how often each value of a column, such as a pattern or a category, is met."""
    recent = with_as_of(events).filter(F.col("ts") >= F.col("as_of") - F.expr(f"INTERVAL {days} DAYS")).filter(F.col(by).isNotNull())
    counts = recent.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row a value


def status_activity(events: DataFrame) -> DataFrame:
    """(layer, events, critical_24h, high_24h)."""
    rows = with_as_of(events).withColumn("recent", F.col("ts") >= F.col("as_of") - F.expr("INTERVAL 24 HOURS"))
    return rows.groupBy("layer").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("recent") & (F.col("severity") == "CRITICAL")).alias("critical_24h"), F.count_if(F.col("recent") & (F.col("severity") == "HIGH")).alias("high_24h"))


def package_counters(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def findings_by_document(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("rule_id").alias("rules"), S.rank_severity(F.max(S.severity_rank(F.col("severity")))).alias("top"))


# --- filters and sorts --------------------------------------------------------------------------------------


def newest(events: DataFrame, n: int | None = None) -> DataFrame:
    out = events.orderBy(F.desc("ts"), F.desc("id"))
    return out.limit(n) if n else out


def count_in_range(events: DataFrame, start, end, layer: str | None = None) -> DataFrame:
    rows = events.filter(F.col("ts").between(start, end))
    return (rows.filter(F.col("layer") == layer) if layer else rows).agg(F.count(F.lit(1)).alias("n"))


def at_least(events: DataFrame, severity: str) -> DataFrame:
    return events.filter(S.severity_rank(F.col("severity")) >= S.SEVERITIES.index(severity) + 1)


def by_severity(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc(S.severity_rank(F.col("severity"))), "ts", "id")


def reportable(rows: DataFrame) -> DataFrame:
    """Rows of sessions with a policy hit, an injection, a sensitive write, a linter row, a denial, a memory finding or an error."""
    grounds = F.col("log").isin("governor", "injection", "secureCode", "linter", "leash", "memory") & report_rows() | (F.col("log") == "error")
    return rows.join(rows.filter(grounds).select("session_id").distinct(), "session_id", "left_semi")


#: Levels of dyadic blocks: 2^31 units of a second are 68 years.
LEVELS = 31
#: How blocks meet. Spark takes a side for as small as what it was exploded from, so it would send millions of blocks through the driver to broadcast them.
SORTED = "merge"
#: Parts that all events would be dealt to if one block held them, so that a block which all sessions span isn't one task's.
SALTS = 16
#: Blocks on the highest level: all spans together are cut into at most so many.
BLOCKS = 64
#: Bits from one level to the next below it. Few levels, as events are sent once for each.
STEP = 5


def _unit(ts: Column, unit_seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (unit_seconds * 1_000_000)).cast("long")


def span_pieces(sessions: DataFrame, slack: str, unit_seconds: int) -> DataFrame:
    """(session_id, started_at, until, level, block, edge): each span cut into at most two blocks of 2^level units a level, and its two edge units.

    The blocks lie inside the span as a whole; only rows of an edge unit must be compared with the bounds.
    """
    until = F.col("ended_at") + F.expr(f"INTERVAL {slack}")
    spans = sessions.select("session_id", "started_at", until.alias("until")).filter("started_at <= until")
    spans = spans.select("*", _unit(F.col("started_at"), unit_seconds).alias("_a"), _unit(F.col("until"), unit_seconds).alias("_b"))
    low = lambda k: F.call_function("shiftright", F.col("_a") + 1 + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
    high = lambda k: F.call_function("shiftright", F.col("_b"), k)
    piece = lambda k, block, edge: F.struct(k.cast("int").alias("level"), block.alias("block"), F.lit(edge).alias("edge"))
    inside = lambda k: F.array(F.when((low(k) < high(k)) & (low(k) % 2 != 0), piece(k, low(k), False)), F.when((low(k) < high(k)) & (high(k) % 2 != 0), piece(k, high(k) - 1, False)))
    edges = F.array_distinct(F.array(piece(F.lit(0), F.col("_a"), True), piece(F.lit(0), F.col("_b"), True)))
    blocks = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), inside))
    return spans.select("session_id", "started_at", "until", F.explode(F.concat(edges, F.array_compact(blocks))).alias("p")).select("session_id", "started_at", "until", "p.*")


def _levels(pieces: DataFrame) -> list[int]:
    """The levels in use, at most LEVELS numbers."""
    return sorted(r["level"] for r in pieces.select("level").distinct().collect())


def _on_levels(rows: DataFrame, levels: list[int], unit_seconds: int) -> DataFrame:
    """`rows` (ts, ...) once for each level, with its block there."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("_u", k).alias("block")) for k in levels])).alias("_p")
    return rows.withColumn("_u", _unit(F.col("ts"), unit_seconds)).select("*", each).select("*", "_p.level", "_p.block").drop("_u", "_p")


def _filled(start: Column, end: Column, levels: list[int]) -> Column:
    """Array of (level, block): the units from `start` to before `end` as the largest blocks of those levels, from 0 up, that fill them."""
    low = lambda k: F.shiftright(start + ((1 << k) - 1), k)
    high = lambda k: F.shiftright(end, k)
    run = lambda k, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(k).alias("level"), x.alias("block"))))
    runs = [run(levels[-1], low(levels[-1]), high(levels[-1]))]
    for k, up in zip(levels, levels[1:]):
        met = low(up) <= high(up)  # else all lies inside one block of the level above
        runs += [run(k, low(k), F.when(met, F.shiftleft(low(up), up - k)).otherwise(high(k))), F.when(met, run(k, F.shiftleft(high(up), up - k), high(k)))]
    return F.flatten(F.array_compact(F.array(*runs)))


def in_session_window(rows: DataFrame, sessions: DataFrame, slack: str = "60 SECONDS", unit_seconds: int = 60, salts: int = SALTS) -> DataFrame:
    """(session_id, id, ts): rows without a session matched to the sessions whose span, and some slack, holds their time.

    The time of all spans is cut into at most BLOCKS blocks, and these by levels into smaller ones. A span is made up of the largest blocks that fill it,
    so the join is an equality join that makes a row for each pair and hardly any other. An event is sent to its block, and to smaller ones only where a span
    begins or ends; a session to some tens, with its bounds only where rows must be compared with them. So what is shuffled grows with rows and sessions, not
    with pairs. A block's rows are dealt to as many of `salts` parts as its share of all rows asks for; both sides are shuffled and sorted, neither is broadcast.
    Sessions without bounds match nothing here; for them see `in_window_or_last`. Where only the number of rows is wanted, `window_counts` lists no pairs.
    """
    until = F.col("ended_at") + F.expr(f"INTERVAL {slack}")
    spans = sessions.select("session_id", "started_at", until.alias("until")).filter("started_at <= until")
    spans = spans.select("*", _unit(F.col("started_at"), unit_seconds).alias("_a"), _unit(F.col("until"), unit_seconds).alias("_b"))
    first, last = (x or 0 for x in spans.agg(F.min("_a"), F.max("_b")).first())
    top = next(k for k in range(64) if (last >> k) - (first >> k) < BLOCKS)
    levels, blocks = [*range(0, top, STEP), top], range(first >> top, (last >> top) + 1)
    loose = rows.select("id", "ts").withColumn("_t", F.shiftright(_unit(F.col("ts"), unit_seconds), top)).filter(F.col("_t").between(blocks[0], blocks[-1]))
    # both have a row for each of `blocks` at most
    held = dict(loose.groupBy("_t").count().collect())
    cut = [r[0] for r in spans.select(F.explode(F.array(F.shiftright("_a", top), F.shiftright("_b", top)))).distinct().collect()]
    parts = [max(1, -(-held.get(t, 0) * salts // max(1, sum(held.values())))) for t in blocks]
    dealt = F.element_at(F.array(*map(F.lit, parts)), (F.col("_t") - blocks[0] + 1).cast("int"))
    keys, tasks = ["level", "block", "_s"], 4 * sum(parts)  # so many that hardly any gets several of the largest blocks
    events = _on_levels(loose.withColumn("_s", F.pmod(F.xxhash64("id", "ts"), dealt).cast("int")), levels, unit_seconds)
    events = events.filter((F.col("level") == top) | F.col("_t").isin(cut)).select("id", "ts", *keys).repartition(tasks, *keys)
    pieces = spans.select("*", F.explode(_filled(F.col("_a"), F.col("_b") + 1, levels)).alias("_p")).select("*", "_p.*")
    level = F.col("level")
    edge = F.col("block").isin(F.call_function("shiftright", "_a", level), F.call_function("shiftright", "_b", level))
    bounds = [F.when(edge, F.col(c)).alias(c) for c in ("started_at", "until")]
    pieces = pieces.withColumn("_t", F.call_function("shiftright", "block", top - level)).withColumn("_s", F.explode(F.sequence(F.lit(0), dealt - 1)))
    pieces = pieces.select("session_id", *bounds, *keys).repartition(tasks, *keys)
    return events.join(pieces.hint(SORTED), keys).filter(F.col("started_at").isNull() | F.col("ts").between(F.col("started_at"), F.col("until"))).select("session_id", "id", "ts")


def window_counts(rows: DataFrame, sessions: DataFrame, slack: str = "60 SECONDS", unit_seconds: int = 1) -> DataFrame:
    """(session_id, n): how many rows `in_session_window` has for each bounded session, from counts of time blocks, without listing pairs."""
    pieces = span_pieces(sessions, slack, unit_seconds)
    levels = _levels(pieces) or [0]
    by_time = rows.groupBy("ts").agg(F.count(F.lit(1)).alias("_c"))
    blocks = _on_levels(by_time, levels, unit_seconds).groupBy("level", "block").agg(F.sum("_c").alias("_c"))
    whole = pieces.filter("NOT edge").join(blocks.hint(SORTED), ["level", "block"]).select("session_id", "_c")
    near = by_time.withColumn("block", _unit(F.col("ts"), unit_seconds))
    edges = pieces.filter("edge").join(near.hint(SORTED), "block").filter(F.col("ts").between(F.col("started_at"), F.col("until"))).select("session_id", "_c")
    counts = whole.union(edges).groupBy("session_id").agg(F.sum("_c").alias("n"))
    bounded = sessions.filter("started_at IS NOT NULL AND ended_at IS NOT NULL").select("session_id")
    return bounded.join(counts, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("n"))


def in_window_or_last(rows: DataFrame, sessions: DataFrame, n: int = 10, slack: str = "60 SECONDS") -> DataFrame:
    """`in_session_window`, and the last n rows by (ts, id) for each session with no bounds."""
    bounded = F.col("started_at").isNotNull() & F.col("ended_at").isNotNull()
    back = Window.orderBy(F.desc("ts"), F.desc("id"))
    # the limit is taken in each task first, so that the window sees n rows
    last = rows.select("id", "ts").orderBy(F.desc("ts"), F.desc("id")).limit(n).withColumn("_place", F.row_number().over(back)).filter(F.col("_place") <= n).drop("_place")
    unbounded = sessions.filter(~bounded).select("session_id").crossJoin(F.broadcast(last)).select("session_id", "id", "ts")
    return in_session_window(rows, sessions.filter(bounded), slack).unionByName(unbounded)


# --- joins --------------------------------------------------------------------------------------------------


def cached_verdicts(items: DataFrame, cache: DataFrame, as_of: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of items (hash) in a cache (hash, verdict, checked_at), valid for some hours; a malformed hash misses."""
    fresh = cache.filter((F.col("checked_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & F.col("hash").rlike("^[0-9a-f]{64}$"))
    return items.join(fresh, "hash"), items.join(fresh.select("hash"), "hash", "left_anti")


def _bucket_digests(snapshot: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """(_b, name, name_n): an order-free digest of the rows of each hash bucket: their count and sums of two 64-bit hashes."""
    h = lambda seed: F.xxhash64(F.lit(seed), key, "sha256").cast("decimal(38,0)")
    rows = snapshot.groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_b"))
    return rows.agg(F.struct(F.sum(h(1)).alias("a"), F.sum(h(2)).alias("b"), F.count(F.lit(1)).alias("n")).alias(name))


def integrity(baseline: DataFrame, current: DataFrame, key: str = "file", buckets: int = 4096) -> DataFrame:
    """(key, state) of two snapshots (key, sha256), a key once in each: NEW, UNCHANGED, TAMPERED, MISSING.

    Each side is first summed up by hash buckets of the key, a row a bucket. Buckets with equal sums hold equal rows (but for a chance of 2^-128), so
    their rows are UNCHANGED as they are read; only rows of other buckets are shuffled and joined.
    """
    if buckets:
        old, new = _bucket_digests(baseline, key, buckets, "_x"), _bucket_digests(current, key, buckets, "_y")
        same = old.join(new, "_b").filter("_x = _y").select("_b")  # at most `buckets` rows
        placed = lambda rows: rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
        kept = placed(current).join(F.broadcast(same), "_b", "left_semi").select(key, F.lit("UNCHANGED").alias("state"))
        changed = lambda rows: placed(rows).join(F.broadcast(same), "_b", "left_anti").drop("_b")
        return kept.union(integrity(changed(baseline), changed(current), key, 0))
    b, c = baseline.select(key, F.col("sha256").alias("_old")), current.select(key, F.col("sha256").alias("_now"))
    state = F.when(F.col("_old").isNull(), "NEW").when(F.col("_now").isNull(), "MISSING").when(F.col("_old") == F.col("_now"), "UNCHANGED").otherwise("TAMPERED")
    return b.join(c, key, "full_outer").select(key, state.alias("state"))


def untrusted(docs: DataFrame, trusted: DataFrame, on: str = "source") -> tuple[DataFrame, DataFrame]:
    """(to scan, skipped): documents of trusted sources, by exact name, are skipped."""
    return docs.join(trusted, on, "left_anti"), docs.join(trusted, on, "left_semi")


def path_labels(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, level): highest label (pattern, level) that a path contains. The labels are a handful of control rows."""
    met = paths.join(F.broadcast(labels), F.contains(paths["file_path"], labels["pattern"]), "left")
    return met.groupBy("id").agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"))


# --- sets ---------------------------------------------------------------------------------------------------


def timeline(*sources: tuple[DataFrame, str, Column], last: int = 30) -> DataFrame:
    """(session_id, ts, kind, label, place): rows of all sources in order, the last ones of each session."""
    both = None
    for df, kind, label in sources:
        one = df.select("session_id", "ts", "id", F.lit(kind).alias("kind"), label.alias("label"))
        both = one if both is None else both.unionByName(one, allowMissingColumns=True)
    back = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id"), "kind")
    return both.withColumn("place", F.row_number().over(back)).filter(F.col("place") <= last).select("session_id", "ts", "id", "kind", "label", "place")


def session_bounds(*sources: DataFrame) -> DataFrame:
    both = None
    for df in sources:
        one = df.select("session_id", "ts")
        both = one if both is None else both.union(one)
    return both.groupBy("session_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def typosquats(names: DataFrame, popular: DataFrame, most: int = 2) -> DataFrame:
    """(name, near, distance): names within an edit distance of a popular one and not equal to it.

    A name within distance d of another keeps one of its d + 1 pieces whole, at most d places off, so pairs meet on
    (piece, place, popular name's length) and no cross join is needed. A popular name of at most d characters has an empty
    piece: it meets every name whose length is near enough, and such names have few characters.
    """
    parts = most + 1

    def pieces(df: DataFrame, c: str) -> DataFrame:
        n = F.length(c)
        cut = lambda k: F.floor(n * k / parts).cast("int")
        each = [F.struct(F.lit(k).alias("k"), cut(k).alias("at"), F.substring(F.col(c), cut(k) + 1, cut(k + 1) - cut(k)).alias("piece")) for k in range(parts)]
        return df.select(c, F.length(c).alias("n"), F.explode(F.array(*each)).alias("p")).select(c, "n", "p.*")

    target = pieces(popular.select(F.col("name").alias("near")).distinct(), "near").filter(F.length("piece") > 0)
    lengths = target.select("n", "k", "at", F.length("piece").alias("size")).distinct()  # a few rows for each length
    source = names.select("name").distinct().withColumn("m", F.length("name"))
    probes = source.join(F.broadcast(lengths), F.abs(F.col("m") - F.col("n")) <= most).select("name", "n", "k", F.explode(F.sequence(F.greatest(F.col("at") - most, F.lit(0)), F.col("at") + most)).alias("s"), "size")
    probes = probes.select("name", "n", "k", F.substring(F.col("name"), F.col("s") + 1, F.col("size")).alias("piece")).distinct()
    met = probes.join(target.select("near", "n", "k", "piece"), ["n", "k", "piece"]).select("name", "near")
    size = F.length("near")
    short = popular.select(F.col("name").alias("near")).distinct().filter(size <= most).select("near", F.explode(F.sequence(F.greatest(size - most, F.lit(0)), size + most)).alias("m"))
    met = met.union(source.join(short, "m").select("name", "near")).distinct()
    return met.withColumn("distance", F.levenshtein("name", "near", most)).filter("distance > 0")
