"""Window operators over sessions: taint, counters, egress, spend, escalation, last-N.

All share one window, by session and ordered by (ts, id), so Spark plans one exchange and one sort for them.
The current call counts.

A window brings a session into one task. `all_in_blocks` gives the same columns where a session may hold a large share of all rows: sessions
are cut into blocks of time, a block is summed up in one row, the sums of the blocks before are a prefix over those rows, and windows run inside
blocks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.shared import cut_lineage

BY = "session_id"
ORDER = ["ts", "id"]
#: Spend thresholds in dollars, level by level. Fixed values.
SPEND_LEVELS = (5.0, 10.0, 20.0)


def running() -> Window:
    return Window.partitionBy(BY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)


def ordered() -> Window:
    return Window.partitionBy(BY).orderBy(*ORDER)


def call_level() -> Column:
    return F.when(F.col("tool_name") == "Read", S.path_sensitivity(F.coalesce("file_path", F.lit("")))).when(S.credential_command(F.col("command")), 3).otherwise(0)


def taint(calls: DataFrame) -> DataFrame:
    """`calls` with call_level, taint_level (running maximum, never falling), taint_source and taint_time of its last rise."""
    calls = calls.withColumn("call_level", call_level()).withColumn("taint_level", F.max("call_level").over(running()))
    rises = F.col("call_level") > F.coalesce(F.lag("taint_level").over(ordered()), F.lit(0))
    source = F.coalesce("file_path", F.concat(F.lit("command:"), F.substring("command", 1, 60)))
    calls = calls.withColumns({"_source": F.when(rises, source), "_time": F.when(rises, F.col("ts"))})
    return calls.withColumns({"taint_source": F.last("_source", ignorenulls=True).over(running()), "taint_time": F.last("_time", ignorenulls=True).over(running())}).drop("_source", "_time")


def call_kinds() -> dict[str, Column]:
    """Counter -> whether a call counts."""
    tool = F.col("tool_name")
    return {
        "file_writes": tool.isin("Write", "Edit"), "shell_commands": tool == "Bash", "web_fetches": tool == "WebFetch", "web_searches": tool == "WebSearch", "skill_invokes": tool == "Skill", "mcp_calls": tool.startswith("mcp__"),
        "sensitive_reads": (tool == "Read") & (S.path_sensitivity(F.coalesce("file_path", F.lit(""))) > 0),
    }


def trajectory(calls: DataFrame) -> DataFrame:
    """`calls` with running counts: calls, file_writes, shell_commands, web_fetches, web_searches, skill_invokes, mcp_calls, sensitive_reads."""
    kinds = call_kinds()
    counts = {name: F.sum(test.cast("long")).over(running()) for name, test in kinds.items()}
    return calls.withColumns({"calls": F.count(F.lit(1)).over(running())} | counts)


def consecutive(calls: DataFrame) -> DataFrame:
    """`calls` with `consecutive`: length so far of the run of one tool."""
    change = (F.col("tool_name") != F.coalesce(F.lag("tool_name").over(ordered()), F.lit(""))).cast("int")
    marked = calls.withColumn("_change", change).withColumn("_run", F.sum("_change").over(running()))
    return marked.withColumn("consecutive", F.row_number().over(Window.partitionBy(BY, "_run").orderBy(*ORDER))).drop("_change", "_run")


# --- the same for sessions of any size -----------------------------------------------------------------------

#: Rows of a session from which on it is cut into blocks of about so many; blocks of a session at most.
BLOCK_ROWS, MAX_BLOCKS = 1_000_000, 1000
#: Bounds of blocks that are sent to every task, so that no session's rows meet in one task to get them; above, Spark shuffles.
SENT_BOUNDS = 2_000_000


def with_blocks(calls: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`calls` with `_block`: 0, 1, ... in the order of ts inside a session of more than `block_rows` rows, else 0. Equal times share a block."""
    sizes = calls.groupBy(BY).agg(F.count(F.lit(1)).alias("_n"))
    largest, many = sizes.agg(F.max("_n"), F.count_if(F.col("_n") > block_rows)).first()
    parts = min(MAX_BLOCKS, -(-(largest or 0) // block_rows))
    if parts < 2:
        return calls.withColumn("_block", F.lit(0))
    hot = sizes.filter(F.col("_n") > block_rows).select(F.col(BY).alias("_s"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    small = F.broadcast if many * parts <= SENT_BOUNDS else lambda df: df
    large = calls.join(small(hot), F.col(BY).eqNullSafe(F.col("_s")))
    bounds = large.groupBy("_s").agg(F.percentile_approx(micros, [k / parts for k in range(1, parts)], 10 * MAX_BLOCKS).alias("_bounds"))
    out = calls.join(small(bounds), F.col(BY).eqNullSafe(F.col("_s")), "left").withColumn("_block", F.lit(0))
    # How many bounds lie before a row, by halving: a step looks at one bound.
    for step in (1 << k for k in reversed(range((parts - 1).bit_length()))):
        out = out.withColumn("_block", F.col("_block") + F.when(F.get("_bounds", F.col("_block") + (step - 1)) < micros, step).otherwise(0))
    return out.withColumn("_block", F.when(micros.isNull(), -1).otherwise(F.col("_block"))).drop("_s", "_bounds")


def running_in_blocks(blocked: DataFrame, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """`blocked` with running values of a session up to and with the row: name -> (sum, max, last or first, expression); last and first skip nulls."""
    inside = Window.partitionBy(BY, "_block").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(BY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    place = lambda v: F.when(v.isNotNull(), F.struct(*ORDER, v.alias("v")))
    whole = {"sum": lambda v: F.sum(v), "max": lambda v: F.max(v), "last": lambda v: F.max(place(v))["v"], "first": lambda v: F.min(place(v))["v"]}
    over = {"sum": lambda v, w: F.sum(v).over(w), "max": lambda v, w: F.max(v).over(w), "last": lambda v, w: F.last(v, ignorenulls=True).over(w), "first": lambda v, w: F.first(v, ignorenulls=True).over(w)}
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a), "first": lambda a, b: F.coalesce(a, b)}
    rows = blocked.withColumns({f"_v_{name}": v for name, (_, v) in values.items()})
    sums = rows.groupBy(BY, "_block").agg(*[whole[kind](F.col(f"_v_{name}")).alias(f"_p_{name}") for name, (kind, _) in values.items()])
    prefix = sums.select(F.col(BY).alias("_s"), F.col("_block").alias("_k"), *[over[kind](F.col(f"_p_{name}"), before).alias(f"_p_{name}") for name, (kind, _) in values.items()])
    met = rows.join(prefix, F.col(BY).eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_k")))
    out = met.withColumns({name: both[kind](F.col(f"_p_{name}"), over[kind](F.col(f"_v_{name}"), inside)) for name, (kind, _) in values.items()})
    return out.drop("_s", "_k", *[f"_v_{n}" for n in values], *[f"_p_{n}" for n in values])


def least_of_session(blocked: DataFrame, values: dict[str, Column]) -> DataFrame:
    """`blocked` with the least value of the whole session: name -> expression. Rows meet them by block, as a session's rows would fill one task."""
    sums = blocked.groupBy(BY, "_block").agg(*[F.min(v).alias(name) for name, v in values.items()])
    least = sums.select(F.col(BY).alias("_s"), F.col("_block").alias("_k"), *[F.min(name).over(Window.partitionBy(BY)).alias(name) for name in values])
    return blocked.join(least, F.col(BY).eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_k"))).drop("_s", "_k")


def consecutive_in_blocks(blocked: DataFrame) -> DataFrame:
    """`consecutive` of a blocked table: a run that began in a block before goes on where all rows of the block so far have one tool."""
    inside = Window.partitionBy(BY, "_block").orderBy(*ORDER)
    change = (F.coalesce("tool_name", F.lit("")) != F.coalesce(F.lag(F.coalesce("tool_name", F.lit(""))).over(inside), F.coalesce("tool_name", F.lit("")))).cast("int")
    rows = blocked.withColumn("_change", change).withColumn("_run", F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_inside", F.row_number().over(Window.partitionBy(BY, "_block", "_run").orderBy(*ORDER)))
    tool, at = F.coalesce("tool_name", F.lit("")), F.struct(*ORDER)
    # Of each block: its last tool, how long the run at its end is, and whether that run is the whole block.
    ends = rows.groupBy(BY, "_block").agg(F.max_by(tool, at).alias("tool"), F.max_by("_inside", at).cast("long").alias("n"), (F.max("_run") == 0).alias("whole"))
    ordered_ends = ends.groupBy(BY).agg(F.array_sort(F.collect_list(F.struct("_block", "tool", "n", "whole"))).alias("ends"))  # at most MAX_BLOCKS of a session
    start = F.struct(F.array().cast("array<struct<k: int, tool: string, n: bigint>>").alias("seen"), F.lit("").alias("tool"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, e: Column) -> Column:
        joins = e["whole"] & (e["tool"] == acc["tool"])
        seen = F.array_append(acc["seen"], F.struct(e["_block"].alias("k"), acc["tool"].alias("tool"), acc["n"].alias("n")))
        return F.struct(seen.alias("seen"), e["tool"].alias("tool"), F.when(joins, acc["n"] + e["n"]).otherwise(e["n"]).alias("n"))

    carried = ordered_ends.select(F.col(BY).alias("_s"), F.explode(F.aggregate("ends", start, step, lambda acc: acc["seen"])).alias("c")).select("_s", F.col("c.k").alias("_k"), F.col("c.tool").alias("_tool"), F.col("c.n").alias("_n"))
    met = rows.join(carried, F.col(BY).eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_k")))
    goes_on = (F.col("_run") == 0) & (tool == F.col("_tool"))
    return met.withColumn("consecutive", (F.col("_inside") + F.when(goes_on, F.col("_n")).otherwise(0)).cast("int")).drop("_s", "_k", "_tool", "_n", "_change", "_run", "_inside")


def all_in_blocks(calls: DataFrame, detected: Column, near_miss: Column, block_rows: int = BLOCK_ROWS, limit: int = 20 * 1024 * 1024, levels: tuple[float, ...] = SPEND_LEVELS) -> DataFrame:
    """What `taint`, `trajectory`, `consecutive`, `egress`, `spend` and `escalation` add to `calls`, but no session is one task's.

    Costs are added up in another order than by a window, so `total_cost` may differ in its last digits.
    """
    tokens = S.token_estimate(F.col("input_chars"))
    calls = calls.withColumns({"call_level": call_level(), "cost": S.call_cost(tokens, tokens)})
    # Each step reads its table twice, rows and their sums, so tables are written between steps and not computed again and again.
    blocked = cut_lineage(with_blocks(calls, block_rows))
    sums = {name: ("sum", test.cast("long")) for name, test in call_kinds().items()}
    sums |= {"calls": ("sum", F.lit(1).cast("long")), "total_bytes": ("sum", F.coalesce("bytes", F.lit(0))), "total_cost": ("sum", F.col("cost")), "detections": ("sum", detected.cast("long")), "near_misses": ("sum", near_miss.cast("long"))}
    seen = F.when(detected, F.col("ts"))
    rows = running_in_blocks(blocked, sums | {"taint_level": ("max", F.col("call_level")), "first_detection": ("first", seen), "last_detection": ("last", seen)})
    rows = cut_lineage(consecutive_in_blocks(cut_lineage(rows)))
    # A rise: the level is new in the session, so the first row that has it.
    places = F.struct(*ORDER)
    rows = least_of_session(rows, {f"_first{k}": F.when(F.col("call_level") == k, places) for k in (1, 2, 3)})
    rises = (F.col("call_level") == F.col("taint_level")) & F.coalesce(*[F.when(F.col("call_level") == k, places == F.col(f"_first{k}")) for k in (1, 2, 3)], F.lit(False))
    source = F.coalesce("file_path", F.concat(F.lit("command:"), F.substring("command", 1, 60)))
    rows = rows.withColumns({"_source": F.when(rises, source), "_time": F.when(rises, F.col("ts"))}).drop("_first1", "_first2", "_first3")
    rows = running_in_blocks(rows, {"taint_source": ("last", F.col("_source")), "taint_time": ("last", F.col("_time"))}).drop("_source", "_time")
    rows = cut_lineage(rows)
    # The call at which each spend threshold is first passed, and from these the levels in closed form, as in `spend`.
    rows = least_of_session(rows, {f"_f{k}": F.when(F.col("total_cost") >= x, F.col("calls")) for k, x in enumerate(levels)})
    rows = rows.drop("_block").withColumnRenamed("calls", "_calls").withColumn("calls", F.col("_calls")).drop("_calls")
    at, before = [], None
    for k in range(len(levels)):
        before = F.col(f"_f{k}") if before is None else F.when(F.col(f"_f{k}").isNotNull() & before.isNotNull(), F.greatest(F.col(f"_f{k}"), before + 1))
        at.append(before)
    level = sum((F.coalesce((t <= F.col("calls")).cast("int"), F.lit(0)) for t in at), F.lit(0))
    alert = F.coalesce(*[F.when(t == F.col("calls"), F.lit(k)) for k, t in enumerate(at, 1)])
    signals = F.col("detections") + F.floor(F.col("near_misses") / 2)
    named = F.when(signals >= 5, "CRITICAL").when(signals >= 3, "ELEVATED").otherwise("NORMAL")
    return rows.withColumns({"spend_level": level, "spend_alert": alert, "escalation": named, "over_limit": F.col("total_bytes") > limit, "n": F.col("calls").cast("int")}).drop(*[f"_f{k}" for k in range(len(levels))])


def egress(calls: DataFrame, limit: int = 20 * 1024 * 1024) -> DataFrame:
    """`calls` with total_bytes so far and whether it passes the session limit."""
    return calls.withColumn("total_bytes", F.sum(F.coalesce("bytes", F.lit(0))).over(running())).withColumn("over_limit", F.col("total_bytes") > limit)


def spend(calls: DataFrame, levels: tuple[float, ...] = SPEND_LEVELS) -> DataFrame:
    """`calls` with n, cost, total_cost, spend_level and spend_alert: at most one level up a call.

    Level i is reached at t_i = greatest(first call with cost >= threshold i, t_(i-1) + 1); no loop is needed.
    """
    tokens = S.token_estimate(F.col("input_chars"))
    calls = calls.withColumns({"n": F.row_number().over(ordered()), "cost": S.call_cost(tokens, tokens)}).withColumn("total_cost", F.sum("cost").over(running()))
    whole = Window.partitionBy(BY)
    at, before = [], None
    for limit in levels:
        first = F.min(F.when(F.col("total_cost") >= limit, F.col("n"))).over(whole)
        t = first if before is None else F.when(first.isNotNull() & before.isNotNull(), F.greatest(first, before + 1))
        at.append(t)
        before = t
    level = sum((F.coalesce((t <= F.col("n")).cast("int"), F.lit(0)) for t in at), F.lit(0))
    alert = F.coalesce(*[F.when(t == F.col("n"), F.lit(k)) for k, t in enumerate(at, 1)])
    return calls.withColumns({"spend_level": level, "spend_alert": alert})


def escalation(rows: DataFrame, detected: Column, near_miss: Column) -> DataFrame:
    """`rows` with detections, near_misses, escalation (signals = detections + near_misses / 2: 3 ELEVATED, 5 CRITICAL) and first and last detection."""
    rows = rows.withColumns({"detections": F.sum(detected.cast("long")).over(running()), "near_misses": F.sum(near_miss.cast("long")).over(running())})
    signals = F.col("detections") + F.floor(F.col("near_misses") / 2)
    when = F.when(detected, F.col("ts"))
    return rows.withColumns({"escalation": F.when(signals >= 5, "CRITICAL").when(signals >= 3, "ELEVATED").otherwise("NORMAL"), "first_detection": F.first(when, ignorenulls=True).over(running()), "last_detection": F.last(when, ignorenulls=True).over(running())})


def escalated_action(action: Column, level: Column) -> Column:
    return F.when((level == "CRITICAL") & action.isin("WARN", "LOG"), "ALERT").when((level == "ELEVATED") & (action == "WARN"), "ALERT").otherwise(action)


def level_changes(rows: DataFrame) -> DataFrame:
    """`rows` with level_changed: the escalation differs from that before."""
    return rows.withColumn("level_changed", F.col("escalation") != F.coalesce(F.lag("escalation").over(ordered()), F.lit("NORMAL")))


def uniform_intervals(rows: DataFrame) -> DataFrame:
    """(session_id, n, uniform): five times or more, with one interval between all, in steps of 10 ms."""
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    gap = F.round((ms - F.lag(ms).over(ordered())) / 10)
    return rows.withColumn("_gap", gap).groupBy(BY).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_gap").alias("gaps")).select(BY, "n", ((F.col("n") >= 5) & (F.col("gaps") == 1)).alias("uniform"))


def sensitive_reads(calls: DataFrame, limit: int = 100) -> DataFrame:
    """The first reads of sensitive paths in each session, with their level and place."""
    level = S.path_sensitivity(F.coalesce("file_path", F.lit("")))
    reads = calls.filter(F.col("tool_name") == "Read").withColumn("level", level).filter("level > 0")
    return reads.withColumn("place", F.row_number().over(ordered())).filter(F.col("place") <= limit)


def last_n(rows: DataFrame, n: int = 100) -> DataFrame:
    back = Window.partitionBy(BY).orderBy(*[F.desc(c) for c in ORDER])
    return rows.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n).drop("_back")


def top_in_category(rows: DataFrame, category: str, n: int) -> DataFrame:
    """The n most severe rows of each category, earliest first at a tie."""
    w = Window.partitionBy(category).orderBy(F.desc(S.severity_rank(F.col("severity"))), *ORDER)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def trajectory_violations(calls: DataFrame) -> DataFrame:
    """(session_id, rule, first_ts): the first call at which each trajectory limit is passed."""
    state = consecutive(trajectory(taint(calls)))
    limits = {
        "secret_taint_over_50_calls": "taint_level >= 3 AND calls >= 50",
        "confidential_taint_over_10_webfetch": "tool_name = 'WebFetch' AND taint_level >= 2 AND web_fetches >= 10",
        "confidential_taint_over_50_shell": "tool_name = 'Bash' AND taint_level >= 2 AND shell_commands >= 50",
        "consecutive_same_tool_over_20": "consecutive >= 20 AND taint_level >= 1",
    }
    hit = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in limits.items()]))
    return state.select(BY, "ts", F.explode(hit).alias("rule")).groupBy(BY, "rule").agg(F.min("ts").alias("first_ts"))
