"""Readers and writers: audit logs, transcripts, corpora, images, layers, session reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..rules import packs

AUDIT_SCHEMA = (
    "timestamp timestamp, session_id string, sessionId string, tool string, tool_name string, severity string, risk_level string, action string, blocked boolean, "
    "pattern_id string, patterns_matched array<string>, triggers array<string>, description string, block_reason string, file_path string, matched_text string, "
    "policy_matched string, findings array<struct<name:string,severity:string,match:string,category:string>>, _bad string"
)
#: Log names, in both spellings in use: (layer, hook type). Fixed values.
LOG_LAYERS = {
    "secure-code-enforcer": ("L0", "PreToolUse"), "governor": ("L1", "PreToolUse"), "secure-code-linter": ("L2", "PostToolUse"), "memory-validation": ("L3", "Pre+PostToolUse"),
    "injection-scanner": ("L4", "PostToolUse"), "output-sanitizer": ("L5", "PostToolUse"), "image-safety": ("L7", "PostToolUse"), "egress-scanner": ("L9", "PreToolUse"),
    "supply-chain": ("L14", "PostToolUse"), "skill-scanner": ("L19", "PreToolUse"),
}
CODE_EXCLUDES = ("node_modules", ".git")


def layer_map(spark: SparkSession) -> DataFrame:
    """(log, layer, hook_type), a name in its plain form."""
    return spark.createDataFrame([(k, *v) for k, v in LOG_LAYERS.items()], "log string, layer string, hook_type string")


def plain_log_name(file: Column) -> Column:
    """`L1-governor-agent-audit.jsonl` and `governor-audit.jsonl` are both `governor`."""
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.jsonl$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^L\d+-", ""), r"-audit$", ""), r"-(agent|scanner-hook)$", "")


def read_audit_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.jsonl in a folder, bad lines in `_bad`, with `log`, `layer` and `hook_type` from the file name."""
    raw = spark.read.schema(AUDIT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.jsonl").json(folder)
    named = raw.withColumn("file", F.col("_metadata.file_name")).withColumn("log", plain_log_name(F.col("file")))
    return with_layer(named, layer_map(spark))


def with_layer(entries: DataFrame, layers: DataFrame) -> DataFrame:
    """Layer and hook type by log name; `Unknown` without one. The map has about ten rows."""
    return entries.join(F.broadcast(layers), "log", "left").withColumns({"layer": F.coalesce("layer", F.lit("Unknown")), "hook_type": F.coalesce("hook_type", F.lit("Unknown"))})


def ingest_accounting(logs: DataFrame) -> DataFrame:
    """(file, processed, inserted, errors) for each file and, with a null file, in total."""
    return logs.rollup("file").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("_bad").isNull()).alias("inserted"), F.count_if(F.col("_bad").isNotNull()).alias("errors"))


def normalise_entries(entries: DataFrame, strict: bool = False) -> DataFrame:
    """Audit entries as events. strict: only lower-case actions count, as some older writers expect."""
    action = F.col("action") if strict else F.lower("action")
    severity = F.upper(F.coalesce(F.nullif("risk_level", F.lit("")), F.nullif("severity", F.lit("")), F.lit("LOW")))
    pattern = F.coalesce("pattern_id", F.get("patterns_matched", F.lit(0)), F.get("triggers", F.lit(0)))
    verdict = F.when(F.coalesce("blocked", F.lit(False)) | F.coalesce(action == "block", F.lit(False)), "block").when(severity == "CRITICAL", "alert").when((severity == "HIGH") | F.coalesce(action == "warn", F.lit(False)), "warn").otherwise("log")
    return entries.select(
        "timestamp", F.coalesce("session_id", "sessionId").alias("session_id"), "layer", "hook_type", F.coalesce("tool", "tool_name").alias("tool_name"), severity.alias("severity"), S.severity_rank(severity).alias("severity_rank"),
        verdict.alias("action"), pattern.alias("pattern_id"), F.coalesce("description", "block_reason").alias("description"), "file_path", "matched_text", F.to_json(F.struct("*")).alias("metadata"),
    )


def append_events(events: DataFrame, path: str, as_of: Column) -> None:
    """Append to Parquet by date; empty strings are null, a missing time is `as_of`."""
    clean = events.select(*[F.nullif(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in events.dtypes])
    clean = clean.withColumn("timestamp", F.coalesce("timestamp", as_of)).withColumn("event_date", F.to_date("timestamp"))
    clean.write.mode("append").partitionBy("event_date").parquet(path)


def session_log(rows: DataFrame, session: str | None, as_of: Column, session_col: str = "session_id", ts_col: str = "ts", hours: int = 4) -> DataFrame:
    """Rows of the session or of none, not older than some hours; a missing time passes."""
    mine = F.lit(True) if session is None else F.col(session_col).isNull() | (F.col(session_col) == session)
    return rows.filter(mine & (F.col(ts_col).isNull() | (F.col(ts_col) >= as_of - F.expr(f"INTERVAL {hours} HOURS"))))


TRANSCRIPT_SCHEMA = "session_id string, line long, type string, timestamp timestamp, message struct<role:string,content:array<struct<type:string,text:string,name:string,input:string,content:string>>>"


def transcript_events(lines: DataFrame, last: int = 100, cut: int = 500) -> DataFrame:
    """(session_id, no, kind, text, tool): user texts, blocks joined, and a `tool` event for each assistant tool_use; the last ones of a session."""
    blocks = F.col("message.content")
    text = F.trim(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n"))
    user = lines.filter("type = 'user'").select("session_id", "line", F.lit(0).alias("pos"), F.lit("user").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("tool"))
    user = user.filter((F.col("text") != "") & ~F.col("text").startswith("<system-reminder>")).withColumn("text", F.substring("text", 1, cut))
    tools = lines.filter("type = 'assistant'").select("session_id", "line", F.posexplode(blocks).alias("pos", "b")).filter("b.type = 'tool_use'").select("session_id", "line", "pos", F.lit("tool"), F.lit(None).cast("string"), F.col("b.name"))
    both = user.union(tools)
    place = Window.partitionBy("session_id").orderBy("line", "pos")
    back = Window.partitionBy("session_id").orderBy(F.desc("line"), F.desc("pos"))
    return both.withColumns({"no": F.row_number().over(place), "_back": F.row_number().over(back)}).filter(F.col("_back") <= last).select("session_id", "no", "kind", "text", "tool")


def subagent_text(turns: DataFrame, by: str, order: list[str], text: str = "text", least: int = 10) -> DataFrame:
    """(by, output): the texts of each conversation in order, joined by line ends; short ones are dropped."""
    joined = turns.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("t"))
    return joined.select(by, F.array_join(F.transform("t", lambda x: x[text]), "\n").alias("output")).filter(F.length("output") >= least)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,bmp,webp}").load(folder)


def numbered_lines(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, line, text): the lines of all files of a folder and below, numbered from 1 in each file.

    Files are read in splits, so one file of any size is many tasks' work. A split counts its own lines, and a line's number is its place in its split
    plus the lines of the file's splits before: a prefix over one row a split. Lines end with \\n or \\r\\n.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(folder)
    rows = raw.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").alias("text")).withColumn("_i", F.monotonically_increasing_id())
    rows = rows.select(F.col("file_path").alias("path"), F.col("file_block_start").alias("_at"), "_i", F.regexp_replace("text", "\r$", "").alias("text"))
    # Rows of a split stand together in their task, so their ids have no gaps; both readings of the files cut them alike.
    splits = rows.groupBy("path", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(starts, ["path", "_at"]).select("path", (F.col("_before") + F.col("_i") - F.col("_first") + 1).alias("line"), "text")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, language, scanner): every file, without the excluded folders, and the scanner its type goes to."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for x in CODE_EXCLUDES:
        files = files.filter(~F.col("path").contains(f"/{x}/"))
    lang, ext = S.language(F.col("path")), S.extension(F.col("path"))
    scanner = F.when(ext.isin(".md", ".txt"), "injection").when(ext == ".json", "config").when(ext.isin(".html", ".vue", ".svelte"), "output").when(lang != "unknown", "code").otherwise("secret")
    return files.withColumns({"language": lang, "scanner": scanner})


def layers(spark: SparkSession) -> DataFrame:
    """(layer, name, hook_type, owasp, atlas, layer_num)."""
    rows = spark.createDataFrame([(a, b, c, list(d), list(e)) for a, b, c, d, e in packs.LAYERS], "layer string, name string, hook_type string, owasp array<string>, atlas array<string>")
    return rows.withColumn("layer_num", F.substring("layer", 2, 3).cast("int"))


def report_map(spark: SparkSession) -> DataFrame:
    """(layer, atlas, owasp, agentic): the ids that a session report maps a layer to; not those of `layers`, which is the seed of the database."""
    return spark.createDataFrame([(a, list(b), list(c), list(d)) for a, b, c, d in packs.REPORT_MAP], "layer string, atlas array<string>, owasp array<string>, agentic array<string>")


def export_report(findings: DataFrame, path: str) -> None:
    """Every session's findings as JSON, a folder for each."""
    findings.write.partitionBy("session_id").json(path)
