"""Registered queries of the security operators, each with the same query in SQL where SQL has what it needs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import analytics as A
from ..operators import policy as G
from ..operators import scan as P
from ..operators import sessions as W
from ..rules import compile as R
from ..rules import packs
from ..rules.examples import examples
from ..sources import logs
from ..sources.views import CALLS_SQL, EVENTS_SQL, REPORT_SQL, layer_status, planted, planted_sql, report_events, security_events, table, tool_calls
from ..streaming import events as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("count_if(", "count(*) FILTER (WHERE ")
        return f

    return add


def se(sql: str) -> str:
    return f"WITH {EVENTS_SQL}\n{sql}"


def tc(sql: str) -> str:
    return f"WITH {CALLS_SQL}\n{sql}"


def rp(sql: str) -> str:
    return f"WITH {REPORT_SQL}\n{sql}"


FOUND_SQL = "(log IN ('linter', 'securityRadar') OR log = 'governor' AND policy_matched <> 'none' OR log IN ('injection', 'imageSafety') AND detected OR log = 'secureCode' AND classification = 'SECURITY_SENSITIVE' OR log = 'leash' AND decision = 'DENY' OR log = 'memory' AND n_findings > 0)"
DAILY_SQL = ", daily AS (SELECT * REPLACE (concat(session_id, '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS session_id) FROM re)"
SHOWN_SQL = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, log ORDER BY CASE WHEN log IN ('governor', 'injection', 'linter', 'leash') THEN -({RANK}) ELSE 0 END, ts, id) AS n FROM re WHERE {FOUND_SQL}) WHERE n <= CASE WHEN log IN ('governor', 'leash', 'memory', 'securityRadar') THEN 50 ELSE 30 END)"


def daily_sessions(rows: DataFrame) -> DataFrame:
    """Each day of a session as a session of its own: small ones, many of them without findings."""
    return rows.withColumn("session_id", F.concat_ws("-", "session_id", F.to_date("ts").cast("string")))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Two rules have look-ahead, which the other engine lacks; there the text after a group says the same.
WITHOUT_LOOKAHEAD = {r"[A-Za-z0-9/+=]{40}(?=.*aws)": r"([A-Za-z0-9/+=]{40}).*aws", r"\b[0-9a-zA-Z/+]{40}\b(?=.*aws)": r"\b([0-9a-zA-Z/+]{40})\b.*aws"}


def scan_sql(source: str, keys: str, text: str, rules: list[R.Rule], cut: int = 100, where: str = "true") -> str:
    """(keys, rule_id, severity, match) of every rule that matches."""
    parts = []
    for r in rules:
        plain = WITHOUT_LOOKAHEAD.get(r.pattern)
        regex = (f"(?{r.flags})" if r.flags else "") + (plain or r.pattern)
        parts.append(f"SELECT {keys}, {quoted(r.id)} AS rule_id, {quoted(r.severity)} AS severity, substr(regexp_extract({text}, {quoted(regex)}, {1 if plain else 0}), 1, {cut}) AS match FROM {source} WHERE {where} AND regexp_matches({text}, {quoted(regex)})")
    return "\nUNION ALL\n".join(parts)


def found(df: DataFrame, text: str, rules: list[R.Rule], keys: list[str], cut: int = 100) -> DataFrame:
    return P.exploded(P.scan(df, text, rules, cut), keys).select(*keys, "rule_id", "severity", "match")


# --- filters, sorts -----------------------------------------------------------------------------------------
EVENT = ["id", "ts", "session_id", "layer", "tool_name", "severity", "action", "pattern_id"]
COLS = ", ".join(EVENT)


@query("f2_events_by_session", se(f"SELECT {COLS} FROM se WHERE session_id = 's1'"))
def _(spark, d):
    return A.newest(security_events(spark, d).filter("session_id = 's1'")).select(*EVENT)


@query("f3_events_by_layer", se(f"SELECT {COLS} FROM se WHERE layer = 'L9' ORDER BY ts DESC, id DESC LIMIT 100"))
def _(spark, d):
    return A.newest(security_events(spark, d).filter("layer = 'L9'"), 100).select(*EVENT)


@query("f4_events_by_severity", se(f"SELECT {COLS} FROM se WHERE severity = 'CRITICAL' ORDER BY ts DESC, id DESC LIMIT 100"))
def _(spark, d):
    return A.newest(security_events(spark, d).filter("severity = 'CRITICAL'"), 100).select(*EVENT)


@query("f5_count_in_range", se("SELECT count(*) AS n FROM se WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' AND layer = 'L1'"))
def _(spark, d):
    return A.count_in_range(security_events(spark, d), F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-12 00:00:00").cast("timestamp"), "L1")


SUMMARY_SQL = "SELECT session_id, count(*) AS total_events, count_if(action = 'block') AS blocks, count_if(action IN ('warn','alert')) AS warnings, min(ts) AS started_at, max(ts) AS ended_at FROM se GROUP BY session_id"


@query("f6_session", se(f"SELECT * FROM ({SUMMARY_SQL}) WHERE session_id = 's3'"))
def _(spark, d):
    return A.session_summary(security_events(spark, d).filter("session_id = 's3'"))


@query("f7_severity_threshold", se(f"SELECT {COLS}, {RANK} AS severity_rank FROM se WHERE severity IN ('HIGH', 'CRITICAL')"))
def _(spark, d):
    return A.at_least(security_events(spark, d), "HIGH").select(*EVENT, S.severity_rank(F.col("severity")).alias("severity_rank"))


@query("f8_tool_gating", tc("SELECT id, tool_name, url FROM tc WHERE tool_name IN ('WebFetch', 'Bash') AND bytes >= 10"))
def _(spark, d):
    return tool_calls(spark, d).filter(F.col("tool_name").isin("WebFetch", "Bash") & (F.col("bytes") >= 10)).select("id", "tool_name", "url")


@query("f9_minimum_size", "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes FROM documents WHERE length(text) >= 50 AND strlen(text) >= 10")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter((F.length("text") >= 50) & (F.octet_length("text") >= 10)).select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


@query("f10_language", tc("SELECT CASE WHEN file_path LIKE '%.py' THEN 'python' ELSE 'unknown' END AS language, count(*) AS n FROM tc WHERE file_path IS NOT NULL GROUP BY 1"))
def _(spark, d):
    return tool_calls(spark, d).filter("file_path IS NOT NULL").groupBy(S.language(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


#: A letter of each class that hides text, and some that don't.
DISGUISED = [(f"a{c}b", False) for c in "\u0456\u03bf\uff41\u200b\u2028\u2060\ufeff\u00ad\u00e9\u4e2d"]


@query("f14_unicode_obfuscation", "SELECT doc_id, regexp_matches(text, '[\\x{0400}-\\x{04FF}\\x{0370}-\\x{03FF}\\x{FF00}-\\x{FFEF}\\x{200B}-\\x{200F}\\x{2028}-\\x{202F}\\x{2060}-\\x{206F}\\x{FEFF}\\x{00AD}]') AS obfuscated FROM " + planted_sql("documents", "doc_id", "text", DISGUISED))
def _(spark, d):
    return planted(table(spark, d, "documents"), "doc_id", "text", DISGUISED).select("doc_id", S.unicode_obfuscation(F.col("text")).alias("obfuscated"))


@query("f1_normalise_entries", se("""SELECT id, CASE WHEN k % 3 = 0 THEN severity ELSE 'LOW' END AS severity,
  CASE WHEN action = 'block' THEN 'block' WHEN k % 3 = 0 AND severity = 'CRITICAL' THEN 'alert' WHEN (k % 3 = 0 AND severity = 'HIGH') OR action = 'warn' THEN 'warn' ELSE 'log' END AS action,
  coalesce(pattern_id, 't1') AS pattern_id, tool_name FROM se"""))
def _(spark, d):
    e = security_events(spark, d)
    nul = F.lit(None).cast("string")
    entry = e.select(
        F.col("id").cast("string").alias("description"), F.col("ts").alias("timestamp"), "session_id", nul.alias("sessionId"), nul.alias("tool"), "tool_name", nul.alias("severity"), F.when(F.col("k") % 3 == 0, F.lower("severity")).alias("risk_level"),
        F.upper("action").alias("action"), F.lit(False).alias("blocked"), "pattern_id", F.array().cast("array<string>").alias("patterns_matched"), F.array(F.lit("t1")).alias("triggers"), nul.alias("block_reason"), nul.alias("file_path"), nul.alias("matched_text"), "layer", nul.alias("hook_type"),
    )
    return logs.normalise_entries(entry).select(F.col("description").cast("long").alias("id"), "severity", "action", "pattern_id", "tool_name")


@query("f15_session_window", se(f"""SELECT s.session_id, e.id, e.ts FROM se e JOIN ({SUMMARY_SQL}) s ON e.ts BETWEEN s.started_at AND s.ended_at + INTERVAL 60 SECOND WHERE e.severity = 'CRITICAL' AND e.layer = 'L0' AND s.session_id IN ('s1','s2','s3')"""))
def _(spark, d):
    e = security_events(spark, d)
    loose = e.filter("severity = 'CRITICAL' AND layer = 'L0'").drop("session_id")
    return A.in_session_window(loose, A.session_summary(e.filter("session_id IN ('s1','s2','s3')")))


PAIRS_SQL = f"SELECT s.session_id, e.id, e.ts FROM se e JOIN ({SUMMARY_SQL}) s ON e.ts BETWEEN s.started_at AND s.ended_at + INTERVAL 60 SECOND"


@query("f15_session_window_all", se(PAIRS_SQL))
def _(spark, d):
    """All events as loose ones against all sessions."""
    e = security_events(spark, d)
    return A.in_window_or_last(e.drop("session_id"), A.session_summary(e))


@query("f15_window_counts", se(f"SELECT session_id, count(*) AS n FROM ({PAIRS_SQL}) GROUP BY session_id"))
def _(spark, d):
    """How many of all events each session's span holds, without listing them."""
    e = security_events(spark, d)
    return A.window_counts(e.drop("session_id"), A.session_summary(e))


@query("f16_reportable", rp(f"{DAILY_SQL} SELECT {COLS} FROM daily WHERE session_id IN (SELECT session_id FROM daily WHERE log = 'error' OR log NOT IN ('imageSafety', 'securityRadar') AND {FOUND_SQL})"))
def _(spark, d):
    return A.reportable(daily_sessions(report_events(spark, d))).select(*EVENT)


@query("s4_session_log", se(f"SELECT {COLS} FROM se WHERE session_id = 's2' AND ts >= (SELECT max(ts) FROM se) - INTERVAL 96 HOUR"))
def _(spark, d):
    e = A.with_as_of(security_events(spark, d))
    return logs.session_log(e, "s2", F.col("as_of"), hours=96).select(*EVENT)


@query("s6_subagent_output", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS output FROM conversations GROUP BY conv_id HAVING length(string_agg(text, chr(10) ORDER BY turn, text)) >= 10")
def _(spark, d):
    return logs.subagent_text(table(spark, d, "conversations"), "conv_id", ["turn"])


@query("s5_transcript", """SELECT conv_id, CAST(no AS INTEGER) AS no, kind, text, tool FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
  CASE role WHEN 'user' THEN 'user' ELSE 'tool' END AS kind, CASE role WHEN 'user' THEN substr(trim(text), 1, 500) END AS text, CASE role WHEN 'assistant' THEN 'Reply' END AS tool
  FROM conversations WHERE role = 'assistant' OR (role = 'user' AND trim(text) <> '')) WHERE back <= 100""")
def _(spark, d):
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "text").otherwise("tool_use")
    block = F.struct(kind.alias("type"), "text", F.when(F.col("role") == "assistant", "Reply").alias("name"), F.lit(None).cast("string").alias("input"), F.lit(None).cast("string").alias("content"))
    lines = c.filter("role IN ('user', 'assistant')").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line"), F.col("role").alias("type"), F.struct("role", F.array(block).alias("content")).alias("message"))
    return logs.transcript_events(lines).withColumnRenamed("session_id", "conv_id")


@query("o1_recent_events", se(f"SELECT {COLS} FROM se ORDER BY ts DESC, id DESC LIMIT 100"))
def _(spark, d):
    return A.newest(security_events(spark, d), 100).select(*EVENT)


@query("o2_recent_sessions", se(f"SELECT * FROM ({SUMMARY_SQL}) ORDER BY started_at DESC, session_id LIMIT 20"))
def _(spark, d):
    return A.session_summary(security_events(spark, d)).orderBy(F.desc("started_at"), "session_id").limit(20)


@query("o4_severity_sort", se(f"SELECT {COLS} FROM se ORDER BY {RANK} DESC, ts, id LIMIT 500"))
def _(spark, d):
    return A.by_severity(security_events(spark, d)).limit(500).select(*EVENT)


# --- pattern scans ------------------------------------------------------------------------------------------
#: Texts that each rule of a pack finds, planted into every second row: each rule has hits, beside rows without any.
INJECTED, LIBRARY, SECRETS, UNSAFE = examples(R.INJECTION), examples(R.INJECTION_LIBRARY), examples(R.EGRESS_SECRET), examples(R.OUTPUT)
SKILLS, LINTED, REMEMBERED = examples(R.SKILL), examples(R.LINTER), examples(R.memory_rules())
MENTIONED = [("see @/home/u/" + t, False) for t, _ in examples(R.MENTION)]
#: One to five phrases of the heuristics at once, so that scores differ and both verdicts occur.
PHRASES = [(" ".join(p for _, p, _ in packs.HEURISTIC_PHRASES[k : k + 1 + k % 5]), False) for k in range(len(packs.HEURISTIC_PHRASES))]


@query("p1_injection_scan", scan_sql(planted_sql("documents", "doc_id", "text", INJECTED), "doc_id", "text", R.INJECTION))
def _(spark, d):
    return found(planted(table(spark, d, "documents"), "doc_id", "text", INJECTED), "text", R.INJECTION, ["doc_id"])


def _context_sql(source: str, rules: list[R.Rule], limit: int = 10) -> str:
    """The windows around the first match of each rule: the text before it is what a shortest prefix leaves."""
    parts = []
    for k, r in enumerate(rules):
        head = f"(?{r.flags})" if r.flags else ""
        pattern = re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", r.pattern)  # as the other engine writes code points
        whole, before = quoted(head + pattern), quoted(f"{head}\\A((?s:.)*?)(?:{pattern})")
        parts.append(f"SELECT doc_id, raw, {k} AS k, {quoted(r.id)} AS rule_id, {quoted(r.category)} AS category, {quoted(r.severity)} AS severity, regexp_extract(text, {whole}) AS match, length(regexp_extract(text, {before}, 1)) + 1 AS pos FROM p WHERE regexp_matches(text, {whole})")
    window = lambda back: f"substr(raw, greatest(pos - 1 - {back}, 0) + 1, pos - 1 + length(match) + 100 - greatest(pos - 1 - {back}, 0))"
    any_of = lambda back, markers: "(" + " OR ".join(f"regexp_matches({window(back)}, {quoted(m)})" for m in markers) + ")"
    union = " UNION ALL ".join(parts)
    hidden = re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", S.INVISIBLE.encode("ascii", "backslashreplace").decode())
    return f"""WITH p AS (SELECT doc_id, text AS raw, regexp_replace(text, {quoted(hidden.replace("\\xad", "\\x{00AD}"))}, '', 'g') AS text FROM {source}), m AS ({union}), o AS (SELECT *, {any_of(150, packs.DOCUMENTATION_MARKERS)} AS doc FROM m WHERE NOT {any_of(400, packs.CODE_MARKERS)}),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM o WHERE NOT doc OR severity IN ('CRITICAL', 'HIGH'))
SELECT doc_id, rule_id, category, CASE WHEN doc THEN 'LOW' ELSE severity END AS severity, substr(match, 1, 100) AS match, CAST(pos AS INTEGER) AS pos FROM l WHERE n <= {limit}"""


@query("p2_context_scan", _context_sql(planted_sql("documents", "doc_id", "text", LIBRARY), R.INJECTION_LIBRARY))
def _(spark, d):
    return P.exploded(P.context_scan(planted(table(spark, d, "documents"), "doc_id", "text", LIBRARY), "text", R.INJECTION_LIBRARY), ["doc_id"])


@query("p3_any_injection", "SELECT doc_id, (" + " OR ".join(f"regexp_matches(text, {quoted(r.regex)})" for r in R.INJECTION) + ") AS hit FROM " + planted_sql("documents", "doc_id", "text", INJECTED))
def _(spark, d):
    return P.quick_scan(planted(table(spark, d, "documents"), "doc_id", "text", INJECTED), "text", R.INJECTION).select("doc_id", "hit")


SCORE_SQL = " + ".join(f"CASE WHEN contains(lower(text), {quoted(p)}) THEN {w} ELSE 0 END" for _, p, w in packs.HEURISTIC_PHRASES)


@query("p4_heuristic_score", f"SELECT doc_id, {SCORE_SQL} AS score, ({SCORE_SQL}) >= 5 AS suspicious FROM {planted_sql('documents', 'doc_id', 'text', PHRASES)}")
def _(spark, d):
    return P.heuristic_score(planted(table(spark, d, "documents"), "doc_id", "text", PHRASES), "text", "h").select("doc_id", "h.score", "h.suspicious")


ALARMS = [*INJECTED, *PHRASES]


@query("p5_alert_action", f"WITH planted_docs AS (SELECT * FROM {planted_sql('documents', 'doc_id', 'text', ALARMS)}), f AS (SELECT doc_id, max({RANK}) AS r FROM ({scan_sql('planted_docs', 'doc_id', 'text', R.INJECTION)}) GROUP BY doc_id) SELECT d.doc_id, CASE WHEN r >= 3 THEN 'ALERT' WHEN r IS NOT NULL OR ({SCORE_SQL}) >= 5 THEN 'WARN' ELSE 'LOG' END AS verdict FROM planted_docs d LEFT JOIN f ON d.doc_id = f.doc_id")
def _(spark, d):
    rows = P.heuristic_score(P.scan(planted(table(spark, d, "documents"), "doc_id", "text", ALARMS), "text", R.INJECTION), "text", "h")
    return rows.select("doc_id", P.alert_action(F.coalesce("severity", F.lit("")), F.size("findings") > 0, F.col("h.suspicious")).alias("verdict"))


@query("p6_egress_secrets", scan_sql(planted_sql("documents", "doc_id", "text", SECRETS), "doc_id", "text", R.EGRESS_SECRET, 20))
def _(spark, d):
    return found(planted(table(spark, d, "documents"), "doc_id", "text", SECRETS), "text", R.EGRESS_SECRET, ["doc_id"], 20)


@query("p7_personal_data", "SELECT doc_id, rule_id, severity, '[REDACTED]' AS match FROM (" + scan_sql("documents", "doc_id", "text", R.EGRESS_PII) + ")")
def _(spark, d):
    return found(table(spark, d, "documents"), "text", R.EGRESS_PII, ["doc_id"]).withColumn("match", F.lit("[REDACTED]"))


@query("p8_blocked_destination", tc("SELECT id, CASE WHEN regexp_matches(url, '(?i)pastebin\\.com') THEN 'Pastebin' ELSE 'Raw IP' END AS name, CASE WHEN regexp_matches(url, '(?i)pastebin\\.com') THEN 'url' ELSE 'host' END AS found_by FROM tc WHERE regexp_matches(url, '(?i)pastebin\\.com') OR regexp_matches(url, '^[a-z]+://[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}(/|$)')"))
def _(spark, d):
    rows = tool_calls(spark, d).filter("url IS NOT NULL").withColumn("b", P.blocked_destination(F.col("url"), R.DESTINATIONS))
    return rows.filter("b IS NOT NULL").select("id", "b.name", F.col("b.by").alias("found_by"))


#: Runs of base64 characters: too short, at the limit, above it, and a short one before a long one.
BLOBS = [("A" * n + "=", False) for n in (99, 10239, 10240, 20000)] + [("B" * 100 + " " + "C" * 10300, False)]


@query("p9_base64_blob", "SELECT conv_id, turn, length(regexp_extract(text, '[A-Za-z0-9+/]{100,}={0,2}', 0)) > 10240 AS blob FROM " + planted_sql("conversations", "conv_id", "text", BLOBS))
def _(spark, d):
    return planted(table(spark, d, "conversations"), "conv_id", "text", BLOBS).select("conv_id", "turn", P.base64_blob(F.col("text")).alias("blob"))


@query("p10_bulk_transfer", tc("SELECT id, CASE WHEN bytes > 512000 OR total > 20971520 THEN 'CRITICAL' WHEN bytes > 51200 THEN 'MEDIUM' END AS bulk FROM (SELECT *, sum(bytes) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS total FROM tc)"))
def _(spark, d):
    return W.egress(tool_calls(spark, d)).select("id", P.bulk_transfer(F.col("bytes"), F.col("total_bytes")).alias("bulk"))


DLP_SQL = "\nUNION ALL\n".join(f"SELECT doc_id, {quoted(r.id)} AS category, {quoted(r.severity)} AS severity, CAST(len(regexp_extract_all(text, {quoted(r.regex)})) AS INTEGER) AS n FROM documents WHERE regexp_matches(text, {quoted(r.regex)})" for r in R.SUBAGENT_DLP)


@query("p11_dlp_counts", DLP_SQL)
def _(spark, d):
    return P.dlp_scan(table(spark, d, "documents"), "text", R.SUBAGENT_DLP).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.category", "f.severity", F.col("f.count").alias("n"))


@query("dlp_findings", f"SELECT d.source, f.category, count(*) AS documents, CAST(sum(f.n) AS BIGINT) AS matches, max({RANK.replace('severity', 'f.severity')}) AS top FROM ({DLP_SQL}) f JOIN documents d ON d.doc_id = f.doc_id GROUP BY 1, 2")
def dlp_findings(spark, d):
    docs = table(spark, d, "documents")
    rows = P.dlp_scan(docs, "text", R.SUBAGENT_DLP).select("source", F.explode("findings").alias("f"))
    return rows.groupBy("source", F.col("f.category").alias("category")).agg(F.count(F.lit(1)).alias("documents"), F.sum("f.count").cast("long").alias("matches"), F.max(S.severity_rank(F.col("f.severity"))).alias("top"))


@query("p12_high_entropy", "SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{32,}'), lambda t: NOT regexp_matches(t, '^[0-9a-fA-F]+$') AND NOT regexp_matches(t, '^[A-Za-z]+$') AND list_entropy(string_split(t, '')) > 4.5)[1:5]) AS token FROM " + planted_sql("documents", "doc_id", "text"))
def _(spark, d):
    return planted(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.explode(S.high_entropy_strings(F.col("text"))).alias("token"))


def _any(patterns: list[str], text: str) -> str:
    """The look-ahead of one pattern excludes nothing, so it is left out."""
    return "(" + " OR ".join(f"regexp_matches({text}, {quoted(p.replace('(?!Loader)', ''))})" for p in patterns) + ")"


def _classes_sql(source: str, key: str, text: str) -> str:
    hit = {name: _any(packs.CODE_FAMILIES[name], text) for name, *_ in P.FAMILIES if name != "ci_injection"}
    tests = [("sql_injection", 4, hit["sql"]), ("sql_keywords", 2, f"(NOT {hit['sql']} AND {_any([packs.CODE_KEYWORDS['sql']], text)})"), ("command_injection", 4, hit["command"]), ("shell_keywords", 3, f"(NOT {hit['command']} AND {_any([packs.CODE_KEYWORDS['command']], text)})")]
    tests += [(label, rank, hit[name]) for name, label, rank in P.FAMILIES[2:] if name != "ci_injection"]
    found_ = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{label}' END" for label, _, t in tests) + "], lambda x: x IS NOT NULL)"
    rank = "greatest(1, " + ", ".join(f"CASE WHEN {t} THEN {r} ELSE 1 END" for _, r, t in tests) + ")"
    return f"SELECT {key}, array_to_string(t, ',') AS triggers, CASE r WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN r = 4 OR len(t) >= 3 THEN 'HIGH' WHEN len(t) <> 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, r = 4 AND len(t) > 0 AS blocked FROM (SELECT {key}, {found_} AS t, {rank} AS r FROM {source})"


CODED = examples(R.Rule(name, "", "", "", pattern) for name, patterns in packs.CODE_FAMILIES.items() if name != "ci_injection" for pattern in patterns) + [("SELECT exec prompt", False)]


@query("p14_code_classes", _classes_sql(planted_sql("pages", "page_id", "html", CODED), "page_id", "html"))
def _(spark, d):
    pages = planted(table(spark, d, "pages"), "page_id", "html", CODED)
    return pages.select("page_id", P.classify_code(F.col("html"), F.lit("javascript")).alias("c")).select("page_id", F.array_join("c.triggers", ",").alias("triggers"), "c.risk", "c.confidence", "c.blocked")


#: In SQL, without look-ahead and back-reference: (must match, must not match) for a line; the plain pattern where there is none.
_QUOTED_KEY = R.LINTER[0].pattern
LINT_SQL = {
    "hardcoded-api-key": ["|".join(_QUOTED_KEY.replace("(['\"`])", q).replace("\\1", q) for q in ("'", '"', "`")), None],
    "xss-innerhtml": [r"\.innerHTML\s*=", r"\.innerHTML\s*=\s*['\"`]\s*['\"`]"],
    "no-input-validation": [r"(?:req\.body|req\.query|req\.params)\.[a-zA-Z]+", r"(?:req\.body|req\.query|req\.params)\.[a-zA-Z](?:\s*\?\?|\s*\|\||\.trim\(\)|\.validate)"],
}


def _lint_sql(source: str, key: str, text: str) -> str:
    parts = []
    for r in R.LINTER:
        if "*" in r.languages or "js" in r.languages:
            must, bar = LINT_SQL.get(r.id, [r.pattern, None])
            head = f"(?{r.flags})" if r.flags else ""
            test = f"regexp_matches(line, {quoted(head + must)})" + (f" AND NOT regexp_matches(line, {quoted(head + bar)})" if bar else "")
            parts.append(f"SELECT {key}, {quoted(r.id)} AS rule_id, {quoted(r.severity)} AS severity, CAST(min(n) AS INTEGER) AS line FROM l WHERE {test} GROUP BY {key}")
    return f"WITH l AS (SELECT {key}, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS n FROM {source}), c AS (SELECT * FROM l WHERE NOT regexp_matches(line, '^[\\s\\p{{Z}}\\x{{FEFF}}]*(?://|#|\\*)')) " + " UNION ALL ".join(parts).replace(" FROM l ", " FROM c ")


@query("p16_lint", _lint_sql(planted_sql("pages", "page_id", "html", LINTED), "page_id", "html"))
def _(spark, d):
    return P.lint_lines(planted(table(spark, d, "pages"), "page_id", "html", LINTED), "html", F.lit("javascript"), ["page_id"])


@query("p17_unsafe_output", scan_sql(planted_sql("pages", "page_id", "html", UNSAFE), "page_id", "html", R.OUTPUT, 30))
def _(spark, d):
    return found(planted(table(spark, d, "pages"), "page_id", "html", UNSAFE), "html", R.OUTPUT, ["page_id"], 30)


@query("p19_skill_verdict", f"WITH planted_docs AS (SELECT * FROM {planted_sql('documents', 'doc_id', 'text', SKILLS)}), f AS (SELECT doc_id, max({RANK}) AS r FROM ({scan_sql('planted_docs', 'doc_id', 'text', R.SKILL)}) GROUP BY doc_id) SELECT d.doc_id, CASE WHEN r = 4 THEN 'BLOCK' WHEN r IS NOT NULL THEN 'WARN' ELSE 'PASS' END AS verdict FROM planted_docs d LEFT JOIN f ON d.doc_id = f.doc_id")
def _(spark, d):
    return P.skill_verdict(planted(table(spark, d, "documents"), "doc_id", "text", SKILLS), "text").select("doc_id", "verdict")


#: Words, false facts, encodings and sensitive data of memory writes, one or two kinds in a text.
WRITTEN = [(w.upper(), False) for w in packs.MEMORY_INJECTION_WORDS] + [(f"and {w} {s_}", False) for w, s_ in zip(packs.MEMORY_FAKE_FACTS, ["me@x.org", "555-123-4567", "sk-" + "a" * 20, "\\u0041", "ghp_" + "b" * 36, "xoxb-1", "forget all"])]
_FIRST_OF = lambda words: "CASE " + " ".join(f"WHEN contains(lower(text), {quoted(w)}) THEN {quoted(w)}" for w in words) + " END"
_ANY_OF = lambda patterns: "(" + " OR ".join(f"regexp_matches(text, {quoted(p)})" for p in patterns) + ")"


@query("p22_memory_issues", f"""WITH p AS (SELECT conv_id, turn, text, {_FIRST_OF(packs.MEMORY_INJECTION_WORDS)} AS word, {_FIRST_OF(packs.MEMORY_FAKE_FACTS)} AS fact FROM {planted_sql('conversations', 'conv_id', 'text', WRITTEN)})
SELECT conv_id, turn, 'injection' AS kind, word AS detail FROM p WHERE word IS NOT NULL UNION ALL SELECT conv_id, turn, 'fake_fact', fact FROM p WHERE fact IS NOT NULL
UNION ALL SELECT conv_id, turn, 'encoding', NULL FROM p WHERE {_ANY_OF(packs.MEMORY_ENCODINGS)} UNION ALL SELECT conv_id, turn, 'sensitive', NULL FROM p WHERE {_ANY_OF(packs.MEMORY_SENSITIVE)}""")
def _(spark, d):
    return planted(table(spark, d, "conversations"), "conv_id", "text", WRITTEN).select("conv_id", "turn", F.explode(P.memory_issues(F.col("text"))).alias("i")).select("conv_id", "turn", "i.*")


def _memory_sql(source: str) -> str:
    test = lambda r: f"regexp_matches(line, {quoted((f'(?{r.flags})' if r.flags else '') + r.pattern)})"
    parts = [f"SELECT doc_id, {quoted(r.id)} AS rule_id, {quoted(r.severity)} AS severity, {quoted(P.memory_kind(r.id))} AS kind, CAST(min(n) AS INTEGER) AS line FROM l WHERE {test(r)} GROUP BY doc_id" for r in R.memory_rules() if r.severity != "LOW"]
    return f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {source}) " + " UNION ALL ".join(parts)


@query("p24_memory_documents", _memory_sql(planted_sql("documents", "doc_id", "text", REMEMBERED)))
def _(spark, d):
    return P.memory_document_scan(planted(table(spark, d, "documents"), "doc_id", "text", REMEMBERED), R.memory_rules(), ["doc_id"])


#: Sections, one of them with what a memory rule finds; deeper headings and marks inside a line cut nothing.
SECTIONED = [(f"## Notes {k}\nfine ## no cut\n### deeper\n##  Plan \n{t}\n## Tail", False) for k, (t, _) in enumerate(REMEMBERED)] + [("## First", True)]
SECTIONS_SQL = f"""s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(?m)^## ', chr(1) || '## ', 'g'), chr(1)), lambda p: p <> '') AS parts FROM {planted_sql('documents', 'doc_id', 'text', SECTIONED)}),
e AS (SELECT doc_id, parts, unnest(parts) AS body, CAST(generate_subscripts(parts, 1) AS INTEGER) - 1 AS no FROM s),
sections AS (SELECT doc_id, no, CASE WHEN starts_with(body, '## ') THEN trim(regexp_extract(body, '\\A## ([^\\n]*)', 1)) END AS title, body, CAST(1 + length(regexp_replace(array_to_string(parts[1:no], ''), '[^\\n]', '', 'g')) AS INTEGER) AS start_line FROM e)"""


@query("p26_mentions", "SELECT conv_id, turn, m AS mention FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '@([^\\s,;]+)', 1)) AS m FROM " + planted_sql("conversations", "conv_id", "text", MENTIONED) + ") WHERE regexp_matches(m, '\\.netrc|\\.npmrc|\\.kube/config|\\.cargo/credentials|\\.docker/config\\.json|\\.aws/credentials|\\.pgpass|\\.ssh/(?:id_|authorized_keys)|\\.pem$|\\.key$')")
def _(spark, d):
    return P.mentions(planted(table(spark, d, "conversations"), "conv_id", "text", MENTIONED), "text", ["conv_id", "turn"]).select("conv_id", "turn", "mention")


@query("p30_max_severity", f"SELECT doc_id, max({RANK}) AS top FROM ({scan_sql('documents', 'doc_id', 'text', R.EGRESS_PII + R.EGRESS_SECRET)}) GROUP BY doc_id")
def _(spark, d):
    rows = P.scan(table(spark, d, "documents"), "text", R.EGRESS_PII + R.EGRESS_SECRET).filter("severity IS NOT NULL")
    return rows.select("doc_id", S.severity_rank(F.col("severity")).alias("top"))


def _active(external: list[R.Rule]) -> list[R.Rule]:
    """The merge of rule packs, one rule after the other."""
    kept: list[R.Rule] = []
    for r in external:
        if all(r.id != k.id and r.pattern != k.pattern for k in kept):
            kept.append(r)
    return kept + [r for r in R.INJECTION if r.id not in {k.id for k in kept}]


ACTIVE = _active(R.pack([*packs.INJECTION_DEFAULT, *packs.INJECTION_TRANSLATED]))
ACTIVE_TEXTS = examples(ACTIVE)


@query("r4_active_rules", f"WITH p AS (SELECT * FROM {planted_sql('documents', 'doc_id', 'text', ACTIVE_TEXTS)}) SELECT doc_id, rule_id, severity, match FROM (" + scan_sql("p", "doc_id", "text", ACTIVE) + ")")
def _(spark, d):
    """Texts against the rules that a full tier has in use: packs merged as tables, then joined with the texts."""
    docs = planted(table(spark, d, "documents"), "doc_id", "text", ACTIVE_TEXTS)
    return R.scan_table(docs, "text", R.active_injections(spark, active="full"), ["doc_id"]).select("doc_id", "rule_id", "severity", "match")


@query("r8_back_test", f"WITH f AS ({scan_sql('documents', 'doc_id', 'text', R.EGRESS_PII + R.EGRESS_SECRET)}) SELECT rule_id, count(*) AS hits, count(l.toxic) AS labelled, avg(l.toxic) AS precision FROM f LEFT JOIN labels l ON l.doc_id = f.doc_id GROUP BY rule_id")
def _(spark, d):
    return R.back_test(table(spark, d, "documents"), table(spark, d, "labels"), R.EGRESS_PII + R.EGRESS_SECRET, F.col("toxic") == 1)


CRITICAL_SQL = " OR ".join("regexp_matches(body, {})".format(quoted((f"(?{r.flags})" if r.flags else "") + r.pattern)) for r in R.memory_rules() if r.severity == "CRITICAL")


@query("u6_quarantined_sections", f"WITH {SECTIONS_SQL} SELECT doc_id, no, title, start_line, CAST(length(body) AS INTEGER) AS chars FROM sections WHERE {CRITICAL_SQL}")
def _(spark, d):
    docs = planted(table(spark, d, "documents"), "doc_id", "text", SECTIONED)
    return P.split_quarantine(docs, R.memory_rules())[1].select("doc_id", "no", "title", "start_line", F.length("body").alias("chars"))


# --- policy -------------------------------------------------------------------------------------------------
@query("g1_policies", tc("""SELECT id, CASE WHEN file_path = '/app/.env' THEN 'block-env-reads' WHEN command LIKE 'curl%' THEN 'block-curl-pipe-sh' WHEN command LIKE 'git push --force%' THEN 'block-force-push-main' WHEN file_path LIKE '%.ssh/%' THEN 'warn-ssh-key-reads' END AS policy,
  CASE WHEN file_path = '/app/.env' OR command LIKE 'curl%' OR command LIKE 'git push --force%' THEN 'BLOCK' WHEN file_path LIKE '%.ssh/%' THEN 'WARN' ELSE 'ALLOW' END AS action FROM tc"""))
def _(spark, d):
    return G.evaluate_policies(tool_calls(spark, d).withColumn("params_text", F.to_json(F.struct("file_path", "command", "url")))).select("id", "policy", "action")


@query("g8_profiles", tc("""SELECT id, profile, CASE WHEN profile = 'audit' AND (tool_name = 'Write' OR tool_name LIKE 'mcp%') OR profile = 'client-work' AND tool_name = 'WebFetch' OR profile = 'research' AND tool_name NOT IN ('Read', 'WebFetch') THEN 'tool'
  WHEN profile = 'client-work' AND tool_name = 'Read' AND contains(file_path, '/home/user/.ssh') THEN 'path'
  WHEN tool_name = 'Bash' AND (profile = 'audit' AND (command LIKE 'git push%' OR command LIKE 'curl%' OR command LIKE 'op %') OR profile = 'client-work' AND (command LIKE 'git push%' OR command LIKE 'curl%')) THEN 'command' END AS violation
FROM tc, (VALUES ('dev'), ('audit'), ('client-work'), ('research')) AS p(profile)"""))
def _(spark, d):
    """Every call under each of the four profiles."""
    calls = tool_calls(spark, d).withColumn("profile", F.explode(F.array(*map(F.lit, G.PROFILES))))
    return G.enforce_profile(calls).select("id", "profile", "violation")


@query("g9_file_sensitivity", tc("SELECT id, CASE WHEN contains(file_path, '.env') OR contains(file_path, '.ssh') OR contains(file_path, 'credentials') THEN 3 ELSE 0 END AS level FROM tc WHERE file_path IS NOT NULL"))
def _(spark, d):
    return tool_calls(spark, d).filter("file_path IS NOT NULL").select("id", S.file_sensitivity(F.col("file_path")).alias("level"))


PATH_SQL = "CASE WHEN contains(file_path, '.env') OR contains(file_path, 'credentials') OR contains(file_path, '.ssh/') OR contains(file_path, 'private_key') THEN 3 WHEN contains(file_path, 'security/') THEN 1 ELSE 0 END"


@query("g10_path_sensitivity", tc(f"SELECT id, {PATH_SQL} AS level FROM tc WHERE file_path IS NOT NULL"))
def _(spark, d):
    return tool_calls(spark, d).filter("file_path IS NOT NULL").select("id", S.path_sensitivity(F.col("file_path")).alias("level"))


@query("g11_mcp_tools", tc("SELECT id, 'memory' AS server, 'add_observations' AS method, 'local' AS service_type, true AS is_write FROM tc WHERE tool_name LIKE 'mcp%'"))
def _(spark, d):
    return tool_calls(spark, d).withColumn("m", S.mcp_tool(F.col("tool_name"))).filter("m IS NOT NULL").select("id", "m.*")


@query("c5_packages", tc("SELECT id, 'npm' AS pm, 'colors' AS package FROM tc WHERE command IS NOT NULL AND k < 50"))
def _(spark, d):
    calls = tool_calls(spark, d).filter("command IS NOT NULL").withColumn("command", F.when(F.col("k") < 50, F.concat(F.lit("npm install --save colors@1."), F.col("k").cast("string"), F.lit(" left-pad; ls"))).otherwise(F.col("command")))
    rows = calls.select("id", S.package_manager(F.col("command")).alias("pm"), F.explode(S.install_packages(F.col("command"))).alias("package"))
    return rows.join(F.broadcast(R.package_blocklist(spark)), "package", "left_semi").select("id", "pm", "package")


# --- joins --------------------------------------------------------------------------------------------------
LAYERS_SQL = "(VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b, *_ in packs.LAYERS) + ") AS l(layer, name)"


#: A rule table of several packs at once; a rule's id is its pack and its name.
TABLED = [r._replace(id=f"{name}:{r.id}") for name, rules in (("egress", R.EGRESS_SECRET), ("personal", R.EGRESS_PII), ("output", R.OUTPUT), ("skill", R.SKILL), ("library", R.INJECTION_LIBRARY), ("injection", R.INJECTION)) for r in rules]
TABLED_TEXTS = [*SECRETS, *UNSAFE, *SKILLS, *INJECTED]
_PLAIN_UNICODE = [r._replace(pattern=re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", r.pattern)) for r in TABLED]


@query("j1_rule_join", f"WITH p AS (SELECT * FROM {planted_sql('documents', 'doc_id', 'text', TABLED_TEXTS)}) SELECT doc_id, rule_id, severity, match FROM (" + scan_sql("p", "doc_id", "text", _PLAIN_UNICODE) + ")")
def _(spark, d):
    docs = planted(table(spark, d, "documents"), "doc_id", "text", TABLED_TEXTS)
    return R.scan_table(docs, "text", R.rule_table(spark, TABLED), ["doc_id"]).select("doc_id", "rule_id", "severity", "match")


@query("j2_layer_names", se(f"SELECT id, coalesce(l.name, 'Unknown') AS name FROM se LEFT JOIN {LAYERS_SQL} ON se.layer = l.layer"))
def _(spark, d):
    return security_events(spark, d).join(F.broadcast(logs.layers(spark).select("layer", "name")), "layer", "left").select("id", F.coalesce("name", F.lit("Unknown")).alias("name"))


@query("j3_blocklist_reasons", tc("SELECT id, CASE k % 3 WHEN 0 THEN 'colors' ELSE 'rc' END AS package, CASE k % 3 WHEN 0 THEN 'Protestware - infinite loop' ELSE 'Credential stealer' END AS reason FROM tc WHERE command IS NOT NULL AND k % 3 < 2"))
def _(spark, d):
    name = F.element_at(F.array(F.lit("Colors"), F.lit("rc"), F.lit("left-pad")), F.col("k") % 3 + 1)
    calls = tool_calls(spark, d).filter("command IS NOT NULL").withColumn("command", F.concat(F.lit("npm install "), name))
    rows = calls.select("id", S.package_manager(F.col("command")).alias("ecosystem"), F.explode(S.install_packages(F.col("command"))).alias("package"))
    return R.malicious(rows, spark).select("id", "package", "reason")


@query("j4_path_labels", tc(f"SELECT id, {PATH_SQL} AS level FROM tc WHERE file_path IS NOT NULL"))
def _(spark, d):
    labels = spark.createDataFrame(S.PATH_LABELS, "pattern string, level int")
    return A.path_labels(tool_calls(spark, d).filter("file_path IS NOT NULL"), labels)


@query("j5_untrusted_sources", "SELECT doc_id FROM documents WHERE source NOT IN ('src0', 'src1')")
def _(spark, d):
    trusted = spark.createDataFrame([("src0",), ("src1",)], "source string")
    return A.untrusted(table(spark, d, "documents"), trusted)[0].select("doc_id")


@query("j7_verdict_cache", "SELECT d.doc_id, count(c.h) > 0 AS hit FROM documents d LEFT JOIN (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0) c ON sha256(d.text) = c.h GROUP BY d.doc_id")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("hash"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    age = F.when(F.col("doc_id") % 2 == 0, now - F.expr("INTERVAL 1 HOUR")).otherwise(now - F.expr("INTERVAL 2 DAYS"))
    cache = docs.filter("doc_id % 3 = 0").select("hash", F.lit("DESCRIPTION").alias("verdict"), age.alias("checked_at")).groupBy("hash").agg(F.max("verdict").alias("verdict"), F.max("checked_at").alias("checked_at"))
    hits, misses = A.cached_verdicts(docs, cache, now)
    return hits.select("doc_id", F.lit(True).alias("hit")).union(misses.select("doc_id", F.lit(False)))


@query("j9_integrity", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'NEW' WHEN doc_id % 11 = 0 THEN 'MISSING' WHEN doc_id % 5 = 0 THEN 'TAMPERED' ELSE 'UNCHANGED' END AS state FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("sha256"))
    old = docs.filter("doc_id % 7 <> 0")
    now = docs.filter("doc_id % 7 = 0 OR doc_id % 11 <> 0").withColumn("sha256", F.when((F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 7 != 0), F.lit("x")).otherwise(F.col("sha256")))
    return A.integrity(old, now, "doc_id")


TECH_SQL = "(VALUES " + ", ".join(f"({quoted(a)}, {quoted(t)})" for a, ts, _, _ in packs.REPORT_MAP for t in ts) + ") AS t(layer, technique)"


@query("j10_techniques", se(f"SELECT technique, count(*) AS n FROM se JOIN {TECH_SQL} ON se.layer = t.layer GROUP BY technique"))
def _(spark, d):
    return security_events(spark, d).join(F.broadcast(A.framework_map(logs.report_map(spark))), "layer").groupBy("technique").agg(F.count(F.lit(1)).alias("n"))


# --- aggregates ---------------------------------------------------------------------------------------------
ASOF = "(SELECT max(ts) FROM se)"


@query("a1_dashboard", se(f"SELECT count(*) AS total_events, count_if(action = 'block') AS blocks, count_if(action IN ('warn','alert')) AS warnings, count(DISTINCT layer) AS active_layers, count_if(severity = 'CRITICAL' AND ts >= {ASOF} - INTERVAL 24 HOUR) AS critical_24h FROM se"))
def _(spark, d):
    return A.dashboard(A.with_as_of(security_events(spark, d)), F.col("as_of"))


@query("a2_top_patterns", se("SELECT pattern_id, count(*) AS n FROM se WHERE pattern_id IS NOT NULL GROUP BY pattern_id ORDER BY n DESC, pattern_id LIMIT 10"))
def _(spark, d):
    return A.top_patterns(security_events(spark, d))


@query("a3_events_per_hour", se("SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM se GROUP BY 1"))
def _(spark, d):
    return A.events_per_hour(security_events(spark, d))


@query("a4_block_rate", se("SELECT layer, count(*) AS total, count_if(action = 'block') AS blocks, round(100.0 * count_if(action = 'block') / count(*), 2) AS block_rate FROM se GROUP BY layer"))
def _(spark, d):
    return A.block_rate(security_events(spark, d)).withColumn("block_rate", F.col("block_rate").cast("double"))


@query("a5_metrics", se("""SELECT bucket, layer, metric, value FROM (SELECT date_trunc('day', ts) AS bucket, layer, CAST(count(*) AS DOUBLE) AS events, CAST(count_if(action = 'block') AS DOUBLE) AS blocks, CAST(count_if(action IN ('warn','alert')) AS DOUBLE) AS warnings
  FROM se GROUP BY GROUPING SETS ((date_trunc('day', ts), layer), (date_trunc('day', ts)))) UNPIVOT (value FOR metric IN (events, blocks, warnings))"""))
def _(spark, d):
    return A.metrics(security_events(spark, d))


@query("a6_pattern_statistics", se("SELECT pattern_id, count(*) AS matches, max(ts) AS last_matched, arg_max(severity, (ts, id)) AS severity, arg_max(layer, (ts, id)) AS layer FROM se WHERE pattern_id IS NOT NULL GROUP BY pattern_id"))
def _(spark, d):
    return A.pattern_statistics(security_events(spark, d))


@query("a7_session_summary", se(SUMMARY_SQL))
def _(spark, d):
    return A.session_summary(security_events(spark, d))


@query("a8_layer_statistics", se(f"SELECT l.layer, l.name, count(se.id) AS invocations, coalesce(count_if(action = 'block'), 0) AS blocks, coalesce(count_if(action IN ('warn','alert')), 0) AS warnings, max(ts) AS last_invoked FROM {LAYERS_SQL} LEFT JOIN se ON se.layer = l.layer GROUP BY 1, 2"))
def _(spark, d):
    return A.layer_statistics(logs.layers(spark), security_events(spark, d))


@query("a9_report_summary", rp("""SELECT session_id, count_if(log = 'governor' AND policy_matched <> 'none' AND severity <> 'LOW') AS policy_violations, count_if(log = 'injection' AND detected) AS injection_detections, count_if(log = 'imageSafety' AND detected) AS image_detections,
  count_if(log = 'secureCode' AND classification = 'SECURITY_SENSITIVE') AS sensitive_writes, count_if(log = 'linter' AND reverted) AS code_reverts, count_if(log = 'leash' AND decision = 'DENY') AS leash_blocks, count_if(log = 'memory' AND n_findings > 0) AS memory_attempts, count_if(log = 'securityRadar') AS radar_findings,
  count_if(log = 'error') AS errors, count_if(log = 'tool') AS tool_calls, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS duration_ms, CAST(sum(CAST(ceil(input_chars / 4) AS BIGINT)) AS BIGINT) AS tokens FROM re GROUP BY session_id"""))
def _(spark, d):
    return A.report_summary(report_events(spark, d))


def _matrix_sql(source: str) -> str:
    names = ("governor", "imageSafety", "injection", "leash", "linter", "memory", "secureCode", "securityRadar")
    return "SELECT severity, " + ", ".join(f"count_if(log = '{c}') AS \"{c}\"" for c in names) + f", count(*) AS total FROM {source} GROUP BY severity"


@query("a10_severity_matrix", rp(_matrix_sql(f"(SELECT * FROM re WHERE {FOUND_SQL})")))
def _(spark, d):
    return A.severity_matrix(report_events(spark, d))


@query("a10_display_matrix", rp(_matrix_sql(SHOWN_SQL.replace("FROM re", "FROM (SELECT * REPLACE (concat('s', k % 7) AS session_id) FROM re)"))))
def _(spark, d):
    """Over seven large sessions, so that the caps bind."""
    return A.severity_matrix(report_events(spark, d).withColumn("session_id", F.concat(F.lit("s"), (F.col("k") % 7).cast("string"))), display=True)


@query("a11_overall_status", rp(f"""{DAILY_SQL} SELECT s.session_id, CASE WHEN coalesce(critical, 0) > 0 OR bad > 0 THEN 'DETECTED' WHEN coalesce(high, 0) > 0 OR violations > 2 THEN 'WARNINGS' ELSE 'CLEAN' END AS status
  FROM (SELECT session_id, count_if(log = 'linter' AND reverted OR log IN ('leash', 'injection', 'imageSafety', 'memory', 'securityRadar') AND {FOUND_SQL}) AS bad, count_if(log = 'governor' AND policy_matched <> 'none' AND severity <> 'LOW') AS violations FROM daily GROUP BY session_id) s
  LEFT JOIN (SELECT session_id, count_if(severity = 'CRITICAL') AS critical, count_if(severity = 'HIGH') AS high FROM {SHOWN_SQL.replace('FROM re', 'FROM daily')} GROUP BY session_id) f ON s.session_id = f.session_id"""))
def _(spark, d):
    return A.overall_status(daily_sessions(report_events(spark, d)))


STATUS_SQL = EVENTS_SQL + ", st AS (SELECT session_id AS project, concat('L', CAST(k % 20 AS VARCHAR)) AS layer, CASE WHEN count(*) >= 3 THEN 'active' ELSE 'not_installed' END AS status FROM se GROUP BY 1, 2)"
COVERS_SQL = "(VALUES " + ", ".join(f"('{a}', '{r}')" for a, _, _, risks in packs.REPORT_MAP for r in risks) + ") AS c(layer, risk)"
RISKS_SQL = "(VALUES " + ", ".join(f"('{r}')" for r in A.ASI) + ") AS r(risk)"


@query("a12_agentic_coverage", f"WITH {STATUS_SQL} SELECT p.project, r.risk, count(DISTINCT x.layer) AS layers, CASE WHEN count(DISTINCT x.layer) >= 2 AND NOT (r.risk = 'ASI06' AND p.project IN (SELECT project FROM st WHERE layer = 'L3' AND status = 'active')) THEN 'covered' WHEN count(DISTINCT x.layer) >= 1 THEN 'partial' ELSE 'gap' END AS coverage FROM (SELECT DISTINCT project FROM st) p CROSS JOIN {RISKS_SQL} LEFT JOIN (SELECT project, st.layer, risk FROM st JOIN {COVERS_SQL} ON st.layer = c.layer WHERE status = 'active') x ON x.project = p.project AND x.risk = r.risk GROUP BY 1, 2")
def _(spark, d):
    return A.agentic_coverage(layer_status(spark, d), logs.report_map(spark))


IDS_SQL = "(VALUES " + ", ".join(f"('{a}', '{k}', {quoted(i)})" for a, t, o, _ in packs.REPORT_MAP for k, ids in (("o", o), ("a", t)) for i in ids) + ") AS i(layer, k, id)"


@query("a13_framework_totals", f"WITH {STATUS_SQL} SELECT project, count(DISTINCT st.layer) AS active_layers, count(DISTINCT CASE WHEN k = 'a' THEN id END) AS atlas, CAST(round(100.0 * count(DISTINCT CASE WHEN k = 'a' THEN id END) / 16) AS BIGINT) AS atlas_percent, count(DISTINCT CASE WHEN k = 'o' THEN id END) AS owasp, CAST(round(100.0 * count(DISTINCT CASE WHEN k = 'o' THEN id END) / 9) AS BIGINT) AS owasp_percent FROM st LEFT JOIN {IDS_SQL} ON st.layer = i.layer WHERE status = 'active' GROUP BY project")
def _(spark, d):
    return A.framework_totals(layer_status(spark, d), logs.report_map(spark))


@query("a14_layer_inventory", f"WITH {STATUS_SQL} SELECT project, status, count(*) AS n FROM st GROUP BY GROUPING SETS ((project, status), (project))")
def _(spark, d):
    return A.layer_inventory(layer_status(spark, d))


@query("a15_egress_totals", tc("SELECT session_id, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS requests, string_agg(DISTINCT url, ' ' ORDER BY url) AS destinations FROM tc WHERE url IS NOT NULL GROUP BY session_id"))
def _(spark, d):
    return A.egress_totals(tool_calls(spark, d))


@query("a16_scan_summary", se("SELECT layer, count_if(severity='CRITICAL') AS critical, count_if(severity='HIGH') AS high, count_if(severity='MEDIUM') AS medium, count_if(severity='LOW') AS low, CASE WHEN count_if(severity='CRITICAL') > 0 THEN 2 WHEN count_if(severity='HIGH') > 0 THEN 1 ELSE 0 END AS exit_code FROM se GROUP BY layer"))
def _(spark, d):
    return A.scan_summary(security_events(spark, d))


@query("a17_evaluator_summary", se("SELECT action AS status, count(*) AS commits, CAST(sum(k) AS BIGINT) AS issues FROM se WHERE tool_name = 'Write' GROUP BY action"))
def _(spark, d):
    return A.evaluator_summary(security_events(spark, d).filter("tool_name = 'Write'").select(F.col("action").alias("status"), F.col("k").alias("issues")))


@query("a18_trend", se(f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM se WHERE ts >= {ASOF} - INTERVAL 7 DAY GROUP BY 1"))
def _(spark, d):
    return A.trend(security_events(spark, d))


def _share_sql(by: str) -> str:
    return f"SELECT {by}, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM re WHERE ts >= (SELECT max(ts) FROM re) - INTERVAL 7 DAY AND {by} IS NOT NULL GROUP BY 1"


@query("a18_trend_patterns", rp(f"SELECT * FROM ({_share_sql('pattern_id')}) ORDER BY n DESC, pattern_id LIMIT 10"))
def _(spark, d):
    return A.trend_share(report_events(spark, d), "pattern_id").orderBy(F.desc("n"), "pattern_id").limit(10)


@query("a18_trend_categories", rp(_share_sql("log")))
def _(spark, d):
    return A.trend_share(report_events(spark, d), "log")


@query("a19_status_activity", se(f"SELECT layer, count(*) AS events, count_if(severity = 'CRITICAL' AND ts >= {ASOF} - INTERVAL 24 HOUR) AS critical_24h, count_if(severity = 'HIGH' AND ts >= {ASOF} - INTERVAL 24 HOUR) AS high_24h FROM se GROUP BY layer"))
def _(spark, d):
    return A.status_activity(security_events(spark, d))


@query("a21_findings_by_document", f"SELECT doc_id, count(*) AS findings, count(DISTINCT rule_id) AS rules, CASE max({RANK}) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS top FROM ({scan_sql('documents', 'doc_id', 'text', R.EGRESS_PII + R.EGRESS_SECRET)}) GROUP BY doc_id")
def _(spark, d):
    return A.findings_by_document(found(table(spark, d, "documents"), "text", R.EGRESS_PII + R.EGRESS_SECRET, ["doc_id"]))


@query("a22_posture", se(f"SELECT session_id, CASE max({RANK}) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'AT_RISK' ELSE 'SECURE' END AS posture FROM se GROUP BY session_id"))
def _(spark, d):
    return A.posture(security_events(spark, d))


# --- sessions -----------------------------------------------------------------------------------------------
OVER = "OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)"
LEVEL_SQL = f"CASE WHEN tool_name = 'Read' THEN {PATH_SQL} WHEN command = 'op read x' THEN 3 ELSE 0 END"


@query("w1_taint", tc(f"SELECT id, max({LEVEL_SQL}) {OVER} AS taint_level FROM tc"))
def _(spark, d):
    return W.taint(tool_calls(spark, d)).select("id", "taint_level")


@query("w2_taint_source", tc(f"""SELECT id, last_value(src IGNORE NULLS) {OVER} AS taint_source, last_value(seen IGNORE NULLS) {OVER} AS taint_time FROM (SELECT *, CASE WHEN lvl > coalesce(before, 0) THEN coalesce(file_path, concat('command:', command)) END AS src, CASE WHEN lvl > coalesce(before, 0) THEN ts END AS seen
  FROM (SELECT *, max(lvl) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, {LEVEL_SQL} AS lvl FROM tc)))"""))
def _(spark, d):
    return W.taint(tool_calls(spark, d)).select("id", "taint_source", "taint_time")


@query("w3_trajectory", tc(f"SELECT id, count(*) {OVER} AS calls, CAST(sum(CAST(tool_name IN ('Write','Edit') AS INT)) {OVER} AS BIGINT) AS file_writes, CAST(sum(CAST(tool_name = 'Bash' AS INT)) {OVER} AS BIGINT) AS shell_commands, CAST(sum(CAST(tool_name = 'WebFetch' AS INT)) {OVER} AS BIGINT) AS web_fetches, CAST(sum(CAST(tool_name LIKE 'mcp%' AS INT)) {OVER} AS BIGINT) AS mcp_calls, CAST(sum(CASE WHEN tool_name = 'Read' AND {PATH_SQL} > 0 THEN 1 ELSE 0 END) {OVER} AS BIGINT) AS sensitive_reads FROM tc"))
def _(spark, d):
    return W.trajectory(tool_calls(spark, d)).select("id", "calls", "file_writes", "shell_commands", "web_fetches", "mcp_calls", "sensitive_reads")


RUNS_SQL = f"(SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY ts, id) AS consecutive FROM (SELECT *, sum(change) {OVER} AS run FROM (SELECT *, CASE WHEN tool_name = lag(tool_name) OVER (PARTITION BY session_id ORDER BY ts, id) THEN 0 ELSE 1 END AS change FROM tc)))"


@query("w4_consecutive", tc(f"SELECT id, CAST(consecutive AS INTEGER) AS consecutive FROM {RUNS_SQL}"))
def _(spark, d):
    return W.consecutive(tool_calls(spark, d)).select("id", "consecutive")


@query("w5_egress", tc(f"SELECT id, CAST(sum(bytes) {OVER} AS BIGINT) AS total_bytes, sum(bytes) {OVER} > 20971520 AS over_limit FROM tc"))
def _(spark, d):
    return W.egress(tool_calls(spark, d)).select("id", "total_bytes", "over_limit")


@query("w6_spend", tc("""SELECT id, round(total, 6) AS total_cost, (CASE WHEN t1 <= n THEN 1 ELSE 0 END) + (CASE WHEN t2 <= n THEN 1 ELSE 0 END) + (CASE WHEN t3 <= n THEN 1 ELSE 0 END) AS spend_level FROM (
  SELECT *, CASE WHEN f3 IS NOT NULL AND t2 IS NOT NULL THEN greatest(f3, t2 + 1) END AS t3 FROM (
  SELECT *, f1 AS t1, CASE WHEN f2 IS NOT NULL AND f1 IS NOT NULL THEN greatest(f2, f1 + 1) END AS t2 FROM (
  SELECT *, min(CASE WHEN total >= 5 THEN n END) OVER (PARTITION BY session_id) AS f1, min(CASE WHEN total >= 10 THEN n END) OVER (PARTITION BY session_id) AS f2, min(CASE WHEN total >= 20 THEN n END) OVER (PARTITION BY session_id) AS f3 FROM (
  SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS n, sum(ceil(input_chars / 4) * 30 / 1000000.0) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS total FROM tc))))"""))
def _(spark, d):
    return W.spend(tool_calls(spark, d)).select("id", F.round("total_cost", 6).alias("total_cost"), "spend_level")


SIGNALS_SQL = f"(SELECT *, sum(CAST(severity = 'CRITICAL' AS INT)) {OVER} AS det, sum(CAST(severity = 'HIGH' AS INT)) {OVER} AS near FROM se)"
LEVELS_SQL = f"(SELECT *, CASE WHEN det + floor(near / 2) >= 5 THEN 'CRITICAL' WHEN det + floor(near / 2) >= 3 THEN 'ELEVATED' ELSE 'NORMAL' END AS escalation FROM {SIGNALS_SQL})"


def _escalated(spark, d):
    return W.escalation(security_events(spark, d), F.col("severity") == "CRITICAL", F.col("severity") == "HIGH")


@query("w7_escalation", se(f"SELECT id, CAST(det AS BIGINT) AS detections, escalation, min(CASE WHEN severity = 'CRITICAL' THEN ts END) {OVER} AS first_detection FROM {LEVELS_SQL}"))
def _(spark, d):
    return _escalated(spark, d).select("id", "detections", "escalation", "first_detection")


@query("w8_escalated_action", se(f"SELECT id, CASE WHEN escalation = 'CRITICAL' AND upper(action) IN ('WARN','LOG') THEN 'ALERT' WHEN escalation = 'ELEVATED' AND action = 'warn' THEN 'ALERT' ELSE upper(action) END AS action, escalation <> coalesce(lag(escalation) OVER (PARTITION BY session_id ORDER BY ts, id), 'NORMAL') AS level_changed FROM {LEVELS_SQL}"))
def _(spark, d):
    return W.level_changes(_escalated(spark, d)).select("id", W.escalated_action(F.upper("action"), F.col("escalation")).alias("action"), "level_changed")


#: Every third session at even intervals of a minute, one of those with an interval a little off and one far off.
EVEN_SQL = "(SELECT * REPLACE (CASE WHEN user_no % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * n + CASE WHEN n = 3 THEN CASE user_no % 9 WHEN 3 THEN INTERVAL 4 MILLISECOND WHEN 6 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END ELSE INTERVAL 0 SECOND END ELSE ts END AS ts) FROM (SELECT *, CAST(substr(session_id, 2) AS BIGINT) AS user_no, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS n FROM se))"


@query("w9_uniform_intervals", se(f"SELECT session_id, count(*) AS n, count(*) >= 5 AND count(DISTINCT gap) = 1 AS uniform FROM (SELECT session_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, id)) / 10000.0) AS gap FROM {EVEN_SQL}) GROUP BY session_id"))
def _(spark, d):
    e = security_events(spark, d).withColumns({"user_no": F.substring("session_id", 2, 20).cast("long"), "n": F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "id"))})
    off = F.when(F.col("n") == 3, F.when(F.col("user_no") % 9 == 3, 4000).when(F.col("user_no") % 9 == 6, 1_000_000).otherwise(0)).otherwise(0)
    even = F.timestamp_micros(F.lit(1704067200_000000) + F.col("n").cast("long") * 60_000_000 + off)
    return W.uniform_intervals(e.withColumn("ts", F.when(F.col("user_no") % 3 == 0, even).otherwise(F.col("ts").cast("timestamp"))))


@query("w10_sensitive_reads", tc(f"SELECT id, level, place FROM (SELECT id, level, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS INTEGER) AS place FROM (SELECT *, {PATH_SQL} AS level FROM tc WHERE tool_name = 'Read') WHERE level > 0) WHERE place <= 100"))
def _(spark, d):
    return W.sensitive_reads(tool_calls(spark, d)).select("id", "level", "place")


@query("w11_last_events", se("SELECT id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS n FROM se) WHERE n <= 100"))
def _(spark, d):
    return W.last_n(security_events(spark, d), 100).select("id", "session_id")


@query("w12_top_in_layer", se(f"SELECT id, layer, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY {RANK} DESC, ts, id) AS n FROM se) WHERE n <= 50"))
def _(spark, d):
    return W.top_in_category(security_events(spark, d), "layer", 50).select("id", "layer", "place")


@query("w13_trajectory_violations", tc(f"""SELECT session_id, rule, min(ts) AS first_ts FROM (SELECT session_id, ts, unnest([CASE WHEN taint >= 3 AND calls >= 50 THEN 'secret_taint_over_50_calls' END, CASE WHEN tool_name = 'WebFetch' AND taint >= 2 AND fetches >= 10 THEN 'confidential_taint_over_10_webfetch' END, CASE WHEN tool_name = 'Bash' AND taint >= 2 AND shells >= 50 THEN 'confidential_taint_over_50_shell' END, CASE WHEN consecutive >= 20 AND taint >= 1 THEN 'consecutive_same_tool_over_20' END]) AS rule
  FROM (SELECT *, max({LEVEL_SQL}) {OVER} AS taint, count(*) {OVER} AS calls, sum(CAST(tool_name = 'WebFetch' AS INT)) {OVER} AS fetches, sum(CAST(tool_name = 'Bash' AS INT)) {OVER} AS shells FROM {RUNS_SQL})) WHERE rule IS NOT NULL GROUP BY 1, 2"""))
def _(spark, d):
    return W.trajectory_violations(tool_calls(spark, d))


FORBIDS_SQL = {
    "forbid-env-read": "tool_name = 'Read' AND file_path LIKE '%.env%'",
    "forbid-force-push": "tool_name = 'Bash' AND command LIKE 'git %' AND command LIKE '%push%--force%'",
    "forbid-network-when-confidential-taint": "tool_name = 'WebFetch' AND taint >= 2",
    "forbid-shell-network-when-tainted": "tool_name = 'Bash' AND command NOT LIKE 'git %' AND taint >= 2 AND command LIKE '%curl %'",
    "forbid-curl-pipe-sh": "tool_name = 'Bash' AND command LIKE '%curl%|%sh%'",
    "forbid-secret-file-read-in-network-context": "tool_name = 'Read' AND fetches >= 1 AND (contains(file_path, '.env') OR contains(file_path, '.ssh') OR contains(file_path, 'credentials'))",
    "forbid-network-with-confidential-taint": "tool_name = 'WebFetch' AND taint >= 2",
    "forbid-secret-taint-over-50-calls": "taint >= 3 AND calls >= 50",
    "forbid-confidential-taint-over-10-webfetch": "tool_name = 'WebFetch' AND taint >= 2 AND fetches >= 10",
    "forbid-confidential-taint-over-50-shell": "tool_name = 'Bash' AND command NOT LIKE 'git %' AND taint >= 2 AND shells >= 50",
    "forbid-consecutive-same-tool-over-20": "consecutive >= 20 AND taint >= 1",
}
FORBIDDEN_SQL = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in FORBIDS_SQL.items()) + "], lambda x: x IS NOT NULL)"


@query("g2_forbids", tc(f"""SELECT id, CASE WHEN len(f) > 0 THEN 'DENY' ELSE 'ALLOW' END AS decision, array_to_string(f, ',') AS forbids FROM (SELECT id, {FORBIDDEN_SQL} AS f
  FROM (SELECT *, max({LEVEL_SQL}) {OVER} AS taint, count(*) {OVER} AS calls, sum(CAST(tool_name = 'WebFetch' AS INT)) {OVER} AS fetches, sum(CAST(tool_name = 'Bash' AS INT)) {OVER} AS shells FROM {RUNS_SQL}))"""))
def _(spark, d):
    state = W.consecutive(W.trajectory(W.taint(tool_calls(spark, d))))
    return G.evaluate_forbids(state).select("id", "decision", F.array_join("forbids", ",").alias("forbids"))


@query("d3_session_fold", f"""SELECT e.session_id, a.id, a.taint_level, t.calls, t.file_writes, t.shell_commands, t.web_fetches, t.mcp_calls, CAST(c.consecutive AS BIGINT) AS consecutive, b.total_bytes, s.total_cost, s.spend_level, x.escalation
FROM ({ORACLES["w1_taint"]}) a JOIN ({ORACLES["w3_trajectory"]}) t ON t.id = a.id JOIN ({ORACLES["w4_consecutive"]}) c ON c.id = a.id JOIN ({ORACLES["w5_egress"]}) b ON b.id = a.id JOIN ({ORACLES["w6_spend"]}) s ON s.id = a.id
JOIN ({ORACLES["w7_escalation"]}) x ON x.id = a.id JOIN ({se("SELECT id, session_id FROM se")}) e ON e.id = a.id""")
def _(spark, d):
    return X.session_fold(tool_calls(spark, d)).withColumn("total_cost", F.round("total_cost", 6))


_BY_USER, _BY_THIRD = "concat('s', CAST(user_id AS VARCHAR)) AS session_id", "concat('s', CAST(user_id % 3 AS VARCHAR)) AS session_id"


@query("w14_sessions_in_blocks", ORACLES["d3_session_fold"].replace(_BY_USER, _BY_THIRD))
def _(spark, d):
    """Three large sessions, cut into blocks."""
    calls = tool_calls(spark, d).withColumn("session_id", F.concat(F.lit("s"), (F.substring("session_id", 2, 20).cast("long") % 3).cast("string")))
    rows = W.all_in_blocks(calls, F.col("severity") == "CRITICAL", F.col("severity") == "HIGH", block_rows=500)
    counters = ["taint_level", "calls", "file_writes", "shell_commands", "web_fetches", "mcp_calls"]
    return rows.select("session_id", "id", *counters, F.col("consecutive").cast("long").alias("consecutive"), "total_bytes", F.round("total_cost", 6).alias("total_cost"), "spend_level", "escalation")


# --- sets, scalars ------------------------------------------------------------------------------------------
@query("u1_timeline", rp(f"""SELECT session_id, id, kind, label, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC, kind) AS place FROM (
  SELECT session_id, ts, id, log AS kind, tool_name AS label FROM re WHERE log = 'tool' UNION ALL SELECT session_id, ts, id, log, concat('Governor: ', policy_matched) FROM re WHERE log = 'governor' AND policy_matched <> 'none'
  UNION ALL SELECT session_id, ts, id, log, 'Memory Poisoning' FROM re WHERE log = 'memory' AND severity = 'CRITICAL' UNION ALL SELECT session_id, ts, id, log, 'Injection Detected' FROM re WHERE log = 'injection' AND detected
  UNION ALL SELECT session_id, ts, id, 'security-radar', concat('Radar: ', policy_matched) FROM re WHERE log = 'securityRadar' UNION ALL SELECT session_id, ts, id, log, severity FROM re WHERE log = 'error'
  UNION ALL SELECT session_id, ts, id, log, tool_name FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS n FROM re WHERE log = 'evaluator') WHERE n <= 10)) WHERE place <= 30"""))
def _(spark, d):
    r = report_events(spark, d)
    hits, of = r.filter(A.report_rows()), lambda df, log: df.filter(F.col("log") == log)
    evaluated = of(r, "evaluator").withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "id"))).filter("_n <= 10")
    return A.timeline(
        (of(r, "tool"), "tool", F.col("tool_name")),
        (of(hits, "governor"), "governor", F.concat(F.lit("Governor: "), "policy_matched")),
        (of(r, "memory").filter("severity = 'CRITICAL'"), "memory", F.lit("Memory Poisoning")),
        (of(hits, "injection"), "injection", F.lit("Injection Detected")),
        (of(r, "securityRadar"), "security-radar", F.concat(F.lit("Radar: "), "policy_matched")),
        (of(r, "error"), "error", F.col("severity")),
        (evaluated, "evaluator", F.col("tool_name")),
    ).select("session_id", "id", "kind", "label", "place")


@query("u2_session_bounds", se("SELECT session_id, min(ts) AS start, max(ts) AS \"end\" FROM se WHERE layer IN ('L0', 'L1', 'L4') GROUP BY session_id"))
def _(spark, d):
    e = security_events(spark, d)
    return A.session_bounds(*[e.filter(F.col("layer") == x) for x in ("L0", "L1", "L4")])


#: What leaves by a call: secrets, personal data, runs of base64 and plain texts.
SENT = [*SECRETS, *examples(R.EGRESS_PII), ("A" * 10300, False), ("nothing", False)]
_SENT_SQL = f"sent AS (SELECT id, session_id, ts, bytes, url, ([{', '.join(quoted(t) for t, _ in SENT)}])[id % {len(SENT)} + 1] AS text FROM tc)"


@query("u3_findings_union", tc(f"""SELECT id, rule_id FROM (WITH {_SENT_SQL} {scan_sql("sent", "id", "text", R.EGRESS_SECRET + R.EGRESS_PII)}
UNION ALL SELECT id, 'bulk', CASE WHEN bytes > 512000 OR total > 20971520 THEN 'CRITICAL' ELSE 'MEDIUM' END, '' FROM (SELECT *, sum(bytes) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS total FROM sent) WHERE bytes > 51200 OR total > 20971520
UNION ALL SELECT id, 'destination', '', '' FROM sent WHERE regexp_matches(url, '(?i)pastebin\\.com') OR regexp_matches(url, '^[a-z]+://[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}(/|$)')
UNION ALL SELECT id, 'base64', '', '' FROM sent WHERE length(regexp_extract(text, '[A-Za-z0-9+/]{{100,}}={{0,2}}', 0)) > 10240)"""))
def _(spark, d):
    """All five kinds of egress findings of each call: secrets, personal data, bulk, destination, base64."""
    text = F.element_at(F.array(*[F.lit(t) for t, _ in SENT]), (F.col("id") % len(SENT) + 1).cast("int"))
    return P.egress_findings(W.egress(tool_calls(spark, d).withColumn("text", text)), "text").select("id", F.explode("findings").alias("rule_id"))


@query("u4_distinct_ids", se(f"SELECT DISTINCT technique FROM se JOIN {TECH_SQL} ON se.layer = t.layer"))
def _(spark, d):
    rows = security_events(spark, d).select("layer").distinct().join(F.broadcast(logs.report_map(spark)), "layer")
    return rows.agg(F.array_distinct(F.flatten(F.collect_list("atlas"))).alias("ids")).select(F.explode("ids").alias("technique"))


@query("c7_typosquats", "WITH n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part) SELECT a.name, b.name AS near, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance FROM n a JOIN n b ON abs(length(a.name) - length(b.name)) <= 2 AND levenshtein(a.name, b.name) BETWEEN 1 AND 2")
def _(spark, d):
    names = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    return A.typosquats(names, names)


@query("c8_egress_bytes", tc("""SELECT id, coalesce(url, CASE WHEN command LIKE 'curl%' THEN 'http://h/x' END) AS destination, CASE WHEN tool_name = 'Bash' THEN command ELSE '{"url":"' || url || '"}' END AS content,
  CAST(strlen(CASE WHEN tool_name = 'Bash' THEN command ELSE '{"url":"' || url || '"}' END) AS INTEGER) AS bytes FROM tc WHERE tool_name IN ('Bash', 'WebFetch')"""))
def _(spark, d):
    calls = tool_calls(spark, d).filter("tool_name IN ('Bash', 'WebFetch')")
    params = F.map_filter(F.create_map(F.lit("command"), F.col("command"), F.lit("url"), F.col("url")), lambda _, v: v.isNotNull())
    return calls.select("id", S.egress_payload(F.col("tool_name"), params).alias("p")).select("id", "p.destination", "p.content", "p.bytes")


@query("c10_tokens", "SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.token_estimate(F.length("text")).alias("tokens"))


@query("c11_redactions", "SELECT doc_id, concat(substr(text, 1, 20), '...') AS preview, CASE WHEN length(source) > 8 THEN concat(substr(source, 1, 4), '****', right(source, 4)) ELSE '****' END AS masked, CASE WHEN length(text) > 12 THEN concat(substr(text, 1, 4), '...', right(text, 4)) ELSE '[REDACTED]' END AS short FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"), S.mask_middle(F.col("source")).alias("masked"), S.ellipsis_middle(F.col("text")).alias("short"))


@query("c13_entropy", "SELECT page_id, round(list_entropy(string_split(url, '')), 6) AS bits FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.round(S.entropy(F.col("url")), 6).alias("bits"))


@query("c14_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("sha256"))


@query("c16_sections", f"WITH {SECTIONS_SQL} SELECT doc_id, no, title, start_line, CAST(length(body) AS INTEGER) AS chars FROM sections")
def _(spark, d):
    docs = planted(table(spark, d, "documents"), "doc_id", "text", SECTIONED)
    return docs.select("doc_id", F.explode(S.sections(F.col("text"))).alias("s")).select("doc_id", "s.no", "s.title", "s.start_line", F.length("s.body").alias("chars"))


@query("c18_truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...[truncated]') ELSE text END AS cut FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.truncate(F.col("text"), 200).alias("cut"))


@query("c19_taint_label", tc(f"SELECT id, CASE {PATH_SQL} WHEN 3 THEN 'SECRET' WHEN 1 THEN 'INTERNAL' ELSE 'PUBLIC' END AS label FROM tc WHERE file_path IS NOT NULL"))
def _(spark, d):
    return tool_calls(spark, d).filter("file_path IS NOT NULL").select("id", S.taint_label(S.path_sensitivity(F.col("file_path"))).alias("label"))


@query("c20_duration", se("SELECT session_id, CASE WHEN s < 60 THEN concat(CAST(s AS VARCHAR), 's') WHEN s < 3600 THEN concat(CAST(s // 60 AS VARCHAR), 'm ', CAST(s % 60 AS VARCHAR), 's') ELSE concat(CAST(s // 3600 AS VARCHAR), 'h ', CAST((s // 60) % 60 AS VARCHAR), 'm') END AS duration FROM (SELECT session_id, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS s FROM se GROUP BY session_id)"))
def _(spark, d):
    s = A.session_summary(security_events(spark, d))
    return s.select("session_id", S.duration_text(((F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000).cast("long")).alias("duration"))


@query("c21_escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS escaped FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", S.escape_html(F.col("html")).alias("escaped"))


@query("c25_severity_rank", se(f"SELECT severity, {RANK} AS severity_rank, count(*) AS n FROM se GROUP BY 1, 2"))
def _(spark, d):
    return security_events(spark, d).groupBy("severity", S.severity_rank(F.col("severity")).alias("severity_rank")).agg(F.count(F.lit(1)).alias("n"))
