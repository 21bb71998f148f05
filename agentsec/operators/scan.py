"""Content operators: pattern scans, scores and verdicts over text, code, configuration and memory."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..rules import packs
from ..rules.compile import DESTINATIONS, EGRESS_PII, EGRESS_SECRET, LINTER, MENTION, PARAMETER_SECRET, SKILL, Rule, findings, first_match, gate, matches_any, pack, pinned, with_gate, without_gate


def scan(df: DataFrame, text: str, rules: Sequence[Rule], cut: int = 100, normalise: bool = False, gated: bool = True) -> DataFrame:
    """`df` with `findings`, `severity` (the highest) and `categories` (distinct, in order)."""
    rows, content = (df.withColumn("_gate_text", S.normalise_unicode(F.col(text))), F.col("_gate_text")) if normalise else (df, F.col(text))
    passes = None
    if gated:
        rows, passes = with_gate(rows, content, rules)
    rows = without_gate(rows.withColumn("findings", pinned(findings(content, rules, cut, gated, passes))))
    return rows.withColumns({"severity": max_severity(F.col("findings")), "categories": F.array_distinct(F.col("findings.category"))})


def quick_scan(df: DataFrame, text: str, rules: Sequence[Rule], name: str = "hit") -> DataFrame:
    """`df` with whether any rule matches."""
    rows, passes = with_gate(df, F.col(text), rules)
    return without_gate(rows.withColumn(name, pinned(matches_any(F.col(text), rules, passes))))


def max_severity(found: Column) -> Column:
    return S.rank_severity(F.array_max(F.transform(found, lambda f: S.severity_rank(f["severity"]))))


def exploded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.explode("findings").alias("f")).select(*keys, "f.*")


def context_scan(df: DataFrame, text: str, rules: Sequence[Rule], limit: int = 10) -> DataFrame:
    """Findings in rule order, none inside code syntax; inside documentation HIGH and above become LOW and the rest go.

    Texts are normalised once, in a column of their own; markers are looked for around hits only.
    """
    raw, norm = F.col(text), F.col("_gate_norm")

    def near(f: Column, back: int, markers: Sequence[str]) -> Column:
        # the place is that in the normalised text, the window is cut from the raw one
        start = F.greatest(f["pos"] - 1 - back, F.lit(0))
        window = F.substring(raw, start + 1, f["pos"] - 1 + F.length(f["match"]) + 100 - start)
        out = F.lit(False)
        for m in markers:
            out = out | window.rlike(m)
        return out

    def lowered(f: Column) -> Column:
        doc = near(f, 150, packs.DOCUMENTATION_MARKERS)
        severity = F.when(~doc, f["severity"]).when(f["severity"].isin("CRITICAL", "HIGH"), F.lit("LOW"))
        return F.struct(f["rule_id"].alias("rule_id"), f["category"].alias("category"), severity.alias("severity"), F.substring(f["match"], 1, 100).alias("match"), f["pos"].alias("pos"))

    rows, passes = with_gate(df.withColumn("_gate_norm", pinned(S.normalise_unicode(raw))), norm, rules)
    rows = rows.withColumn("_gate_found", pinned(findings(norm, rules, 100_000, passes=passes)))
    rows = rows.withColumn("_gate_kept", F.filter("_gate_found", lambda f: ~near(f, 400, packs.CODE_MARKERS)))
    rows = rows.withColumn("_gate_low", F.transform("_gate_kept", lowered))
    return without_gate(rows.withColumn("findings", F.slice(F.filter("_gate_low", lambda f: f["severity"].isNotNull()), 1, limit)))


def heuristic_score(df: DataFrame, text: str, name: str = "heuristic") -> DataFrame:
    """`df` with (score, indicators, suspicious): weights of the phrases that the lower-cased text contains."""
    score, names = F.lit(0), []
    for group, phrase, weight in packs.HEURISTIC_PHRASES:
        has = F.contains(F.col("_gate_low"), F.lit(phrase))
        score = score + F.when(has, weight).otherwise(0)
        names.append(F.when(has, F.lit(f'{group}: "{phrase}"')))
    value = F.struct(score.alias("score"), F.array_compact(F.array(*names)).alias("indicators"), (score >= 5).alias("suspicious"))
    return without_gate(df.withColumn("_gate_low", pinned(F.lower(F.col(text)))).withColumn(name, pinned(value)))


def alert_action(severity: Column, found: Column, suspicious: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "ALERT").when(found | suspicious, "WARN").otherwise("LOG")


def base64_blob(text: Column, least: int = 10 * 1024) -> Column:
    """Whether the first run of 100 base64 characters or more is longer than `least`."""
    return F.coalesce(F.length(F.regexp_extract(text, r"[A-Za-z0-9+/]{100,}={0,2}", 0)) > least, F.lit(False))


def bulk_transfer(size: Column, total_after: Column) -> Column:
    """CRITICAL above 500 KiB or with more than 20 MiB in the session, MEDIUM above 50 KiB."""
    return F.when((size > 500 * 1024) | (total_after > 20 * 1024 * 1024), "CRITICAL").when(size > 50 * 1024, "MEDIUM")


def egress_findings(calls: DataFrame, text: str, url: str = "url", size: str = "bytes", total: str = "total_bytes") -> DataFrame:
    """`calls` with the names of what is found in what they send, in order: secrets, personal data, `bulk`, `destination`, `base64`."""
    rules = [*EGRESS_SECRET, *EGRESS_PII]
    rows, passes = with_gate(calls, F.col(text), rules)
    names = F.transform(findings(F.col(text), rules, passes=passes), lambda f: f["rule_id"])
    others = {"bulk": bulk_transfer(F.col(size), F.col(total)).isNotNull(), "destination": blocked_destination(F.col(url), DESTINATIONS).isNotNull(), "base64": base64_blob(F.col(text))}
    more = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in others.items()]))
    return without_gate(rows.withColumn("findings", pinned(F.concat(names, more))))


def blocked_destination(url: Column, rules: Sequence[Rule]) -> Column:
    """(name, severity, by): first blocked host; a rule anchored as a whole is tried on the URL's host too."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    tests = []
    for r in rules:
        tests += (F.when(url.rlike(r.regex), F.struct(F.lit(r.id).alias("name"), F.lit(r.severity).alias("severity"), F.lit("url").alias("by"))), F.when(host.rlike(r.regex), F.struct(F.lit(r.id).alias("name"), F.lit(r.severity).alias("severity"), F.lit("host").alias("by"))))
    return F.coalesce(*tests)


def dlp_scan(df: DataFrame, text: str, rules: Sequence[Rule], name: str = "findings") -> DataFrame:
    """`df` with array<struct<category, severity, count, preview>>: all matches of each rule, the first one masked."""
    rows, passes = with_gate(df, F.col(text), rules)
    content = F.col(text)
    one = [F.when(passes(r) & content.rlike(r.regex), F.struct(F.lit(r.id).alias("category"), F.lit(r.severity).alias("severity"), F.regexp_count(content, F.lit(r.regex)).alias("count"), S.mask_middle(F.regexp_extract(content, r.regex, 0)).alias("preview"))) for r in rules]
    return without_gate(rows.withColumn(name, pinned(F.array_compact(F.array(*one)))))


#: Parameters that are never scanned for secrets. Fixed values.
SKIPPED_PARAMETERS = ["file_path", "filePath", "cwd", "timeout", "offset", "limit"]


def parameter_secrets(calls: DataFrame, params: str = "tool_input", keys: Sequence[str] = ("id",)) -> DataFrame:
    """(keys, param, rule, preview): the first rule that each parameter of 10 characters or more matches."""
    each = calls.select(*keys, F.explode(params).alias("param", "value")).filter(~F.col("param").isin(SKIPPED_PARAMETERS) & (F.length("value") >= 10))
    hit = F.coalesce(*[F.when(F.col("value").rlike(r.regex), F.struct(F.lit(r.id).alias("rule"), S.ellipsis_middle(F.regexp_extract("value", r.regex, 0)).alias("preview"))) for r in PARAMETER_SECRET])
    return each.withColumn("hit", hit).filter("hit IS NOT NULL").select(*keys, "param", "hit.*")


#: Code families in order: (name, label, severity). Fixed values.
FAMILIES = [
    ("sql", "sql_injection", 4), ("command", "command_injection", 4), ("api_key", "hardcoded_api_key", 4), ("password", "hardcoded_password", 4), ("file", "path_traversal", 3), ("deserialization", "unsafe_deserialization", 3),
    ("prompt", "prompt_injection", 3), ("xss", "xss", 2), ("crypto", "weak_crypto", 2), ("ci_injection", "ci_expression", 4),
]
#: Families whose keywords count where no pattern matches: label and severity. Fixed values.
KEYWORDS = {"sql": ("sql_keywords", 2), "command": ("shell_keywords", 3)}


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` where `value` is computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def code_triggers(text: Column, lower: Column, lang: Column) -> Column:
    """array<struct<label, rank>> of the families that `text` matches, each pattern tried once and behind its literals."""

    def any_of(patterns: Sequence[str]) -> Column:
        rules = [Rule(p, "", "", "", p) for p in patterns]
        return reduce(operator.or_, [gate(r, lower) & text.rlike(r.pattern) for r in rules])

    def trigger(label: str, rank: int) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(rank).alias("rank"))

    found = []
    for name, label, rank in FAMILIES:
        test = any_of(packs.CODE_FAMILIES[name])
        hit = F.when((lang == "yaml") & test if name == "ci_injection" else test, trigger(label, rank))
        found.append(hit.when(text.rlike(packs.CODE_KEYWORDS[name]), trigger(*KEYWORDS[name])) if name in KEYWORDS else hit)
    return F.array_compact(F.array(*found))


def classify_code(content: Column, lang: Column) -> Column:
    """(triggers, risk, confidence, classification, blocked) of a piece of code, after look-alike letters are folded."""

    def decide(found: Column) -> Column:
        n, rank = F.size(found), F.coalesce(F.array_max(F.transform(found, lambda t: t["rank"])), F.lit(1))
        confidence = F.when((rank == 4) | (n >= 3), "HIGH").when(n != 1, "MEDIUM").otherwise("LOW")
        return F.struct(
            F.transform(found, lambda t: t["label"]).alias("triggers"), S.rank_severity(rank).alias("risk"), confidence.alias("confidence"),
            F.when(n > 0, "SECURITY_SENSITIVE").otherwise("SAFE").alias("classification"), ((n > 0) & (rank == 4)).alias("blocked"),
        )

    texts = with_value(S.normalise_unicode(content), lambda c: F.struct(c.alias("text"), F.lower(c).alias("lower")))
    return with_value(with_value(texts, lambda t: code_triggers(t["text"], t["lower"], lang)), decide)


def _matches(rule: Rule):
    return lambda s: F.coalesce(s.rlike(rule.regex), F.lit(False))


#: Names and extensions of a language -> the key by which the line rules know it. Fixed values.
RULE_LANGUAGES = {"ts": "ts", "tsx": "ts", "mts": "ts", "typescript": "ts", "js": "js", "jsx": "js", "mjs": "js", "javascript": "js", "py": "py", "python": "py"}


def rule_language(lang: Column) -> Column:
    name = F.regexp_replace(F.lower(lang), r"^\.", "")
    return F.coalesce(*[F.when(name.isin(*[n for n, k in RULE_LANGUAGES.items() if k == key]), F.lit(key)) for key in ("ts", "js", "py")], name)


def lint_lines(df: DataFrame, content: str, lang: Column, keys: Sequence[str], rules: Sequence[Rule] = LINTER) -> DataFrame:
    """(keys, rule_id, severity, line): first line of each rule that applies to the language, given by name or extension; comment lines are skipped."""
    rows, passes = with_gate(df, F.col(content), rules)
    lines, lang = F.split(F.col(content), "\n"), rule_language(lang)
    comment = lambda s: s.rlike(r"^[\s\p{Z}\x{FEFF}]*(?://|#|\*)")
    code = F.transform(lines, lambda s: F.when(~comment(s), s))
    out = []
    for r in rules:
        at = F.array_position(F.transform(code, _matches(r)), True)
        applies = F.lit(True) if "*" in r.languages or not r.languages else lang.isin(*r.languages)
        # in the whole text a look-ahead may see the next line, so only what stands before it is tried there
        may = applies & passes(r) & F.col(content).rlike(r.regex.split("(?!")[0])
        out.append(F.when(may, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), at.cast("int").alias("line"))))
    found = rows.withColumn("_gate_found", pinned(F.filter(F.array(*out), lambda f: f["line"] > 0)))
    return found.select(*keys, F.explode("_gate_found").alias("f")).select(*keys, "f.*")


def first_lines(lines: DataFrame, rules: Sequence[Rule], keys: Sequence[str], text: str = "text", normalise: bool = False) -> DataFrame:
    """(keys, rule_id, severity, line): the first line on which each rule matches, of a table of lines (keys, line, text) as `logs.numbered_lines` reads it.

    What `lint_lines` and `memory_document_scan` find, for files too large to be one row. normalise: of the normalised line, LOW rules left out, as
    memory documents are scanned; else comment lines are skipped and the rules are those of the linter that apply.
    """
    kept = [r for r in rules if r.severity != "LOW"] if normalise else rules
    rows = lines if normalise else lines.filter(~F.col(text).rlike(r"^[\s\p{Z}\x{FEFF}]*(?://|#|\*)"))
    found = scan(rows, text, kept, normalise=normalise)
    hits = found.select(*keys, "line", F.explode("findings").alias("f")).select(*keys, "line", "f.rule_id", "f.severity")
    return hits.groupBy(*keys, "rule_id", "severity").agg(F.min("line").cast("int").alias("line"))


def skill_verdict(df: DataFrame, text: str) -> DataFrame:
    """`df` with `findings` and `verdict`: BLOCK with a CRITICAL finding, WARN with any, else PASS."""
    rows = scan(df, text, SKILL)
    return rows.withColumn("verdict", F.when(F.col("severity") == "CRITICAL", "BLOCK").when(F.size("findings") > 0, "WARN").otherwise("PASS")).drop("severity", "categories")


#: Fixed values.
MCP_PACKAGES = ["colors", "faker", "event-stream", "flatmap-stream", "ua-parser-js", "coa", "rc", "peacenotwar", "node-ipc", "es5-ext"]


def scan_mcp_config(configs: DataFrame, key: str = "config_id", text: str = "json") -> DataFrame:
    """(key, server, rule_id, severity): blocked URLs and instructions in the whole configuration, commands in it or a command line,
    packages by whole name on a command line, URLs in environment values; what isn't JSON is one HIGH finding."""
    urls, commands, words = pack(packs.MCP_URL), pack(packs.MCP_COMMAND), pack(packs.MCP_INJECTION)
    parsed = configs.withColumn("c", F.from_json(text, "mcpServers map<string, struct<command:string,args:array<string>,env:map<string,string>>>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    none = F.lit(None).cast("string")
    finding = lambda found: F.transform(found, lambda f: F.struct(f["rule_id"].alias("rule_id"), f["severity"].alias("severity")))
    bad = parsed.filter("c IS NULL OR c._bad IS NOT NULL").select(key, none.alias("server"), F.lit("invalid-json").alias("rule_id"), F.lit("HIGH").alias("severity"))
    good = parsed.filter("c IS NOT NULL AND c._bad IS NULL")
    whole = good.select(key, none.alias("server"), F.explode(finding(F.concat(findings(F.col(text), urls), findings(F.col(text), commands), findings(F.col(text), words)))).alias("f")).select(key, "server", "f.*")
    each = good.select(key, F.explode("c.mcpServers").alias("server", "s"))
    line = F.concat_ws(" ", F.col("s.command"), F.array_join(F.coalesce("s.args", F.array().cast("array<string>")), " "))
    packages = F.array_compact(F.array(*[F.when(line.rlike(rf"(?i)(?<![\w-]){p}(?![\w-])"), F.struct(F.lit(f"package:{p}").alias("rule_id"), F.lit("CRITICAL").alias("severity"))) for p in MCP_PACKAGES]))
    env = F.array_join(F.coalesce(F.map_values("s.env"), F.array().cast("array<string>")), "\n")
    own = each.select(key, "server", F.explode(F.concat(finding(findings(line, commands)), packages, finding(findings(env, urls)))).alias("f")).select(key, "server", "f.*")
    return bad.union(whole).union(own).distinct()


def mcp_verdict(top: Column) -> Column:
    return F.when(top == "CRITICAL", "BLOCKED").when(top == "HIGH", "WARNED").otherwise("PASSED")


# --- memory -------------------------------------------------------------------------------------------------

MEMORY_INPUT = "entities array<struct<name:string,entityType:string,observations:array<string>>>, relations array<struct<from:string,to:string,relationType:string>>, observations array<struct<entityName:string,contents:array<string>>>"


def memory_strings(writes: DataFrame, key: str = "id", column: str = "tool_input") -> DataFrame:
    """(key, location, text): every string of a memory write with its path."""
    entity = writes.select(key, F.posexplode(f"{column}.entities").alias("i", "e"))
    names = entity.select(key, F.format_string("entities[%d].name", "i").alias("location"), F.col("e.name").alias("text"))
    seen = entity.select(key, "i", F.posexplode("e.observations").alias("j", "text")).select(key, F.format_string("entities[%d].observations[%d]", "i", "j"), "text")
    relation = writes.select(key, F.posexplode(f"{column}.relations").alias("i", "r"))
    types = relation.select(key, F.format_string("relations[%d].relationType", "i"), "r.relationType")
    added = writes.select(key, F.posexplode(f"{column}.observations").alias("i", "o")).select(key, "i", F.posexplode("o.contents").alias("j", "text")).select(key, F.format_string("observations[%d].contents[%d]", "i", "j"), "text")
    return names.union(seen).union(types).union(added).filter("text IS NOT NULL")


def memory_issues(text: Column) -> Column:
    """array<struct<kind, detail>>: first injection words, first false fact, encoding, sensitive data. Lower-casing comes before normalising."""
    lower = S.normalise_unicode(F.lower(text))
    word = F.coalesce(*[F.when(F.contains(lower, F.lit(w)), F.lit(w)) for w in packs.MEMORY_INJECTION_WORDS])
    fact = F.coalesce(*[F.when(F.contains(lower, F.lit(w)), F.lit(w)) for w in packs.MEMORY_FAKE_FACTS])
    encoded, sensitive = F.lit(False), F.lit(False)
    for p in packs.MEMORY_ENCODINGS:
        encoded = encoded | text.rlike(p)
    for p in packs.MEMORY_SENSITIVE:
        sensitive = sensitive | text.rlike(p)
    issue = lambda test, kind, detail: F.when(test, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    none = F.lit(None).cast("string")
    return F.array_compact(F.array(issue(word.isNotNull(), "injection", word), issue(fact.isNotNull(), "fake_fact", fact), issue(encoded, "encoding", none), issue(sensitive, "sensitive", none)))


def memory_limits(write: Column) -> Column:
    """Names of the limits a memory write passes: 20 entities, names of 100, 50 observations, texts of 2000."""
    seen = F.flatten(F.concat(F.coalesce(F.transform(write["entities"], lambda e: e["observations"]), F.array().cast("array<array<string>>")), F.coalesce(F.transform(write["observations"], lambda o: o["contents"]), F.array().cast("array<array<string>>"))))
    tests = {"entities": F.size(write["entities"]) > 20, "name": F.exists(write["entities"], lambda e: F.length(e["name"]) > 100), "observations": F.size(seen) > 50, "text": F.exists(seen, lambda t: F.length(t) > 2000)}
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


#: What an id's parts say of a rule of memory documents, in order; `detection` without any. Fixed values.
MEMORY_KINDS = [("inj", "injection"), ("fake", "fake_fact"), ("enc", "encoding"), ("sens", "sensitive")]


def memory_kind(rule_id: str) -> str:
    return "persistence" if rule_id.startswith("persist") else next((kind for part, kind in MEMORY_KINDS if part in rule_id), "detection")


def memory_document_scan(docs: DataFrame, rules: Sequence[Rule], keys: Sequence[str], text: str = "text", offset: Column | None = None) -> DataFrame:
    """(keys, rule_id, severity, kind, line): each rule once in a document, at its first line; LOW rules are ignored.

    offset: lines of the whole file before a section, so that `line` counts in the file.
    """
    # the folded text is a column of its own, so no rule computes it again; lines are tried only where the whole text may match
    before = F.lit(0) if offset is None else F.coalesce(offset, F.lit(0))
    folded = docs.select(*keys, pinned(S.normalise_unicode(F.col(text))).alias("_text"), before.cast("int").alias("_before"))
    ready = folded.select(*keys, "_before", "_text", F.lower("_text").alias("_lower"), F.split("_text", "\n").alias("_lines"))
    out = []
    for r in rules:
        if r.severity != "LOW":
            may = gate(r, F.col("_lower"))
            if not any(mark in r.regex for mark in ("^", "$", "\\z", "(?=", "(?!", "(?<")):
                may = may & F.col("_text").rlike(r.regex)
            at = F.when(may, F.array_position(F.transform("_lines", _matches(r)), True))
            kind = memory_kind(r.id)
            line = F.when(at > 0, at.cast("int") + F.col("_before"))
            out.append(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(kind).alias("kind"), line.alias("line")))
    found = ready.withColumn("_found", pinned(F.filter(F.array(*out), lambda f: f["line"].isNotNull())))
    return found.select(*keys, F.explode("_found").alias("f")).select(*keys, "f.*")


def split_quarantine(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined) sections (key, no, title, body, start_line): a section with a CRITICAL finding is quarantined."""
    each = docs.select(key, F.explode(S.sections(F.col(text))).alias("s")).select(key, "s.*")
    critical = [r for r in rules if r.severity == "CRITICAL"]
    rows, passes = with_gate(each.withColumn("_gate_body", pinned(S.normalise_unicode(F.col("body")))), F.col("_gate_body"), critical)
    marked = without_gate(rows.withColumn("bad", pinned(matches_any(F.col("_gate_body"), critical, passes))))
    return marked.filter("NOT bad").drop("bad"), marked.filter("bad").drop("bad")


def fabrication_signs(text: Column) -> Column:
    """Names of fabrication signs in a session's text."""
    tests = {"placeholder_id": r"msg_(?:corrected|fabricated|modified|injected)_\d+", "authorisation_claim": r"(?i)AUTHORIZED:\s*.{0,30}(?:access|grant|approv|admin)", "policy_override": r"(?i)approval_policy:\s*never", "explicit_marker": r"(?i)(?:fabricat|manufactur|synthetic|forged)\s+(?:session|conversation|exchange)"}
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in tests.items()]))


def mentions(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys, mention, rule_id): every `@path` and the first sensitive path rule it matches."""
    each = df.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"@([^\s,;]+)"), F.lit(1))).alias("mention"))
    return each.withColumn("rule_id", first_match(F.col("mention"), MENTION)).filter("rule_id IS NOT NULL")


def prompt_risk(agent_type: Column, prompt: Column, high_risk: Sequence[str] = ("general-purpose", "pentester", "engineer")) -> Column:
    sensitive = F.lit(False)
    for p in packs.SUBAGENT_PROMPT:
        sensitive = sensitive | prompt.rlike(p)
    risky = agent_type.isin(*high_risk)
    return F.when(risky & sensitive, "CRITICAL").when(sensitive, "HIGH").when(risky, "MEDIUM").otherwise("LOW")


# --- images -------------------------------------------------------------------------------------------------

#: Tool marks and phrases in image bytes. Fixed values.
STEGO_SIGNATURES = [b"steghide", b"openstego", b"outguess", b"jsteg", b"f5", b"invisible secrets"]
IMAGE_PHRASES = ["ignore previous", "system prompt", "new instructions", "you are now", "disregard"]


def byte_entropy(data: bytes) -> float:
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / max(len(data), 1)
    return float(-(p * np.log2(p)).sum())


def image_signs(data: bytes) -> list[str]:
    """Trailing bytes, high entropy, tool marks and instruction phrases in an image."""
    signs, end = [], -1
    if data[:4] == b"\x89PNG":
        at = data.find(b"IEND")
        end = at + 8 if at >= 0 else -1
    elif data[:2] == b"\xff\xd8":
        at = data.rfind(b"\xff\xd9")
        end = at + 2 if at >= 0 else -1
    if 0 <= end < len(data) - 100:
        signs.append("trailing_data")
    if data and byte_entropy(data) > 7.9:
        signs.append("high_entropy")
    head = data[:10_000].lower()
    signs += [f"signature:{s.decode()}" for s in STEGO_SIGNATURES if s.lower() in head]
    printable = bytes(c if 32 <= c < 127 else 32 for c in data).decode().lower()
    return signs + [f"phrase:{p}" for p in IMAGE_PHRASES if p in printable]


@F.pandas_udf(T.ArrayType(T.StringType()))
def image_findings(content: pd.Series) -> pd.Series:
    return content.map(lambda b: image_signs(bytes(b)) if b is not None else [])
