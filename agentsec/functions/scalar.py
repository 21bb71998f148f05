"""Scalar column functions: severity, redaction, normalising text and commands, packages, documents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import packs

INVISIBLE = "[​-‏ - ⁠-⁯﻿­]"
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
TAINT_LABELS = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "SECRET")


def severity_rank(severity: Column) -> Column:
    """CRITICAL 4, HIGH 3, MEDIUM 2, LOW 1, anything else 0."""
    out = F.lit(0)
    for rank, name in enumerate(SEVERITIES, 1):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def rank_severity(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for n, name in enumerate(SEVERITIES, 1):
        out = F.when(rank == n, name).otherwise(out)
    return out


def taint_label(level: Column) -> Column:
    out = F.lit("UNKNOWN")
    for n, name in enumerate(TAINT_LABELS):
        out = F.when(level == n, name).otherwise(out)
    return out


# --- redaction and formatting -------------------------------------------------------------------------------


def preview(text: Column, n: int = 20) -> Column:
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def mask_middle(text: Column) -> Column:
    """First four, ****, last four, if longer than 8; else ****."""
    return F.when(F.length(text) > 8, F.concat(F.substring(text, 1, 4), F.lit("****"), F.right(text, F.lit(4)))).otherwise(F.lit("****"))


def ellipsis_middle(text: Column) -> Column:
    """First four, ..., last four, if longer than 12; else [REDACTED]."""
    return F.when(F.length(text) > 12, F.concat(F.substring(text, 1, 4), F.lit("..."), F.right(text, F.lit(4)))).otherwise(F.lit("[REDACTED]"))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("...[truncated]"))).otherwise(F.coalesce(text, F.lit("")))


def duration_text(ms: Column) -> Column:
    """`250ms`, `12s`, `3m 5s`, `2h 10m`."""
    s = F.floor(ms / 1000)
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
    )


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("long")


def call_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars at 5 a million tokens in and 25 out."""
    return (tokens_in * 5 + tokens_out * 25) / F.lit(1_000_000.0)


# --- text ---------------------------------------------------------------------------------------------------


#: Letters and signs beyond ASCII that NFKC leaves as they are and never joins to what stands before them. Not all, but most of what texts hold.
STABLE = r"\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{400}-\x{482}\x{48A}-\x{52F}\x{5D0}-\x{5EA}\x{621}-\x{64A}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{20A9}-\x{20C0}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
UNSTABLE = rf"[[^\x00-\x7F]&&[^{STABLE}]]"
#: What NFKC may change, with the character before it; it changes each of these by itself.
PIECE = rf"[^\n]?{UNSTABLE}+"


@F.udf(T.StringType(), useArrow=False)  # rows go in batches of a hundred, where Arrow's hold ten thousand texts
def _nfkc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text)


def nfkc(text: Column) -> Column:
    """NFKC. Python gets only the pieces that may change, a line each."""
    unstable = text.rlike(UNSTABLE)
    pieces = F.split(_nfkc(F.when(unstable, F.array_join(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), "\n"))), "\n", -1)
    rest = F.split(text, PIECE, -1)
    changed = F.concat(F.get(rest, F.lit(0)), F.array_join(F.zip_with(pieces, F.slice(rest, F.lit(2), F.size(rest)), lambda p, r: F.concat(p, r)), ""))
    return F.when(unstable, changed).otherwise(text)


def normalise_unicode(text: Column) -> Column:
    """NFKC, look-alike letters to ASCII, invisible characters away. ASCII text never enters Python's part."""
    letters, plain = packs.HOMOGLYPHS
    folded = F.regexp_replace(F.translate(nfkc(text), letters, plain), INVISIBLE, "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def unicode_obfuscation(text: Column) -> Column:
    """Any Cyrillic, Greek, full-width or invisible character."""
    return text.rlike("[\u0400-\u04ff\u0370-\u03ff\uff00-\uffef]|" + INVISIBLE)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, bits a symbol; 0 for empty text."""
    chars, n = F.split(text, ""), F.length(text)
    share = F.transform(F.array_distinct(chars), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, -F.aggregate(share, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))).otherwise(F.lit(0.0))


def high_entropy_strings(text: Column, limit: int = 5) -> Column:
    """The first tokens of 32 or more characters, neither hex nor letters only, above 4.5 bits."""
    tokens = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9+/=_-]{32,})"), F.lit(1))
    return F.slice(F.filter(tokens, lambda t: ~t.rlike("^[0-9a-fA-F]+$") & ~t.rlike("^[A-Za-z]+$") & (entropy(t) > 4.5)), 1, limit)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def frontmatter(text: Column) -> Column:
    """(source, body): `source:` of a leading `---` fence, unquoted; without a fence the whole text is the body."""
    fence = r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)(.*)\z"
    has = text.rlike(fence)
    head = F.regexp_extract(text, fence, 1)
    source = F.regexp_replace(F.trim(F.regexp_extract(head, r"(?m)^source:[ \t]*(.+?)[ \t]*$", 1)), r"^[\"']|[\"']$", "")
    return F.struct(F.when(has & (source != ""), source).alias("source"), F.when(has, F.regexp_extract(text, fence, 2)).otherwise(text).alias("body"))


def sections(text: Column) -> Column:
    """array<struct<no, title, body, start_line>> of a Markdown text cut at `## ` lines; what comes first has no title. Bodies joined give the text."""
    parts = F.filter(F.split(text, r"(?m)(?=^## )"), lambda p: p != "")
    before = lambda i: F.length(F.array_join(F.slice(parts, 1, i), "")) - F.length(F.replace(F.array_join(F.slice(parts, 1, i), ""), F.lit("\n"), F.lit("")))
    return F.transform(
        parts,
        lambda p, i: F.struct(
            i.alias("no"),
            F.when(p.startswith("## "), F.trim(F.regexp_extract(p, r"\A## ([^\n]*)", 1))).alias("title"),
            p.alias("body"),
            (before(i) + 1).cast("int").alias("start_line"),
        ),
    )


def quarantine_stub(title: Column, rule_ids: Column, as_of: Column) -> Column:
    return F.concat(F.lit("## "), F.coalesce(title, F.lit("(preamble)")), F.lit("\n\n> Quarantined "), as_of.cast("string"), F.lit(". Rules: "), F.array_join(F.array_distinct(rule_ids), ", "), F.lit("\n"))


def parse_verdict(text: Column) -> Column:
    """(verdict, confidence, reason) of a classifier's JSON answer, code fence allowed; null if it isn't one."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    got = F.from_json(bare, "verdict string, confidence double, reason string")
    label = F.upper(got["verdict"])
    ok = label.isin("INSTRUCTION", "DESCRIPTION", "AMBIGUOUS") & got["confidence"].isNotNull()
    return F.when(ok, F.struct(label.alias("verdict"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), got["confidence"])).alias("confidence"), got["reason"].alias("reason")))


def verdict_action(verdict: Column, confidence: Column) -> Column:
    """Sure descriptions are skipped; sure instructions and all doubt are quarantined."""
    return F.when((verdict == "DESCRIPTION") & (confidence >= 0.70), F.lit("skip")).otherwise(F.lit("quarantine"))


# --- commands and packages ----------------------------------------------------------------------------------


#: What stands before a comment: anything but `#`, which may stand in quotes.
_CODE = r"""^((?:[^#'"]|'[^']*(?:'|$)|"[^"]*(?:"|$))*)"""


def normalise_command(cmd: Column) -> Column:
    """Comments outside quotes and blank lines away; lines joined by ` ; `."""
    lines = F.transform(F.split(cmd, "\n"), lambda s: F.trim(F.regexp_extract(s, _CODE, 1)))
    return F.array_join(F.filter(lines, lambda s: s != ""), " ; ")


def normalise_params(params: Column) -> Column:
    return F.transform_values(params, lambda _, v: normalise_unicode(v))


def sanitise_params(params: Column) -> Column:
    """Values of secret-like keys are masked; long `content` is cut."""
    secret = r"(?i)password|secret|token|key|credential|auth"
    return F.transform_values(params, lambda k, v: F.when(k.rlike(secret), F.lit("[REDACTED]")).when((k == "content") & (F.length(v) > 500), F.concat(F.substring(v, 1, 500), F.lit("...[truncated]"))).otherwise(v))


_CD = r"^\s*cd\s+(?:\"[^\"]*\"|'[^']*'|[^\s&;|]+)\s*&&\s*"


_ASSIGNMENTS = r"^\s*(?:[A-Za-z_][A-Za-z0-9_]*=(?:\"[^\"]*\"|'[^']*'|\S*)\s+)*"
_WRAPPER = r"^(?:sudo|time|nice|nohup)\s+(?:-\S+\s+)*"


def leading_command(cmd: Column) -> Column:
    """The program that runs first: without a `cd ... &&`, assignments, one wrapper and its path."""
    bare = F.regexp_replace(cmd, _CD, "")
    bare = F.regexp_replace(bare, _ASSIGNMENTS, "")
    bare = F.regexp_replace(bare, _WRAPPER, "")
    return F.element_at(F.split(F.regexp_extract(bare, r"^\s*(\S+)", 1), "/"), -1)


#: Commands that only show structure, and what may follow them in a pipe. Fixed values.
DIAGNOSTIC = "git gh jj ls find tree stat file du df pwd wc ps top htop pgrep uname hostname uptime whoami id groups env printenv history which whereis type command diff".split()
PIPE_ONLY = "grep rg ag head tail sort uniq awk sed cut tr xargs tee cat".split()


def diagnostic_command(cmd: Column) -> Column:
    """One `cd ... &&` at most, no other chain or substitution, a diagnostic head and only reshaping stages after it."""
    bare = F.regexp_replace(cmd, _CD, "")
    stages = F.transform(F.split(bare, r"\|"), leading_command)
    chained = bare.rlike(r"&&|\|\||;|`|\$\(|>|<|&\s*$|\n")
    return F.coalesce(F.when(F.trim(bare) == "", F.lit(False)).when(chained, F.lit(False)).otherwise(F.get(stages, F.lit(0)).isin(DIAGNOSTIC) & F.forall(stages, lambda s: s.isin(DIAGNOSTIC + PIPE_ONLY))), F.lit(False))


def evasion_warnings(cmd: Column) -> Column:
    named = cmd.rlike(r"\b(rm|chmod|chown|dd|mkfs|curl|wget|nc|ncat)\b")
    return F.array_compact(
        F.array(
            F.when(cmd.rlike(r"\$[{(]?[A-Za-z_]") & ~named & cmd.rlike(r"\$[A-Za-z_]+\s+(-rf|-r|--force|--no-preserve-root)"), F.lit("variable_with_destructive_flag")),
            F.when(cmd.rlike(r"\$'\\x[0-9a-fA-F]{2}") | cmd.rlike(r"\$'\\[0-7]{3}"), F.lit("escaped_characters")),
            F.when(cmd.rlike(r"base64\s+(-d|--decode)") & cmd.rlike(r"\|\s*(sh|bash|zsh|dash|eval)\b"), F.lit("base64_to_shell")),
            F.when(cmd.rlike(r"\beval\b") & cmd.rlike(r"\$"), F.lit("eval_of_variable")),
        )
    )


def credential_command(cmd: Column) -> Column:
    tools = (r"op\s+(read|run|get|item\s+get)", r"secretless-ai\s+env", r"aws\s+secretsmanager", r"vault\s+(read|kv\s+get)", r"gcloud\s+secrets\s+versions\s+access", r"az\s+keyvault\s+secret\s+show", r"kubectl\s+get\s+secret")
    return F.coalesce(cmd.rlike("|".join(rf"\b{t}\b" for t in tools)), F.lit(False))


def git_branch(cmd: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(cmd, r"(?:push|pull|checkout|merge|rebase)\s+(?:origin\s+)?(\S+)", 1), F.lit("")), F.lit("unknown"))


#: Package manager: (install verbs, ecosystem), first match wins. Fixed values.
PACKAGE_MANAGERS = {"npm": ("(?:install|i|add)", "npm"), "yarn": ("add", "npm"), "pnpm": ("(?:add|install|i)", "npm"), "pip": ("install", "pypi"), "cargo": ("(?:add|install)", "crates"), "go": ("(?:get|install)", "go"), "bun": ("(?:add|install|i)", "npm")}


def _installer(pm: str) -> str:
    return rf"(?i)\b{pm}{'3?' if pm == 'pip' else ''}\s+{PACKAGE_MANAGERS[pm][0]}\s+"


def package_manager(cmd: Column) -> Column:
    return F.coalesce(*[F.when(cmd.rlike(_installer(pm)), F.lit(pm)) for pm in PACKAGE_MANAGERS])


def package_ecosystem(pm: Column) -> Column:
    return F.coalesce(*[F.when(pm == name, F.lit(e)) for name, (_, e) in PACKAGE_MANAGERS.items()])


def install_packages(cmd: Column) -> Column:
    """Names an install command asks for: no flags, no @types, versions cut off."""
    args = F.coalesce(*[F.when(cmd.rlike(_installer(pm)), F.regexp_extract(cmd, _installer(pm) + "([^&|;]+)", 1)) for pm in PACKAGE_MANAGERS])
    names = F.filter(F.split(F.trim(args), r"\s+"), lambda a: (a != "") & ~a.startswith("-") & ~a.startswith("@types/"))
    return F.coalesce(F.transform(names, lambda a: F.lower(F.regexp_replace(a, r"(?<=.)(?:@|==|>=|<=|~=|!=|>|<).*$", ""))), F.array().cast("array<string>"))


def mcp_tool(name: Column) -> Column:
    """(server, method, service_type, is_write) of `mcp__server__method`; unknown servers are external."""
    parts = F.split(F.regexp_replace(name, "^mcp__", ""), "__")
    server, method = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "__"), F.element_at(parts, -1)
    is_write = F.lit(False)
    for s, (_, methods) in MCP_SERVERS.items():
        if methods:
            is_write = is_write | ((server == s) & method.isin(*methods))
    local = server.isin(*[s for s, (kind, _) in MCP_SERVERS.items() if kind == "local"])
    return F.when(name.startswith("mcp__") & (F.size(parts) >= 2), F.struct(server.alias("server"), method.alias("method"), F.when(local, F.lit("local")).otherwise(F.lit("external")).alias("service_type"), is_write.alias("is_write")))


#: Servers: kind and writing methods. Fixed values.
MCP_SERVERS = {
    "memory": ("local", ["create_entities", "create_relations", "add_observations", "delete_entities", "delete_observations", "delete_relations"]),
    "filesystem": ("local", ["write_file", "create_directory", "move_file"]),
    "playwright": ("local", ["browser_click", "browser_fill_form", "browser_type", "browser_navigate"]),
    "plugin_supabase_supabase": ("external", ["execute_sql", "apply_migration", "deploy_edge_function", "create_project", "create_branch"]),
    "plugin_context7_context7": ("external", []),
    "shadcn": ("external", []),
    "exa": ("external", []),
}


# --- paths --------------------------------------------------------------------------------------------------

#: Fixed values.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".sh": "shell", ".bash": "shell", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".java": "java", ".sql": "sql", ".yml": "yaml", ".yaml": "yaml"}
SKIP_SEGMENTS = ["hooks", "node_modules", "security", "tests", "test", "__tests__"]
SKIP_SUFFIXES = [".test.ts", ".test.js", ".spec.ts", ".spec.js"]


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)


def language(path: Column) -> Column:
    return F.coalesce(*[F.when(extension(path) == e, F.lit(name)) for e, name in LANGUAGES.items()], F.lit("unknown"))


def skipped_path(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIP_SEGMENTS]))
    for s in SKIP_SUFFIXES:
        out = out | path.endswith(s)
    return F.coalesce(out, F.lit(False))


def env_file(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(name.rlike(r"^\.env(\..+)?$") & ~name.rlike(r"\.(example|sample|template|1password)$"), F.lit(False))


def file_sensitivity(path: Column) -> Column:
    has = lambda *words: F.greatest(*[F.contains(path, F.lit(w)).cast("int") for w in words], F.lit(0)) == 1
    return F.when(has(".env", ".ssh", "credentials"), 3).when(has("security", "policies"), 2).when(has("hooks"), 1).otherwise(0)


#: (substring, level). Fixed values.
PATH_LABELS = [(".env", 3), ("credentials", 3), ("private_key", 3), (".ssh/", 3), ("security/", 1)]


def path_sensitivity(path: Column, labels: list[tuple[str, int]] = PATH_LABELS) -> Column:
    return F.greatest(F.lit(0), *[F.when(F.contains(path, F.lit(p)), F.lit(n)).otherwise(F.lit(0)) for p, n in labels])


def egress_payload(tool: Column, params: Column) -> Column:
    """(content, destination, bytes) that a tool call sends out."""
    destination = F.when(tool == "Bash", F.nullif(F.regexp_extract(F.try_element_at(params, F.lit("command")), r"(?:curl|wget)\s+(?:-\S+\s+)*[\"']?(https?://[^\s\"']+)", 1), F.lit(""))).otherwise(F.coalesce(F.try_element_at(params, F.lit("url")), F.try_element_at(params, F.lit("query"))))
    content = F.coalesce(F.when(tool == "Bash", F.try_element_at(params, F.lit("command"))).otherwise(F.to_json(params)), F.lit(""))
    return F.struct(content.alias("content"), destination.alias("destination"), F.octet_length(content).alias("bytes"))
