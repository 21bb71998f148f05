"""Rule packs to columns, and operations on rule tables.

A rule becomes `when(gate AND rlike, struct(...))`. The gate tests literals that every match must hold, read from
the pattern itself, on the lower-cased text; regexes then run on few rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage
from . import packs


class Rule(NamedTuple):
    id: str
    category: str
    severity: str
    flags: str
    pattern: str
    description: str = ""
    languages: tuple = ()

    @property
    def regex(self) -> str:
        """With inline flags. `$` means the very end, as in the language the rules come from, except under `m`."""
        pattern = self.pattern if "m" in self.flags else re.sub(r"(?<!\\)\$$", r"\\z", self.pattern)
        return (f"(?{self.flags})" if self.flags else "") + pattern


def pack(rows: Sequence[tuple]) -> list[Rule]:
    return [Rule(*r) for r in rows]


INJECTION, INJECTION_LIBRARY = pack(packs.INJECTION_BUNDLED), pack(packs.INJECTION_LIBRARY)
EGRESS_SECRET, EGRESS_PII, DESTINATIONS = pack(packs.EGRESS_SECRET), pack(packs.EGRESS_PII), pack(packs.DESTINATIONS)
PARAMETER_SECRET, SUBAGENT_DLP, OUTPUT, LINTER = pack(packs.PARAMETER_SECRET), pack(packs.SUBAGENT_DLP), pack(packs.OUTPUT), pack(packs.LINTER)
SKILL, MENTION = pack(packs.SKILL), pack(packs.MENTION)
OUTPUT = [r._replace(flags="i") for r in OUTPUT]


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case literals of which any match holds at least one; None where the pattern promises none.

    Of the choices the pattern leaves, the one whose shortest literal is longest. A single character serves only if it is
    rare in prose: no letter, digit, space, full stop or comma.
    """
    try:
        from re import _parser

        tree = _parser.parse(pattern)
    except (ImportError, re.error):
        return None

    def worth(option: list[str]) -> int:
        least = min(option, key=len)
        return len(least) if len(least) > 1 or least and not (least.isalnum() or least in " .,") else 0

    def of(items, run: str = "") -> list[str] | None:
        """`run`: literals that stand right before `items`."""
        options: list[list[str]] = []
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                run += chr(arg).lower()
                continue
            inner = None
            if name == "SUBPATTERN":
                inner = of(arg[3], run)
            elif name == "BRANCH":
                each = [of(x, run) for x in arg[1]]
                inner = [w for x in each for w in x] if all(each) else None
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                inner = of(arg[2], run)
            elif name == "ASSERT":
                inner = of(arg[1])
            options += [[run]] * bool(run) + [inner] * bool(inner)
            run = ""
        options += [[run]] * bool(run)
        options = [list(dict.fromkeys(o)) for o in options]
        options = [o for o in options if len(o) <= 12 and worth(o)]
        return max(options, key=worth, default=None)

    return of(tree)


def pinned(value: Column) -> Column:
    """`value`, computed once where its column is made.

    The optimizer copies a column's expression into every filter above it that it can push down, and scans are long expressions. A
    partition id counts as nondeterministic, so filters stay above. Filter a table's own columns before a scan, not after it.
    """
    return F.when(F.spark_partition_id() >= 0, value)


#: Bits of one mask column.
MASK_BITS = 63


def with_gate(df: DataFrame, text: Column, rules: Sequence[Rule], prefix: str = "_gate") -> tuple[DataFrame, Callable[[Rule], Column]]:
    """(`df` with mask columns, the gate of each rule): the text is folded once and each literal that some rule requires is looked for once.

    A bit of a mask says that the text holds a literal; a rule's gate reads bits only. The columns begin with `prefix`; drop them after use.
    """
    needed = {r: required_literals(r.pattern) for r in rules}
    words = sorted({w for ws in needed.values() for w in ws or ()})
    folded, masks = f"{prefix}_low", {}
    for k in range(0, len(words), MASK_BITS):
        mask = F.lit(0).cast("long")
        for bit, w in enumerate(words[k : k + MASK_BITS]):
            mask = mask + F.when(F.contains(F.col(folded), F.lit(w)), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
        masks[f"{prefix}{k // MASK_BITS}"] = pinned(mask)

    def passes(rule: Rule) -> Column:
        out, bits = F.lit(False), {}
        if needed[rule] is None:
            return F.lit(True)
        for w in needed[rule]:
            k = words.index(w)
            bits[k // MASK_BITS] = bits.get(k // MASK_BITS, 0) | 1 << k % MASK_BITS
        for k, mask in bits.items():
            out = out | (F.col(f"{prefix}{k}").bitwiseAND(F.lit(mask).cast("long")) != 0)
        return out

    return df.withColumn(folded, pinned(F.lower(text))).withColumns(masks), passes


def without_gate(df: DataFrame, prefix: str = "_gate") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def gate(rule: Rule, lower: Column) -> Column:
    words = required_literals(rule.pattern)
    out = F.lit(True)
    for k, w in enumerate(words or []):
        has = F.contains(lower, F.lit(w))
        out = has if k == 0 else out | has
    return out


def findings(text: Column, rules: Sequence[Rule], cut: int = 100, gated: bool = True, passes: Callable[[Rule], Column] | None = None) -> Column:
    """array<struct<rule_id, category, severity, match, pos>>, in rule order; one for each rule that matches.

    `passes`: gates of columns made by `with_gate`; without it each rule looks for its own literals.
    """
    lower = F.lower(text)
    passes = passes or ((lambda r: gate(r, lower)) if gated else (lambda r: F.lit(True)))
    one = [
        F.when(
            passes(r) & text.rlike(r.regex),
            F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.substring(F.regexp_extract(text, r.regex, 0), 1, cut).alias("match"), F.regexp_instr(text, F.lit(r.regex)).alias("pos")),
        )
        for r in rules
    ]
    return F.array_compact(F.array(*one))


def matches_any(text: Column, rules: Sequence[Rule], passes: Callable[[Rule], Column] | None = None) -> Column:
    lower, out = F.lower(text), F.lit(False)
    for r in rules:
        out = out | ((passes(r) if passes else gate(r, lower)) & text.rlike(r.regex))
    return F.coalesce(out, F.lit(False))


def first_match(text: Column, rules: Sequence[Rule], value: str = "id") -> Column:
    return F.coalesce(*[F.when(text.rlike(r.regex), F.lit(getattr(r, value))) for r in rules], F.lit(None).cast("string"))


# --- rule tables --------------------------------------------------------------------------------------------

SCHEMA = "id string, category string, severity string, flags string, pattern string, description string, tier string, place int"
#: Categories of injection rules. Fixed values.
CATEGORIES = ("instruction_override", "jailbreak", "encoding", "context_manipulation")


def rule_table(spark: SparkSession, rules: Sequence[Rule], tier: str | None = None) -> DataFrame:
    """`rules` as a table; `place` is a rule's place in the pack."""
    return spark.createDataFrame([(r.id, r.category, r.severity, r.flags, r.pattern, r.description, tier, k) for k, r in enumerate(rules)], SCHEMA)


def valid_rules(rules: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Without rules that have no id or pattern, an unknown severity or category (none is fine), a quantifier right upon a quantified group, or a pattern that doesn't compile."""
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    ok = ~absent("id") & ~absent("pattern") & (absent("severity") | F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM", "LOW"))
    if categories:
        ok = ok & (absent("category") | F.col("category").isin(*categories))
    nested = F.col("pattern").rlike(r"[+*{]\)[+*{]|[+*]\{")
    rules = rules.filter(ok & ~nested)
    # Control data: each pattern is tried once, on the driver, by the engine that will run it.
    patterns = [r["pattern"] for r in rules.select("pattern").distinct().limit(MAX_RULES + 1).collect()]
    if len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    bad = [p for p in patterns if not compiles(rules.sparkSession, p)]
    return rules.filter(~F.col("pattern").isin(bad)) if bad else rules


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM's regular expressions, which scans use, accept a pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def in_tier(rules: DataFrame, active: str = "plugin") -> DataFrame:
    """`full` keeps all; `plugin` keeps rules without a tier, of that tier or of an unknown one."""
    tier = F.coalesce(F.lower(F.trim("tier")), F.lit("plugin"))
    return rules if active == "full" else rules.filter(tier != "full")


def first_wins(*sources: DataFrame, place: str = "place") -> DataFrame:
    """Rules in order of source and `place`; one is skipped if its id or its pattern was accepted before it, in that order.

    A skipped rule registers nothing. In rounds: of the undecided rules, those first of their id and first of their pattern are accepted, as
    nothing that may still come can precede them; then the others of those ids and patterns are skipped. The first undecided rule is always accepted,
    and rounds are as many as the longest chain of rules each of which hangs on the one before. Rules without an id or a pattern are left out.
    """
    table = None
    for k, s in enumerate(sources):
        one = s.withColumns({"_o": F.struct(F.lit(k).alias("source"), F.col(place).alias("place"), F.col("id").alias("id"), F.col("pattern").alias("pattern"))})
        table = one if table is None else table.unionByName(one, allowMissingColumns=True)
    names = [c for c in table.columns if c != "_o"]
    undecided, accepted = cut_lineage(table.filter("id IS NOT NULL AND pattern IS NOT NULL")), []
    while undecided.limit(1).count():
        by_id, by_pattern = (F.min("_o").over(Window.partitionBy(c)) for c in ("id", "pattern"))
        won = cut_lineage(undecided.withColumns({"_i": by_id, "_p": by_pattern}).filter("_o = _i AND _o = _p").drop("_i", "_p").dropDuplicates(["id"]))
        accepted.append(won)
        undecided = cut_lineage(undecided.join(won.select("id"), "id", "left_anti").join(won.select("pattern"), "pattern", "left_anti"))
    out = reduce(DataFrame.unionByName, accepted) if accepted else table
    return out.orderBy("_o").select(*names)


def with_fallback(external: DataFrame, bundled: DataFrame) -> DataFrame:
    """External rules, and the bundled ones whose id isn't overridden."""
    return external.unionByName(bundled.join(external.select("id"), "id", "left_anti"), allowMissingColumns=True)


def active_injections(spark: SparkSession, manual: DataFrame | None = None, further: Sequence[DataFrame] = (), active: str = "plugin") -> DataFrame:
    """The injection rules in use: manual ones (else the default pack), further tables and the translated pack of the active tier, valid ones, first wins; then the bundled rules whose id is none of theirs."""
    own = rule_table(spark, pack(packs.INJECTION_DEFAULT)) if manual is None else manual
    translated = rule_table(spark, pack(packs.INJECTION_TRANSLATED), "full")
    merged = first_wins(valid_rules(own, CATEGORIES), *[in_tier(valid_rules(t, CATEGORIES), active) for t in (*further, translated)])
    return with_fallback(merged, rule_table(spark, INJECTION))


def memory_rules(external: Sequence[Rule] | None = None) -> list[Rule]:
    """The given pack, or else the fallback; persistence rules always; those that don't compile are dropped."""
    out = []
    for r in [*(external or pack(packs.MEMORY_FALLBACK)), *pack(packs.MEMORY_PERSISTENT)]:
        try:
            re.compile(r.pattern)
        except re.error:
            continue
        out.append(r._replace(flags="".join(sorted(set(r.flags) | {"i"}))))
    return out


def rule_diff(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """(id, change): rules that are `new`, and `changed` ones; nothing is ever deleted."""
    new = candidate.join(current.select("id"), "id", "left_anti").select("id", F.lit("new").alias("change"))
    fields = ["id", "category", "severity", "pattern"]
    changed = candidate.select(*fields).exceptAll(current.select(*fields)).join(current.select("id"), "id", "left_semi").select("id", F.lit("changed").alias("change"))
    return new.union(changed)


def malicious(packages: DataFrame, spark: SparkSession) -> DataFrame:
    """Packages (ecosystem, package) known as malicious, in lower case, with the reason."""
    known = spark.createDataFrame(packs.MALICIOUS_REASONS, "ecosystem string, package string, reason string")  # ten rows
    return packages.withColumn("package", F.lower("package")).join(F.broadcast(known), ["ecosystem", "package"])


def package_blocklist(spark: SparkSession, configured: DataFrame | None = None) -> DataFrame:
    """(package): hard-coded names and configured ones, in lower case, once."""
    base = spark.createDataFrame([(p,) for p in packs.MALICIOUS_PACKAGES], "package string")
    both = base if configured is None else base.union(configured.select("package"))
    return both.select(F.lower("package").alias("package")).distinct()


# --- literal index ------------------------------------------------------------------------------------------

#: Rules of a table that may be read to the driver to build an index; a rule is a line of control data.
MAX_RULES = 100_000
#: Characters of a literal that texts and rules meet on.
GRAM = 3
#: Letters in rough order of frequency in prose; a literal's gram of the rarest characters is the one indexed. Only speed depends on it.
_COMMON = " etaoinsrhldcumfpgwybvkxjqz"


def rare_gram(literal: str, size: int = GRAM) -> tuple[str, int]:
    """(gram, its place in the literal): the one whose most common character is rarest."""
    rank = lambda c: _COMMON.index(c) if c in _COMMON else len(_COMMON)
    return max(((literal[k : k + size], k) for k in range(len(literal) - size + 1)), key=lambda g: (min(map(rank, g[0])), sum(map(rank, g[0])), -g[1]))


def literal_index(rules: Sequence[Rule]) -> tuple[list[tuple[str, str, int]], list[int]]:
    """([(gram, literal, rule)], [rules without a long enough literal]): an inverted index of the literals that each rule requires."""
    filed, rest = [], []
    for k, r in enumerate(rules):
        words = required_literals(r.pattern)
        if not words or min(map(len, words)) < GRAM:
            rest.append(k)
        else:
            filed += [(rare_gram(w)[0], w, k) for w in words]
    return filed, rest


def scan_table(docs: DataFrame, text: str, rules: DataFrame, keys: Sequence[str], cut: int = 100) -> DataFrame:
    """(keys, rule_id, category, severity, match): findings of a whole rule table (as `rule_table`), of any number of rules.

    Each text is folded once and its distinct grams that the index knows are listed; texts meet rules by an equality join on the gram,
    then must hold the literal, and only then is the pattern tried. So work grows with the literals a text holds, not with texts times
    rules, and the plan's size doesn't grow with the rules. Rules that promise no literal are tried on every text as fixed patterns. The table
    is control data: it is read to the driver to take its patterns apart, and refused beyond MAX_RULES.
    """
    rows = rules.select("id", "category", "severity", F.coalesce("flags", F.lit("")).alias("flags"), "pattern").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    listed = [Rule(*r) for r in rows]
    filed, rest = literal_index(listed)
    out_columns = [*keys, "rule_id", "category", "severity", "match"]
    content = F.col("_text")
    texts = docs.select(*keys, F.col(text).alias("_text")).filter("_text IS NOT NULL")
    spark, parts = docs.sparkSession, []
    if filed:
        known = sorted({g for g, _, _ in filed})
        index = spark.createDataFrame([(g, w, listed[k].id, listed[k].category, listed[k].severity, listed[k].regex) for g, w, k in filed], "_gram string, _literal string, rule_id string, category string, severity string, _regex string")
        folded = texts.withColumn("_low", pinned(F.lower("_text")))
        # An empty match at each character, with what stands there: one pass, where cutting at each place would walk the text again for each.
        grams = F.regexp_extract_all("_low", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
        met = folded.withColumn("_gram", F.explode_outer(pinned(F.array_distinct(F.filter(grams, lambda g: g.isin(known))))))
        # The index is bounded by MAX_RULES lines, so it may be sent to every task.
        hits = met.join(F.broadcast(index), "_gram").filter(F.contains("_low", F.col("_literal")) & F.expr("_text rlike _regex"))
        found = hits.select(*keys, "rule_id", "category", "severity", F.substring(F.expr("regexp_extract(_text, _regex, 0)"), 1, cut).alias("match"), F.xxhash64("_text", "_regex").alias("_one"))
        parts.append(found.dropDuplicates([*keys, "rule_id", "_one"]).select(*out_columns) if len(filed) > len({k for _, _, k in filed}) else found.select(*out_columns))
    if rest:
        one = texts.withColumn("f", F.explode_outer(pinned(findings(content, [listed[k] for k in rest], cut)))).filter("f IS NOT NULL")
        parts.append(one.select(*keys, "f.rule_id", "f.category", "f.severity", "f.match"))
    if not parts:
        return texts.select(*keys, *[F.lit("").alias(c) for c in out_columns[len(keys) :]]).limit(0)
    return reduce(DataFrame.union, parts)


def back_test(docs: DataFrame, labels: DataFrame, rules: Sequence[Rule], positive: Column) -> DataFrame:
    """(rule_id, hits, labelled, precision): each rule over a corpus, against labels where there are any."""
    hits = docs.select("doc_id", F.explode(findings(F.col("text"), rules)).alias("f")).select("doc_id", F.col("f.rule_id").alias("rule_id"))
    y = labels.select("doc_id", positive.cast("int").alias("y"))
    return hits.join(y, "doc_id", "left").groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.count("y").alias("labelled"), F.avg("y").alias("precision"))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
