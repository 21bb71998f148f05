"""Operator 13, quality rules: a ledger of failure bits. DataFrame functions only.

`ledger` evaluates every rule once and keeps a row per document: what was measured, and `failed`, a bit mask with
bit k set where rule k of RULES fails. A policy is a versioned set of rules, so a mask: `apply_policy` keeps the
documents with `failed & mask = 0` and never looks at texts again. `ablation` says from the masks alone what each
rule of a policy removes, alone and with others: documents are counted by `failed & mask` first, at most one
row for each mask, and the rest is bit arithmetic on those.

Repeated windows are found inside a document: 64-bit hashes of its 8-word windows tell if any comes twice, only such
documents sort their windows by hash, and windows of one hash are compared word by word.

Nulls: a null text has no words and fails `few_words`; a null id is kept. A text of any length is one row's arrays.
Repeated rows are judged alike, each for itself; a result depends on one text alone, so there are no ties. An empty table gives an
empty ledger. `ledger` returns the id and its own columns only, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters"]
#: (name, condition of failure over MEASURES). A rule's bit is its place, for good: new rules go to the end.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("few_letters", "100 * n_letters < 60 * word_chars"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Version -> its rules. A version's rules never change: a new choice is a new version.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "short_words", "long_words", "few_letters"),
}
CURRENT = 2


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(BITS[r] for r in set(rules))


def _covered(windows: Column, words: Column) -> Column:
    """Words in windows whose content stands at another place too; `windows`: (hash, place) in that order."""
    content = lambda place: F.slice(words, place.cast("int") + 1, WINDOW)

    def twin(one: Column, k: Column) -> Column:
        same = lambda other: F.when(other["h"] == one["h"], content(other["p"]) == content(one["p"])).otherwise(F.lit(False))
        return same(F.get(windows, k - 1)) | same(F.get(windows, k + 1))

    places = F.sort_array(F.transform(F.filter(windows, twin), lambda one: one["p"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES): what the rules need to know of each text."""
    space = r"[\x20\x09-\x0D]+"
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_trim", F.trim(F.col("_text"), F.lit(SPACES)))
    rows = rows.select(
        "_id",
        F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", space)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("_lines"),
        F.regexp_count("_text", F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", r"\P{L}+", "")).cast("long").alias("n_letters"),
    )
    n = F.size("_words")
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # hashes of 2, 4, then WINDOW words, each of two halves
        rows = rows.withColumn("_hashes", F.zip_with("_hashes", F.slice("_hashes", step + 1, F.size("_hashes")), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("_hashes", F.slice("_hashes", 1, F.greatest(n - WINDOW + 1, F.lit(0))))
    windows = F.transform("_hashes", lambda h, k: F.struct(h.alias("h"), k.cast("long").alias("p")))
    rows = rows.select("*", F.when(F.size("_hashes") > F.size(F.array_distinct("_hashes")), F.sort_array(windows)).alias("_sorted"))
    return rows.select(
        F.col("_id").alias(id_col),
        n.cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_sorted"), F.col("_words")), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_letters",
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES, failed): bit k of `failed` is set where rule k of RULES fails."""
    bits = [F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long") for name, condition in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs, id_col, text_col).withColumn("failed", failed)


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with `policy`, `kept` and `sole_rule`: the rule without which a rejected row would be kept, if there is one."""
    mask = mask_of(POLICIES[version])
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    sole = F.coalesce(*[F.when(hit == BITS[name], F.lit(name)) for name in POLICIES[version]])
    return rows.withColumns({"policy": F.lit(version), "kept": hit == 0, "sole_rule": sole})


def ablation(rows: DataFrame, version: int = CURRENT, by: list[str] | None = None) -> DataFrame:
    """(by, rule, n_failed, n_sole, n_kept, n_kept_without) for each rule of a policy, in each group of `by`.

    n_failed: rows that fail the rule; n_sole: those that fail no other rule of the policy, so n_kept_without = n_kept + n_sole.
    """
    by, mask = by or [], mask_of(POLICIES[version])
    masks = rows.groupBy(*by, F.col("failed").bitwiseAND(F.lit(mask)).alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit")) for name in POLICIES[version]])).alias("_r")
    each = masks.select(*by, "_m", "_n", rules).select(*by, "_m", "_n", "_r.*")
    n = lambda condition: F.sum(F.when(condition, F.col("_n")).otherwise(0))
    out = each.groupBy(*by, "rule").agg(n(F.col("_m").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), n(F.col("_m") == F.col("bit")).alias("n_sole"), n(F.col("_m") == 0).alias("n_kept"))
    return out.withColumn("n_kept_without", F.col("n_kept") + F.col("n_sole"))


def op13_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[1]))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "n_letters", "failed", "policy", "sole_rule")


QUERIES = {"op13_quality_ledger": op13_quality_ledger}
