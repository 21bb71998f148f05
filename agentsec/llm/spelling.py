"""Operator 11, spelling variants: words one edit apart by a relational trie frontier, and the form each goes by.

All words make two tries, of the words as they are and reversed. A trie is a table: a row a node, with its edges (character,
child, the characters that follow the child, whether a word ends there). A node's id is a hash of its prefix. The frontier is a
table of states (word, target, node, edits) and moves down one level a step by a join with the nodes of that depth:
without an edit it follows its own word and branches into every other character, as a replacement or as an insertion; with one it
follows its target. Deletions are the insertions seen from the other word. A state whose target ends at a word's node
is a pair of near words.

Of two near words, either the first half of the shorter is untouched or the second. So a state starts in the
middle of its word, in one trie for edits behind the middle, in the other for those before it, where nodes have few
edges; a node holds at most one edge for each letter, so no join makes more rows than states times letters. Ids
that collide can only add targets, which the last join with the words drops. Words over LONGEST characters would need a level a character: they
meet on hashes of their halves instead and are compared exactly; only long words with the same half and length meet.

Nulls: a null text has no words; a null id counts as the empty string. Texts may be of any length, and repeated rows count each time.
Ties: of the near words of largest n the smallest in code-point order is the form. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, table, text_or_empty

MIN_LENGTH, MIN_COUNT, DAMAGE = 5, 3, 97
#: Words up to this length go through the tries.
LONGEST = 40
UPPER = "".join(map(chr, range(65, 91)))


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, one_in: int = DAMAGE) -> DataFrame:
    """(word): runs of letters, A-Z in lower case; a run whose id hash `one_in` divides has lost one letter."""
    runs = F.regexp_extract_all(text_or_empty(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    rows = rows.select("_id", F.when(F.col("_run").rlike("[A-Z]"), F.translate("_run", UPPER, UPPER.lower())).otherwise(F.col("_run")).alias("_run"))
    rows = rows.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    words = rows.select(F.when(F.col("_h") % one_in == 0, cut).otherwise(F.col("_run")).alias("word"))
    return words.filter(F.length("word") >= min_length)


def _written(df: DataFrame, name: str, by: str) -> str:
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(by).parquet(path)
    return path


def _node(way: Column, prefix: Column) -> Column:
    return F.xxhash64(way, prefix)


def trie_nodes(strings: DataFrame) -> DataFrame:
    """(depth, node, edges): the nodes of depth >= (length - 1) // 2 on the way of each string (way, s)."""
    n = F.length("s")
    rows = strings.select("way", "s", F.explode(F.sequence(((n - 1) / 2).cast("int"), n - 1)).alias("depth"))
    char = lambda k: F.substring("s", k, F.lit(1))
    rows = rows.select(
        "depth",
        _node(F.col("way"), F.substring("s", F.lit(1), F.col("depth"))).alias("node"),
        char(F.col("depth") + 1).alias("ch"),
        _node(F.col("way"), F.substring("s", F.lit(1), F.col("depth") + 1)).alias("child"),
        char(F.col("depth") + 2).alias("next"),
    )
    edges = rows.repartition("node").groupBy("depth", "node", "ch", "child").agg(F.array_join(F.collect_set("next"), "").alias("out"), F.max(F.col("next") == "").alias("ends"))
    return edges.groupBy("depth", "node").agg(F.collect_list(F.struct("ch", "child", "out", "ends")).alias("edges"))


def advance(states: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """The states (way, s, target, node, edits) one level on; `done` where a target ends at a word."""
    t = F.lit(depth)
    at = lambda k: F.substring("target", t + k, F.lit(1))
    rows = states.join(nodes, "node").withColumns({"c0": at(1), "c1": at(2)}).select("way", "s", "target", "edits", "c0", "c1", F.explode("edges").alias("e"))
    leads = lambda c: F.when(c == "", F.col("e.ends")).otherwise(F.instr(F.col("e.out"), c) > 0)
    same, fresh = F.col("e.ch") == F.col("c0"), F.col("edits") == 0
    # An own path always leads on; at its end it can only take one letter more.
    follows = same & (fresh | leads(F.col("c1")))
    replaces = fresh & ~same & (F.col("c0") != "") & leads(F.col("c1"))
    inserts = fresh & ~same & leads(F.col("c0"))
    rows = rows.select("*", follows.alias("f"), replaces.alias("r"), inserts.alias("i")).filter("f OR r OR i")
    head, ch = F.substring("target", F.lit(1), t), F.col("e.ch")
    tail = lambda k: F.substring("target", t + k, F.length("target"))
    move = lambda flag, target, edits: F.when(F.col(flag), F.struct(target.alias("target"), edits.cast("int").alias("edits")))
    moves = F.array(move("f", F.col("target"), F.col("edits")), move("r", F.concat(head, ch, tail(2)), F.lit(1)), move("i", F.concat(head, ch, tail(1)), F.lit(1)))
    rows = rows.select("way", "s", F.col("e.child").alias("node"), F.explode(moves).alias("m")).filter("m IS NOT NULL")
    return rows.select("way", "s", "m.target", "node", "m.edits", ((F.col("m.edits") == 1) & (F.length("m.target") == t + 1)).alias("done"))


def frontier_pairs(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(a, b): words of at most `longest` characters and the strings one replacement or insertion away that may be words."""
    spark = words.sparkSession
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("s")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("s")))).alias("x")
    strings = words.filter(F.length("word") <= longest + 1).select(ways).select("x.*")
    trie = _written(trie_nodes(strings), "trie", "depth")
    half = (F.length("s") / 2).cast("int")
    starts = strings.filter(F.length("s") <= longest).withColumn("start", F.when(F.col("way") == 0, half).otherwise(F.length("s") - half))
    begin = _written(starts, "starts", "start")
    nodes = spark.read.schema("node long, edges array<struct<ch: string, child: long, out: string, ends: boolean>>, depth int").parquet(trie)
    entering = spark.read.schema("way int, s string, start int").parquet(begin)
    bounds = entering.agg(F.min("start"), F.max(F.length("s"))).first()
    schema = "way int, s string, target string, node long, edits int, done boolean"
    paths, frontier = [], spark.createDataFrame([], schema)
    for depth in range(bounds[0] or 0, (bounds[1] or -1) + 1):
        new = entering.filter(F.col("start") == depth)
        new = new.select("way", "s", F.col("s").alias("target"), _node(F.col("way"), F.substring("s", F.lit(1), F.lit(depth))).alias("node"), F.lit(0).alias("edits"))
        states = new.union(frontier.filter("NOT done").select(new.columns))
        paths.append(new_path(spark, "frontier"))
        advance(states, nodes.filter(F.col("depth") == depth).select("node", "edges"), depth).write.parquet(paths[-1])
        frontier = spark.read.schema(schema).parquet(paths[-1])
    if not paths:
        return spark.createDataFrame([], "a string, b string")
    turned = lambda c: F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c))
    return spark.read.schema(schema).parquet(*paths).filter("done").select(turned("s").alias("a"), turned("target").alias("b"))


def long_pairs(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(a, b) near words, a the shorter and of more than `longest` characters: the half without the edit is equal."""
    n = F.length("word")
    rows = words.filter(n > longest).select("word", F.explode(F.array(F.lit(0), F.lit(1))).alias("more"))
    rows = rows.withColumn("m", F.length("word") - F.col("more")).filter(F.col("m") > longest).withColumn("h", (F.col("m") / 2).cast("int"))
    rest = F.col("m") - F.col("h")
    sides = F.array(F.xxhash64(F.lit(0), F.substring("word", F.lit(1), F.col("h"))), F.xxhash64(F.lit(1), F.substring("word", -rest, rest)))
    keyed = rows.select("word", "more", "m", F.explode(sides).alias("k"))
    a = keyed.filter("more = 0").select(F.col("word").alias("a"), "m", "k")
    b = keyed.select(F.col("word").alias("b"), "m", "k", "more")
    near = (F.col("more") == 1) | (F.col("a") < F.col("b"))
    return a.join(b, ["m", "k"]).filter(near & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")


def near_words(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, near, near_n) for every two words of `counts` (word, n) that differ by one inserted, deleted or replaced character."""
    pairs = frontier_pairs(counts, longest).union(long_pairs(counts, longest))
    pairs = materialize(pairs.union(pairs.select("b", "a")).distinct(), "near")
    # Targets that no word ends at (colliding ids) have no count; their mirror images fall with the words' own rows in `variants`.
    return pairs.join(counts.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b").select(F.col("a").alias("word"), F.col("b").alias("near"), "near_n")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of `forms` (word, form): where following forms ends. Pointers double their reach each round."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        there = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        step = materialize(roots.join(there, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "roots")
        roots = step.select("word", "root")
        if not step.filter("_moved").limit(1).count():
            return roots


def variants(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of `counts` (word, n)."""
    near = near_words(counts, longest)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    rows = counts.join(best, "word", "left").withColumn("_n", -F.col("best.less"))
    has = F.col("_n") >= 2 * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("_n")).alias("form_n")), "forms")
    roots = roots_of(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def word_counts(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    return materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count), "words")


def op11_trie_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(damaged_words(table(spark, sf_dir, "documents"))))


QUERIES = {"op11_trie_spelling": op11_trie_spelling}
