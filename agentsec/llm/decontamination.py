"""Operator 3, benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

DataFrame operations only. Words are the runs of letters and digits of the lower-cased text; a shingle is five of them
(all, in an item with fewer). For an item of L words, windows of L words slide over a document word by word; a
document of fewer words is one window.

1. Sieve. Similarity here is that of shingle multisets, the sum of smaller counts over the sum of larger ones, at
   least 0.75. As window and item have m shingles each, at least 6m/7 of the window's are the item's. Shingles of
   the documents meet those of the benchmark, and only windows with so many shingles of items of their length
   stay. A document shorter than the item has fewer shingles than the item's m, so there it is 3/7 of the sum of both
   counts. This is exact for every window and item.
2. SimHash. Each window and item gets 64 bits, each the majority of that bit in its shingle hashes.
3. Index. Bits are cut into 8 bytes. Two fingerprints within 23 bits differ by at most 2 bits in one byte, so
   items are filed under all 37 values within 2 bits of each byte, and windows look their 8 bytes up: all
   fingerprints within the radius are found. At similarity 0.75 the expected distance is 11, with deviation 3.
4. Exact similarity of each candidate on whole shingle multisets.

Result: (doc_id, item_id, similarity, start_word, n_words), the best window for each document and item.

Nulls: rows with a null id or text, and texts without words, give no rows; repeated rows give their match once.
Empty tables give no rows. At equal similarity the first window counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, materialize, table

SHINGLE, RADIUS, BLOCKS = 5, 23, 8
#: Every byte mask of at most RADIUS // BLOCKS bits.
MASKS = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(8), n)]


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, by position; empty if there are fewer."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def occurrences(hashes: Column) -> Column:
    """A multiset as a set: each hash with the number of times it has occurred so far. `hashes` must be sorted."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, (i + 1 - F.array_position(hashes, x)).cast("long")))


def fingerprints(windows: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` and `fp`: SimHash of the array column `hashes`, counted two bits at a time in 32-bit halves."""
    bit = F.explode("hashes")
    rows = windows.select(*keys, bit.alias("h"))
    pair = F.lit((1 << 32) | 1).cast("long")
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(pair)).alias(f"s{j}") for j in range(32)]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *sums)
    low = [F.when(F.col(f"s{j}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("m"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(32)]
    high = [F.when(F.shiftrightunsigned(f"s{j}", 32) * 2 > F.col("m"), F.lit(1 << (j + 32) if j < 31 else -(1 << 63))).otherwise(F.lit(0)) for j in range(32)]
    fp = F.lit(0).cast("long")
    for b in low + high:
        fp = fp.bitwiseOR(b.cast("long"))
    return counted.select(*keys, fp.alias("fp"))


def byte_of(fp: Column, block: Column) -> Column:
    # the shift is a column here, so it goes through SQL's function
    return F.call_function("shiftrightunsigned", fp, (block * 8).cast("int")).bitwiseAND(F.lit(255).cast("long")).cast("int")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words, k, hashes): items with words, k the shingle length."""
    words = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", word_hashes(F.col("text").cast("string")).alias("words")).distinct()
    items = words.filter(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(SHINGLE)))
    by_k = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        by_k = F.when(F.col("k") == k, shingle_hashes(F.col("words"), k)).otherwise(by_k)
    return items.select("item_id", F.size("words").alias("n_words"), "k", F.array_sort(by_k).alias("hashes"))


def candidate_starts(hits: DataFrame) -> DataFrame:
    """(doc_id, length, n_words, k, start): windows in which enough shingle places are hits for their length.

    That is 6/7 of the places; in a document of fewer words, one window, 3/7 of its places and the item's.
    """
    m = (F.col("n_words") - F.col("k") + 1).alias("m")
    short = F.col("length") < F.col("n_words")
    need = F.when(short, F.floor((3 * (F.col("length") - F.col("k") + 1 + F.col("m")) + 6) / 7)).otherwise(F.floor((6 * F.col("m") + 6) / 7)).cast("int").alias("need")
    runs = hits.groupBy("doc_id", "length", "n_words", "k").agg(F.array_sort(F.collect_set("pos")).alias("p")).select("*", m).select("*", need).filter(F.size("p") >= F.col("need"))
    spans = F.transform(F.sequence(F.lit(0), F.size("p") - F.col("need")), lambda i: F.struct(F.greatest(F.get("p", i + F.col("need") - 1) - F.col("m") + 1, F.lit(0)).alias("lo"), F.get("p", i).alias("hi")))
    spans = F.filter(spans, lambda s: s["lo"] <= s["hi"])
    starts = F.when(short, F.array(F.lit(0))).otherwise(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["lo"], s["hi"])))))
    return runs.select("doc_id", "length", "n_words", "k", F.explode(starts).alias("start"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words) of every document and item that match."""
    items = materialize(benchmark_items(benchmark), "items")
    known = items.select("n_words", "k", F.explode("hashes").alias("h")).distinct()
    n_known, n_items = known.count(), items.count()
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most 5
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    words = texts.select("doc_id", word_hashes(F.col("text")).alias("words"))

    hits = None
    for k in lengths:
        places = words.select("doc_id", F.size("words").alias("length"), F.posexplode(shingle_hashes(F.col("words"), k)).alias("pos", "h"))
        met = join_small(places, known.filter(F.col("k") == k), "h", "inner", n_known).select("doc_id", "length", "n_words", "k", "pos")
        hits = met if hits is None else hits.union(met)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start_word int, n_words int")

    starts = materialize(candidate_starts(hits).groupBy("doc_id").agg(F.collect_set(F.struct("length", "n_words", "k", "start")).alias("windows")), "windows")
    found = join_small(texts, starts, "doc_id", "inner", starts.count()).select("doc_id", "windows", word_hashes(F.col("text")).alias("words"))
    keys = ["doc_id", "length", "n_words", "start"]
    cut = None
    for k in lengths:
        arrays = found.select("doc_id", "windows", shingle_hashes(F.col("words"), k).alias("all"))
        one = arrays.select("doc_id", "all", F.explode(F.filter("windows", lambda w: w["k"] == k)).alias("w")).select("doc_id", "all", "w.*")
        one = one.filter((F.col("length") - k + 1 == F.size("all")) & (F.col("start") + F.least("length", "n_words") - k < F.size("all")))
        one = one.select(*keys, F.array_sort(F.slice("all", F.col("start") + 1, F.col("n_words") - k + 1)).alias("hashes"))
        cut = one if cut is None else cut.union(one)
    cut = materialize(cut.dropDuplicates([*keys, "hashes"]), "cut")

    ids = ["item_id", "n_words"]
    filed = fingerprints(items.select(*ids, "hashes"), ids).select(*ids, F.col("fp").alias("item_fp"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    filed = filed.select("*", byte_of(F.col("item_fp"), F.col("block")).alias("byte")).select(*ids, "item_fp", "block", F.explode(F.array(*[F.col("byte").bitwiseXOR(F.lit(m)) for m in MASKS])).alias("byte"))
    asked = fingerprints(cut, keys).select(*keys, "fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    asked = asked.select(*keys, "fp", "block", byte_of(F.col("fp"), F.col("block")).alias("byte"))
    near = join_small(asked, filed, ["n_words", "block", "byte"], "inner", n_items * BLOCKS * len(MASKS)).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = near.select(*keys, "item_id").distinct()

    sets = items.select("item_id", "n_words", occurrences(F.col("hashes")).alias("theirs"))
    ours = cut.select(*keys, occurrences(F.col("hashes")).alias("ours"))
    both = join_small(pairs.join(ours, keys), sets, ids, "inner", n_items)
    shared = F.size(F.array_intersect("ours", "theirs"))
    similarity = (shared / (F.size("ours") + F.size("theirs") - shared)).alias("similarity")
    kept = both.select(*keys, "item_id", similarity).filter(F.col("similarity") >= threshold)
    best = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.least("length", "n_words").alias("n_words"))).alias("b"))
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).alias("start_word"), "b.n_words")


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_simhash_decontamination": op3_simhash_decontamination}
