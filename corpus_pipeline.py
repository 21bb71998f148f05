"""A training corpus from `documents`: toxic documents go, near copies go but one, benchmark leaks go, personal data
is masked, and what is left is packed into sequences.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all its predecessor kept. All but the last return the
columns of documents that the input has; the last returns the packed pieces. Stages decide about rows, not ids: rows that repeat a doc_id
with another text are judged each by its own text. Rows that repeat a doc_id and its text are one document. Rows with a
null doc_id pass the stages that compare documents; a null text is kept as it is and packs as an empty document. Columns
beyond those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentsec.llm import decontamination, jaccard_join, packing, pii, toxicity
from agentsec.llm.common import bound_batches, join_small, materialize, row_keys, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def columns_of(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """`docs` whose _key isn't among `keys`."""
    keys = materialize(keys.select("_key").distinct(), "dropped")
    return join_small(docs, keys, "_key", "left_anti", keys.count())


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, rejects go."""
    bound_batches(spark)
    docs = docs.select(*columns_of(docs))
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest doc_id of each group of linked texts stays, once."""
    bound_batches(spark)
    columns = columns_of(docs)
    keyed, repeated = row_keys(docs.select(*columns))
    groups = materialize(jaccard_join.link_texts(keyed.select(F.col("_key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_key"), "groups")
    if repeated:  # a key that isn't its doc_id doesn't tell who is smallest
        ids = materialize(keyed.filter("_key IS NOT NULL").select("_key", "doc_id").distinct(), "ids")
        ranked = groups.join(ids, "_key")
        first = ranked.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first"))
        gone = ranked.join(first, "component_id").filter(F.col("_key") != F.col("first._key"))
    else:
        gone = groups.filter("component_id <> _key")
    rest = without(keyed, gone)
    if not groups.groupBy("_key").count().filter("count > 1 AND _key IS NOT NULL").limit(1).count():
        return rest.select(*columns)
    others = [c for c in columns if c not in ("doc_id", "text")]
    one = F.min(F.struct("doc_id", *others)).alias("one")
    once = rest.filter("_key IS NOT NULL").groupBy("_key", "text").agg(one).select("text", "one.*")
    return once.select(*columns).union(rest.filter("_key IS NULL").select(*columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    bound_batches(spark)
    columns = columns_of(docs)
    keyed, _ = row_keys(docs.select(*columns))
    found = decontamination.contaminated(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(keyed, found.withColumnRenamed("doc_id", "_key")).select(*columns)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text."""
    bound_batches(spark)
    docs = docs.select(*columns_of(docs))
    masked = pii.mask_documents(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 ids."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("pii", mask_private),
    ("packing", pack_sequences),
]

#: Tokenizing, the classifiers and the fingerprints aren't expressible in SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
