"""Operator 7, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word between, hashed into 2^20
slots, after A-Z are lower-cased and ASCII punctuation is cut off. FTRL-proximal has a learning rate for each
coordinate and an L1 term, so few weights stay; those go to the executors inside the scoring function.

The model is fitted on a bounded sample: at most SAMPLE_ROWS labelled training rows, lowest id hash first
(one task holds their feature slots). Every text is scored whole.

Nulls: a null or empty text is scored by the bias alone; a row with a null id is scored too and isn't held out; null
labels don't train; for a doc_id labelled twice the higher label counts. Without rows of both labels the score
is the mean label (0.5 without any). Repeated rows are scored alike. Texts of any length are
scored whole. Other columns pass through; those called score or predicted are kept as score_in and predicted_in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .words import PLAIN, hashed, mix

BITS, SAMPLE_ROWS, EPOCHS, THRESHOLD = 20, 20_000, 5, 0.7
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.5
#: Rows of the rarer label 1 weigh this much in training.
POSITIVE_WEIGHT = 3.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def feature_slots(texts: pa.Array) -> Iterator[np.ndarray]:
    """Slots of the words, neighbours and skip-pairs of each text, with repeats."""
    for h, at in hashed(texts, PLAIN):
        single = (mix(h, 11) >> np.uint64(64 - BITS)).astype(np.int64)
        pairs = [(mix(mix(h[:-gap], 20 + gap) + h[gap:], 30 + gap) >> np.uint64(64 - BITS)).astype(np.int64) for gap in (1, 2)]
        for lo, hi in zip(at[:-1], at[1:]):
            yield np.concatenate([single[lo:hi], *(p[lo : max(lo, hi - gap)] for gap, p in enumerate(pairs, 1))])


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, slots, weights) by FTRL-proximal; the bias has no L1 term."""
    size = 1 << BITS
    z, n, zb, nb = np.zeros(size), np.zeros(size), 0.0, 0.0

    def weight(z_: np.ndarray, n_: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z_) <= L1, 0.0, -(z_ - np.sign(z_) * L1) / ((BETA + np.sqrt(n_)) / ALPHA + L2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            slots, y = rows[k]
            w, n_old = weight(z[slots], n[slots]), n[slots]
            wb = -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y) * (POSITIVE_WEIGHT if y else 1.0)
            n[slots] = n_old + g * g
            z[slots] += g - (np.sqrt(n_old + g * g) - np.sqrt(n_old)) / ALPHA * w
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * wb
            nb += g * g
    w = weight(z, n)
    at = np.flatnonzero(w)
    return -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2), at, w[at]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """Model from the labelled rows that aren't held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).filter(~held_out(F.col("doc_id")))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.unique(s).astype("<u4").tobytes() for s in feature_slots(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.binary()), batch.column(2)], names=["doc_id", "slots", "y"])

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(np.frombuffer(s, "<u4").astype(np.int64), int(y)) for f in frames for s, y in zip(f["slots"], f["y"])]
        mean = sum(y for _, y in rows) / len(rows) if rows else 0.5
        if 0 < mean < 1:
            bias, at, w = ftrl(rows)
        else:
            bias, at, w = float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), np.empty(0, int), np.empty(0)
        yield pd.DataFrame({"slot": np.append(at, -1), "w": np.append(w, bias)})

    # the sample has at most `sample_rows` rows of two numbers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = map_arrow(texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y"), features, "doc_id long, slots binary, y int")
    model = rows.repartition(1).sortWithinPartitions("doc_id", "slots").mapInPandas(train, "slot long, w double").toPandas()  # at most 2^BITS rows
    bias = float(model.loc[model["slot"] < 0, "w"].iloc[0]) if (model["slot"] < 0).any() else 0.0
    model = model[model["slot"] >= 0]
    return bias, model["slot"].to_numpy(np.int64), model["w"].to_numpy()


def scorer(model: tuple[float, np.ndarray, np.ndarray]):
    """Pandas UDF text -> probability of label 1."""
    bias, at, w = model

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.zeros(1 << BITS)
        weights[at] = w
        for batch in texts:
            column = pa.array([None if t is None else t.encode(errors="surrogatepass") for t in batch], pa.binary())
            out = np.array([bias + weights[np.unique(s[weights[s] != 0])].sum() for s in feature_slots(column)], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, train_docs: DataFrame | None = None) -> DataFrame:
    """`docs` with `score` and `predicted`; train_docs: where the labelled texts are, if not in `docs`."""
    score = scorer(fit(docs if train_docs is None else train_docs, labels, sample_rows))
    docs = docs.withColumnsRenamed({c: f"{c}_in" for c in ("score", "predicted")})
    return docs.withColumn("score", score(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op7_ftrl_toxicity": op7_ftrl_toxicity}
