"""Operator 2, sharding: jump consistent hashing.

A stable 64-bit key and the shard count alone decide a row's shard; no ring table is kept, and one more shard
takes 1/(n+1) of the rows, all into itself. Slots number a shard's rows without gaps.

Nulls: a null key hashes as the empty string; a null text has no bytes. Repeated rows all stay, each with its
own slot. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, table, text_or_empty

SHARDS = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of many 64-bit keys at once."""
    key = keys.astype(np.uint64)
    shard, jump = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump[live] = ((shard[live] + 1) * step).astype(np.int64)
        live = live[jump[live] < shards]
    return shard.astype(np.int32)


def stable_key(value: Column) -> Column:
    """60 bits of the MD5 of the value's text: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a long key."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards))

    return shard(key)


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard): grown_shard is the shard with one more shard."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select(id_col, (F.col("_bytes") + 1).alias("size"), "text_crc32", stable_key(F.col(id_col)).alias("_key"))
    rows = rows.withColumns({"shard": jump_shard(F.col("_key"), shards), "grown_shard": jump_shard(F.col("_key"), shards + 1)})
    return gapless_rank(rows, ["shard"], [id_col, "text_crc32", "size"], "slot", rows=docs.count(), spread="_key").drop("_key")


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op2_jump_shards": op2_jump_shards}
