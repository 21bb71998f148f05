"""Operator 6, packing: minimum bin slack over the histogram of remaining lengths.

Each document's ids are cut at multiples of the window; full pieces are windows by themselves. The counts of
the remaining lengths, at most window - 1 numbers however many documents there are, go to the driver, where a
bitset subset-sum over the multiset finds what fills a window closest to its capacity (the longest length is
always taken, so the search ends), with the counts found by backtracking. The same filling is repeated while
its lengths last. Ranks within a length then send every piece to its window and offset on the executors.

Nulls: a null text is empty and gives one piece with the end id alone. Repeated rows are packed each for
itself. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, map_arrow, materialize, table
from .tokens import PieceEncoder, vocabulary

WINDOW, END_ID = 1024, 0


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The sub-multiset of `counts` whose sum is largest without passing `room`."""
    reach, steps, mask, top = 1, [], (1 << (room + 1)) - 1, 1 << room
    for length in sorted(counts, reverse=True):
        left, unit = min(counts[length], room // length), 1
        while left > 0 and not reach & top:
            take = min(unit, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left, unit = left - take, unit * 2
        if reach & top:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def minimum_slack_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """[(repeats, {length: pieces in one window})] that uses every piece once."""
    left, plan = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = closest_fill({k: v for k, v in left.items() if v}, window - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        repeats = min(left[k] // n for k, n in fill.items())
        plan.append((repeats, fill))
        for k, n in fill.items():
            left[k] -= repeats * n
            if not left[k]:
                del left[k]
    return plan


def plan_rows(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a window, first window, offset) for each length of each filling."""
    rows, used, sequence = [], {}, 0
    for repeats, fill in plan:
        offset = 0
        for length in sorted(fill, reverse=True):
            n, start = fill[length], used.get(length, 0)
            rows.append((length, start, start + n * repeats, n, sequence, offset))
            used[length] = start + n * repeats
            offset += n * length
        sequence += repeats
    return rows


def cut_documents(docs: DataFrame, vocab: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), a row for each piece."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(vocab, spaced=True)
        for batch in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += ((doc_id, at, len(p := ids[at : at + window]), zlib.crc32(p.tobytes()), len(ids)) for at in range(0, len(ids), window))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, schema)


def pack(docs: DataFrame, vocab: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of `cut_documents` with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = materialize(cut_documents(docs, vocab or vocabulary("byte_bpe_50k.json"), window, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    plan = plan_rows(minimum_slack_plan(counts, window))
    places = spark.createDataFrame(plan, "length long, lo long, hi long, per long, first long, base long")
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "_rank", rows=sum(counts.values()))
    # the plan's size depends on the window alone, not on the data
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))).drop(places["length"])
    nth = F.col("_rank") - F.col("lo")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(nth / F.col("per")).cast("long")).alias("sequence_id"),
        (F.col("base") + (nth % F.col("per")) * F.col("length")).alias("offset"),
    )


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pack_sequences": op6_pack_sequences}
