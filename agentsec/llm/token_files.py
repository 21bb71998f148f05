"""Operator 10, token-id files: shared zstandard dictionary, one frame a document, offset index.

Documents are range-partitioned by id, sorted, encoded, and each partition writes one shard file into the
shared folder. A shard is `TIDZ1\\n`, the dictionary's SHA-256, one zstandard frame per document, the index
(for each document: id, whether it has one, frame offset, frame bytes, ids), the index's place, `TIDZ1\\n`.
A short document is read by its index row alone. The dictionary is trained once on serialized id arrays of a
bounded sample of short documents and stored beside the shards under its hash; a reader checks that hash.

Nulls: a null text is empty and keeps the end id alone; null ids come first. Repeated rows each get a frame;
equal ids are ordered by text. An empty table gives no shard and no rows. A write retried after a lost
executor replaces the same file by a rename. Texts of any length are one frame; other columns are ignored; a
vocabulary with ids of more than 16 bits is refused.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, new_path, table, text_or_empty
from .tokens import PieceEncoder, vocabulary

MAGIC, END_ID, ID_TYPE = b"TIDZ1\n", 1, "<u2"
TAIL = "<QQ6s"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("size", "<u8"), ("n", "<u8")])
SHARD_BYTES = 48 << 20
#: The dictionary is trained on at most this many documents of at most SAMPLE_CHARS characters, lowest id hash first.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL = 2000, 20_000, 32 << 10, 3


def encode_ids(encoder: PieceEncoder, texts: list[str | None], end_id: int) -> Iterator[np.ndarray]:
    for ids in encoder.encode([t or "" for t in texts]):
        yield np.append(ids, np.uint32(end_id)).astype(ID_TYPE)


def train_dictionary(docs: DataFrame, vocab: str, end_id: int = END_ID) -> bytes:
    """zstandard dictionary of a bounded sample; empty bytes where the sample is too small to train one."""
    text = text_or_empty()
    short = docs.filter(F.length(text) <= SAMPLE_CHARS).select("doc_id", text.alias("text"))
    picked = short.select(F.xxhash64("doc_id", "text").alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h").alias("h"), F.count("h").alias("n")).first()
    if not picked["n"]:
        return b""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, samples = PieceEncoder.shared(vocab, spaced=False), []
        for batch in batches:
            samples += [ids.tobytes() for ids in encode_ids(encoder, batch.column(0).to_pylist(), end_id)]
        try:
            made = zstandard.train_dictionary(DICT_BYTES, samples[: 2 * SAMPLE_DOCS]).as_bytes()
        except zstandard.ZstdError:
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["d"])

    sample = short.filter(F.xxhash64("doc_id", "text") <= picked["h"]).dropDuplicates(["text"]).select("text").repartition(1).sortWithinPartitions("text")
    return bytes(map_arrow(sample, train, "d binary").first()["d"])


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, uri: str, vocab: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards under `uri`; the manifest (shard, file, dict_sha256, n_docs, n_tokens), in id order."""
    vocab = vocab or vocabulary("word_bpe_49k.json")
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, min(total["n"], -(-(total["b"] or 0) // shard_bytes)))
    dictionary = train_dictionary(docs, vocab, end_id)
    sha = hashlib.sha256(dictionary).digest()
    fs, root = open_fs(uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{sha.hex()}.zdict") as f:
        f.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, fs_, encoder = TaskContext.get().partitionId(), open_fs(uri)[0], PieceEncoder.shared(vocab, spaced=False)
        if max(encoder.tokenizer.get_vocab_size() - 1, end_id) > np.iinfo(ID_TYPE).max:
            raise ValueError("ids of this vocabulary don't fit in 16 bits")
        zd = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zd, write_dict_id=False)
        name, draft = f"shard-{shard:06d}.tidz", f"{root}/.{uuid.uuid4().hex}"
        index, at, tokens = [], len(MAGIC) + 32, 0
        with fs_.open_output_stream(draft) as f:
            f.write(MAGIC + sha)
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode_ids(encoder, batch.column(1).to_pylist(), end_id)):
                    frame = packer.compress(ids.tobytes())
                    f.write(frame)
                    index.append((doc_id or 0, doc_id is not None, at, len(frame), len(ids)))
                    at, tokens = at + len(frame), tokens + len(ids)
            f.write(np.array(index, INDEX).tobytes())
            f.write(struct.pack(TAIL, at, len(index), MAGIC))
        if not index:
            fs_.delete_file(draft)
            return
        fs_.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "dict_sha256": [sha.hex()], "n_docs": [len(index)], "n_tokens": [tokens]}, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("dict_sha256", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(map_arrow(dealt, write, "shard int, file string, dict_sha256 string, n_docs long, n_tokens long"), "manifest")


class ShardReader:
    """One shard: `index`, and the ids of any document by its place in it."""

    def __init__(self, fs: pafs.FileSystem, root: str, file: str):
        self.file = fs.open_input_file(f"{root}/{file}")
        size = self.file.size()
        at, n, magic = struct.unpack(TAIL, self.file.read_at(22, size - 22))
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{file} is no token-id shard")
        sha = head[len(MAGIC) :]
        with fs.open_input_stream(f"{root}/{sha.hex()}.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != sha:
            raise ValueError(f"the dictionary of {file} has another hash")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        e = self.index[k]
        raw = self.unpacker.decompress(self.file.read_at(int(e["size"]), int(e["offset"])), max_output_size=int(e["n"]) * 2)
        return np.frombuffer(raw, ID_TYPE)


def read_token_files(manifest: DataFrame, uri: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read back from the shards."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard, so few
    jobs = manifest.select("file", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("base"), F.row_number().over(Window.orderBy("shard")).alias("k"))
    root = open_fs(uri)[1]
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = open_fs(uri)[0]
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(fs, root, file)
                for lo in range(0, len(shard.index), 1000):
                    rows = []
                    for k in range(lo, min(lo + 1000, len(shard.index))):
                        ids, e = shard.ids(k), shard.index[k]
                        rows.append((int(e["doc_id"]) if e["has_id"] else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + ((ids,) if with_ids else ()))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], schema=pa.schema(fields))

    shards = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(jobs.repartition(shards, "k").select("file", "base"), read, schema)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_path(spark, "token-ids")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), uri), uri)


QUERIES = {"op10_token_files": op10_token_files}
