"""Operator 4, substring dedup: de Bruijn compaction of repeated token k-mers.

A window of 13 words is an edge of the de Bruijn graph, from its first 12 words to its last 12. Edges are
dealt to buckets by hash; a bucket marks each edge that a document with a smaller id also has, and names that
source (document, position). Marks return to buckets of documents, where edges that follow each other in both
document and source, without a branch to another source, compact into one path (document, start, edges, source,
source start). Spark joins then bring the words at both coordinates of each path as SHA-256 digests, and only
paths that verify are removed, so a hash collision never removes text. Hashes keep 56 bits and the bucket number;
a window whose only found source is a collision stays, at odds of about 1 in 10^10 a window.

Edges travel as packed arrays, a row for each chunk of documents and bucket, and a chunk first resolves its own
repeats: an edge that a third of all documents hold reaches its bucket once for each chunk.

Nulls: a null or empty text has no words and keeps the hash of no bytes; rows with a null id keep all words and
are no source. Rows that repeat a doc_id are expected to repeat the text, and aren't sources for each other.
Windows are judged on the input. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty
from .words import mix, row_grams

WINDOW, CHUNK, BUCKET_WINDOWS = 13, 800_000, 1_000_000


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes of their differences."""
    d = np.diff(values.astype("<i8"), prepend=0)
    return zstandard.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unsqueeze(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.cumsum(planes.reshape(8, -1).T.copy().view("<i8").ravel())


def pack(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, parts)) + b"".join(parts)


def unpack(blob: bytes) -> list[bytes]:
    n = struct.unpack_from("<Q", blob)[0]
    at, out = 8 * (n + 1), []
    for size in struct.unpack_from(f"<{n}Q", blob, 8):
        out.append(blob[at : at + size])
        at += size
    return out


def split_by(keys: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indices in their order) for each key."""
    order = np.argsort(keys.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
    ends = np.cumsum(np.bincount(keys.astype(np.int64), minlength=1))
    start = 0
    for key, end in enumerate(ends):
        if end > start:
            yield key, order[start:end]
        start = end


def top_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def sources(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices of edges that a smaller document in the arrays has, that document, the position there)."""
    order = np.lexsort((pos, doc, h))
    hs, ds = h[order], doc[order]
    starts = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    first = np.repeat(starts, np.diff(np.r_[starts, len(hs)]))
    late = np.flatnonzero(ds > ds[first])
    return order[late], ds[first[late]], pos[order][first[late]]


def mark_rows(doc: np.ndarray, pos: np.ndarray, src: np.ndarray, src_pos: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    for key, at in split_by(top_bits(mix(doc.astype(np.uint64), 5), bits), bits):
        at = at[np.lexsort((pos[at], doc[at]))]
        yield key, pack([squeeze(doc[at]), squeeze(pos[at]), squeeze(src[at]), squeeze(src_pos[at] - pos[at])])


def read_marks(blobs: list[bytes]) -> list[np.ndarray]:
    cols = [[unsqueeze(p) for p in unpack(b)] for b in blobs]
    doc, pos, src, shift = (np.concatenate(c) for c in zip(*cols))
    return [doc, pos, src, shift + pos]


def edges(docs: DataFrame, bits: int, window: int) -> DataFrame:
    """(kind, bucket, blob): kind 0 are edges by hash bucket, kind 1 marks, already found, by document bucket."""

    def flush(hs: list, ids: list) -> pa.RecordBatch:
        n = np.array([len(x) for x in hs])
        h, doc = np.concatenate(hs), np.repeat(np.array(ids, np.int64), n)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        late, src, src_pos = sources(h, doc, pos)
        rows = [(1, key, blob) for key, blob in mark_rows(doc[late], pos[late], src, src_pos, bits)]
        ship = np.ones(len(h), bool)
        ship[late] = False
        h, doc, pos = h[ship], doc[ship], pos[ship]
        for key, at in split_by(top_bits(h, bits), bits):
            low = np.ascontiguousarray(h[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7])
            rows.append((0, key, pack([low.tobytes(), squeeze(doc[at]), squeeze(pos[at])])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["kind", "bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ids, n = [], [], 0
        for batch in batches:
            for doc_id, g in zip(batch.column(0).to_pylist(), row_grams(batch.column(1), window)):
                if len(g):
                    hs.append(g)
                    ids.append(doc_id)
                    n += len(g)
                if n >= CHUNK:
                    yield flush(hs, ids)
                    hs, ids, n = [], [], 0
        if n:
            yield flush(hs, ids)

    return docs.filter(F.col("doc_id").isNotNull()).mapInArrow(run, "kind int, bucket int, blob binary")


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], schema=pa.schema(fields))


def repeated_marks(edge_rows: DataFrame, bits: int) -> DataFrame:
    """(bucket, blob): marks by document bucket, of all edges that a smaller document has."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        rows = [(bucket, b) for k, b in zip(t["kind"].to_pylist(), t["blob"].to_pylist()) if k == 1]
        blobs = [unpack(b) for k, b in zip(t["kind"].to_pylist(), t["blob"].to_pylist()) if k == 0]
        if blobs:
            low = np.frombuffer(b"".join(b[0] for b in blobs), np.uint8).reshape(-1, 7)
            h = np.zeros((len(low), 8), np.uint8)
            h[:, :7] = low
            doc, pos = (np.concatenate([unsqueeze(b[k]) for b in blobs]) for k in (1, 2))
            late, src, src_pos = sources(h.view("<u8").ravel(), doc, pos)
            rows += mark_rows(doc[late], pos[late], src, src_pos, bits)
        return _table(rows, [("bucket", pa.int32()), ("blob", pa.binary())])

    return edge_rows.groupBy("bucket").applyInArrow(run, "bucket int, blob binary")


def compact_paths(marks: DataFrame) -> DataFrame:
    """(doc_id, start, edges, src_id, src_start): nonbranching runs of marked edges."""
    names = ["doc_id", "start", "edges", "src_id", "src_start"]

    def run(t: pa.Table) -> pa.Table:
        doc, pos, src, src_pos = read_marks(t["blob"].to_pylist())
        order = np.lexsort((src, pos, doc))
        doc, pos, src, src_pos = doc[order], pos[order], src[order], src_pos[order]
        once = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
        doc, pos, src, src_pos = doc[once], pos[once], src[once], src_pos[once]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1]) | (src_pos[1:] != src_pos[:-1] + 1)]
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(doc)])
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (doc[at], pos[at], size, src[at], src_pos[at])], names=names)

    return marks.groupBy("bucket").applyInArrow(run, ", ".join(f"{n} long" for n in names))


def digests(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(id, at, edges, digest) of the words that each wanted (id, at, edges) covers."""
    asked = wanted.groupBy("id").agg(F.collect_list(F.struct("at", "edges")).alias("asked"))
    rows = docs.join(asked, docs["doc_id"] == asked["id"], "left").select("doc_id", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if spans:
                    words = text.encode(errors="surrogatepass").split()
                    out += ((doc_id, s["at"], s["edges"], hashlib.sha256(b" ".join(words[s["at"] : s["at"] + s["edges"] + window - 1])).digest()) for s in spans)
            yield _table(out, [("id", pa.int64()), ("at", pa.int64()), ("edges", pa.int64()), ("digest", pa.binary())]).combine_chunks().to_batches()[0] if out else pa.RecordBatch.from_pydict({"id": [], "at": [], "edges": [], "digest": []}, schema=pa.schema([("id", pa.int64()), ("at", pa.int64()), ("edges", pa.int64()), ("digest", pa.binary())]))

    return rows.mapInArrow(run, "id long, at long, edges long, digest binary").distinct()


def repeated_paths(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Verified (doc_id, start, edges, src_id, src_start) of all repeats; `docs` is (doc_id long, text string)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, size / 6 / BUCKET_WINDOWS)))))
    paths = compact_paths(repeated_marks(edges(docs, bits, window), bits))
    paths = materialize(paths, "paths")
    wanted = paths.select(F.col("doc_id").alias("id"), F.col("start").alias("at"), "edges").union(paths.select("src_id", "src_start", "edges")).distinct()
    found = digests(docs, wanted, window)
    own = found.select(F.col("id").alias("doc_id"), F.col("at").alias("start"), "edges", F.col("digest").alias("own"))
    src = found.select(F.col("id").alias("src_id"), F.col("at").alias("src_start"), "edges", F.col("digest").alias("theirs"))
    return paths.join(own, ["doc_id", "start", "edges"]).join(src, ["src_id", "src_start", "edges"]).filter(F.col("own") == F.col("theirs")).select(*paths.columns)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without the words of repeated windows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cuts = repeated_paths(docs, window).groupBy("doc_id").agg(F.collect_list(F.struct("start", "edges")).alias("cuts"))
    cuts = cuts.withColumnRenamed("doc_id", "cut_id")
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode(errors="surrogatepass").split()
                n, gone = len(words), 0
                if spans:
                    mask = np.zeros(n + 1, np.int64)
                    for s in spans:
                        mask[s["start"]] += 1
                        mask[s["start"] + s["edges"] + window - 1] -= 1
                    keep = np.cumsum(mask[:-1]) == 0
                    gone = n - int(keep.sum())
                    words = [w for w, k in zip(words, keep) if k]
                out.append((doc_id, n, gone, b" ".join(words).decode(errors="surrogatepass")))
            if out:
                yield from _table(out, fields).to_batches()

    rows = docs.join(cuts, docs["doc_id"] == cuts["cut_id"], "left").select("doc_id", "text", "cuts")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op4_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_debruijn_dedup": op4_debruijn_dedup}
