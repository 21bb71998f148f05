"""Operator 5, approximate nearest neighbours: randomly rotated one-bit codes with error bounds (RaBitQ).

Centroids come from k-means on a bounded sample (SAMPLE rows, lowest id hash first); every row is indexed. A row keeps
its unit residual from the nearest centroid as one sign bit a dimension after a random rotation, with the scalars that
correct the estimate. A query probes the nearest PROBE_SHARE of the clusters (a large share: the test vectors have no
cluster structure, and the nearest of random vectors lie in any cluster; where vectors do cluster, pass less). There the packed bits give an estimate of each
inner product and a bound on its error; rows whose upper bound reaches the k-th best lower bound of distinct ids are
reranked by the exact cosine, in double precision, on the original vectors.

A cluster of any size is split into blocks of about BLOCK rows by id hash, and a query meets each block in its
own group, so copies that fill a cluster don't fill a task. A task holds one block and streams the queries past
it. A block returns at most k rows for each query.

Nulls: a null id or vector, a null or non-finite component and the zero vector take no part. Vectors of several lengths are searched
each among those of its own length, MAX_LENGTHS lengths at most (more are an error). Rows that repeat an id count once, with their best score. Fewer
candidates than k give fewer rows; empty tables none. Equal scores are ordered by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, SAMPLE, ROUNDS, BLOCK = 5, 20_000, 12, 4096
#: Rows a centroid, at most so many centroids, and the share of clusters that a query probes, PROBES at least.
CLUSTER_ROWS, MAX_CENTROIDS, PROBES, PROBE_SHARE, EPSILON = 4000, 1024, 8, 0.8, 1.9
QUERY_ROWS, MAX_LENGTHS = 512, 64


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows that take part, as doubles."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    return c


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def encode(rows: DataFrame, centroids: np.ndarray, blocks: np.ndarray | None) -> DataFrame:
    """(cluster, block, vec_id, code, norm, shift, fit, v); block is 0 while `blocks` isn't known."""
    dim, turn = centroids.shape[1], rotation(centroids.shape[1])
    vector = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1), dim)
            u = unit(v)
            near = np.argmax(u @ centroids.T, axis=1)
            res = u - centroids[near]
            norm = np.linalg.norm(res, axis=1)
            o = res @ turn / np.maximum(norm, 1e-300)[:, None]
            bits = o > 0
            fit = np.abs(o).sum(1) / np.sqrt(dim)
            ids = batch.column(0).to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            block = (mixed % blocks[near].astype(np.uint64)).astype(np.int32) if blocks is not None else np.zeros(len(ids), np.int32)
            code = pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(block), batch.column(0), code, pa.array(norm), pa.array((centroids[near] * res).sum(1)), pa.array(fit), batch.column(1).cast(vector)], names=["cluster", "block", "vec_id", "code", "norm", "shift", "fit", "v"])

    return rows.mapInArrow(run, "cluster int, block int, vec_id long, code binary, norm double, shift double, fit double, v array<double>")


def probe(queries: DataFrame, centroids: np.ndarray, blocks: np.ndarray, probes: int) -> DataFrame:
    """(cluster, block, query_id, q): a row for each block that a query visits."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = unit(matrix(batch.column(1), dim)) @ centroids.T
            near = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            n = blocks[near].sum(axis=1)
            c = np.repeat(near.ravel(), blocks[near].ravel())
            b = np.arange(len(c)) - np.repeat(np.cumsum(blocks[near].ravel()) - blocks[near].ravel(), blocks[near].ravel())
            for lo in range(0, len(c), 10_000):
                at = pa.array(np.repeat(np.arange(batch.num_rows), n)[lo : lo + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 10_000].astype(np.int32)), pa.array(b[lo : lo + 10_000].astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["cluster", "block", "query_id", "q"])

    return queries.mapInArrow(run, "cluster int, block int, query_id long, q array<double>")


def search_block(base: dict[str, np.ndarray], queries: dict[str, np.ndarray], center: np.ndarray, turn: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best (query_id, vec_id, score) of a block for each query, by estimate, bound and rerank."""
    dim, out = len(center), []
    signs = np.unpackbits(base["code"], axis=1, count=dim).astype(np.float32) * 2 - 1
    v, ids = base["v"], base["ids"]
    scale = np.abs(v).max(axis=1)
    vs = v / scale[:, None]
    v_norm = np.sqrt((vs * vs).sum(1))
    fit = np.maximum(base["fit"], 1e-9)
    # rows by id: an id counts once in the floor, with its best lower bound
    by_id = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(ids[by_id]) != 0])
    repeated = len(starts) < len(ids)
    spread = np.sqrt(np.maximum(1 - fit * fit, 0)) / fit * EPSILON / np.sqrt(max(dim - 1, 1))
    for lo in range(0, len(queries["ids"]), 256):
        q = queries["v"][lo : lo + 256]
        u = unit(q)
        d = u - center
        turned = (d @ turn).astype(np.float32)
        estimate = (turned @ signs.T) / np.sqrt(dim) / fit * base["norm"] + (u @ center)[:, None] + base["shift"]
        error = np.linalg.norm(d, axis=1)[:, None] * (spread * base["norm"]) + 1e-6
        for row, query_id in enumerate(queries["ids"][lo : lo + 256]):
            mine = ids != query_id
            low = np.where(mine, estimate[row] - error[row], -np.inf)
            if repeated:
                low = np.maximum.reduceat(low[by_id], starts)
            n = min(k, int((low > -np.inf).sum()))
            if not n:
                continue
            floor = np.partition(low, len(low) - n)[len(low) - n]
            at = np.flatnonzero(mine & (estimate[row] + error[row] >= floor))
            qs = q[row] / np.abs(q[row]).max()
            exact = vs[at] @ qs / (v_norm[at] * np.sqrt(qs @ qs))
            best = np.lexsort((ids[at], -exact))
            _, first = np.unique(ids[at][best], return_index=True)
            out += ((int(query_id), int(ids[at[b]]), float(exact[b])) for b in best[np.sort(first)][:k])
    return out


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", probe_share: float = PROBE_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of `queries` (by default all of `vectors`)."""
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vec_col)
    asked = rows if queries is None else clean(queries, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").limit(MAX_LENGTHS + 1).collect()
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in lengths:
        same = F.size("v") == r["d"]
        found = found.union(nearest_of_length(rows.filter(same), asked.filter(same), r["d"], r["count"], k, probe_share))
    return found


def nearest_of_length(rows: DataFrame, asked: DataFrame, dim: int, n: int, k: int, probe_share: float) -> DataFrame:
    """The same for n clean rows whose vectors all have `dim` components."""
    sample = unit(np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]))  # at most SAMPLE rows
    centroids = kmeans(sample, max(1, min(len(sample), n // CLUSTER_ROWS, MAX_CENTROIDS)))
    probes = min(len(centroids), max(PROBES, int(np.ceil(len(centroids) * probe_share))))
    counts = encode(rows, centroids, None).groupBy("cluster").count().collect()  # at most MAX_CENTROIDS rows
    blocks = np.zeros(len(centroids), np.int64)
    for r in counts:
        blocks[r["cluster"]] = -(-r["count"] // BLOCK)
    base = encode(rows, centroids, np.maximum(blocks, 1))
    asks = probe(asked, centroids, blocks, probes)
    turn = rotation(dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, base = None, [], None
        for batch in batches:
            names = batch.schema.names
            cluster, block, part = (batch.column(names.index(c)).to_numpy() for c in ("cluster", "block", "part"))
            cuts = np.flatnonzero(np.r_[True, (np.diff(cluster) != 0) | (np.diff(block) != 0) | (np.diff(part) != 0)])
            out: list[tuple[int, int, float]] = []
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(cluster)]):
                piece, here = batch.slice(lo, hi - lo), (cluster[lo], block[lo])
                if here != key:
                    key, parts, base = here, [], None
                if part[lo] == 0:
                    parts.append(piece)
                    continue
                if base is None and parts:
                    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    get = {c: whole.column(names.index(c)) for c in names}
                    base = {"ids": get["id"].to_numpy(), "code": np.frombuffer(b"".join(get["code"].to_pylist()), np.uint8).reshape(whole.num_rows, -1), "v": matrix(get["v"], dim)} | {c: get[c].to_numpy() for c in ("norm", "shift", "fit")}
                    parts = []
                for at in range(0, piece.num_rows if base is not None else 0, QUERY_ROWS):
                    some = piece.slice(at, QUERY_ROWS)
                    out += search_block(base, {"ids": some.column(names.index("id")).to_numpy(), "v": matrix(some.column(names.index("v")), dim)}, centroids[key[0]], turn, k)
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    none = F.lit(None)
    left = base.select("cluster", "block", F.lit(0).alias("part"), F.col("vec_id").alias("id"), "code", "norm", "shift", "fit", "v")
    right = asks.select("cluster", "block", F.lit(1), "query_id", none.cast("binary"), *[none.cast("double")] * 3, "q")
    stream = left.union(right).repartition("cluster", "block").sortWithinPartitions("cluster", "block", "part")
    found = stream.mapInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_rabitq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))


QUERIES = {"op5_rabitq_neighbours": op5_rabitq_neighbours}
