"""Operator 8, n-gram Jaccard join: prefix filters under several global token orders, then exact verification.

A document's set is its distinct 5-word shingles (A-Z lower-cased); two documents link at a Jaccard similarity of
at least 3/4. If sets a and b link, then under any total order of shingles they share one of the first
n - ceil(3n/4) + 1 of each (the larger set), and of the smaller set one of the first n - ceil(6n/7) + 1.

1. Equal sets become one class by digest. A count of shingles in 2^17 hash slots, over all documents, gives
   every order its first key, so that frequent shingles come last; a hash finishes each order.
2. The first shingle under each of STARS orders is a minhash. Documents that share one are compared with the one
   among them whose minhashes are shared most, the likely original, never with each other; verified links are
   contracted. This is only a head start: most near copies are one component before any pair is listed.
3. Prefix tokens under the first order go to hash buckets; a bucket lists pairs of *different* components that
   share a token and fit in size. A token with more than GROUP documents lists none: its documents are compared
   in blocks, with their sketches beside them, and only pairs that may link come out; tokens of much the same
   documents count as one token there. A component with very many
   documents on one token in a chunk is sent as one mark, and its rows are brought by a join where another
   component has that token too.
4. Sketches of the sets, counts in hash cells, drop pairs that cannot overlap enough. A pair must then share prefix
   tokens under the other orders too; what is left is verified on the whole sets.

No link is lost: a pair left out is in one component already. No bucket lists pairs inside a component. Blocks are not
so frugal: a token that c documents hold, of two components or more, is dealt as c * ceil(c / BLOCK) rows with their
sketches, and all its block pairs are compared, those inside one component masked only there. So a very large group
of near copies whose token one outsider holds too costs rows and comparisons that grow with the square of the group.

Nulls: a null or empty text, or one without words, has an empty set and is alone; a null doc_id has no links and a null
component. Rows are judged by their own text: rows that repeat a doc_id with another text link, or don't, each for itself, and a component's
id is the smallest doc_id of its rows. Repeated rows have equal results. Other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, map_arrow, materialize, released_group, row_keys, table
from .components import connected_components
from .substring_dedup import _table, pack, split_by, squeeze, top_bits, unpack, unsqueeze
from .words import mix, row_shingles

SHINGLE, STARS, ORDERS, SLOT_BITS = 5, 8, 3, 17
#: Rows of a component on one token in a chunk above which they travel as one mark; rows of a token above which they are compared in blocks, of so many rows.
HOT, GROUP, BLOCK = 200, 16, 512
CHUNK, BUCKET_ROWS, PARTNERS = 500_000, 500_000, 400


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both) > 0


def ordered(s: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of shingles in a global order: frequency level, then a hash."""
    return (levels[s >> np.uint64(64 - SLOT_BITS)].astype(np.uint64) << np.uint64(58)) | (mix(s, 100 + order) >> np.uint64(6))


def prefix(s: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """The shingles of `s` that a similar set must meet, first in the order first."""
    p = len(s) - (3 * len(s) + 3) // 4 + 1
    key = ordered(s, levels, order)
    return s[np.argsort(key, kind="stable")[:p]]


def index_length(n: np.ndarray) -> np.ndarray:
    return n - (6 * n + 6) // 7 + 1


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in two to four times as many hash cells, as three bit planes: at least 1, 2 and 3."""
    bits = max(6, int(len(s)).bit_length() + 1)
    cells = np.bincount(((s >> np.uint64(8)) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return b"".join(np.packbits(cells >= t, bitorder="little").tobytes() for t in (1, 2, 3))


def planes(raw: bytes, words: int | None = None) -> np.ndarray:
    """[plane, word] of a sketch, cells added up until `words` are left."""
    p = np.frombuffer(raw, np.uint64).reshape(3, -1)
    while words and p.shape[1] > words:
        (a1, a2, a3), (b1, b2, b3) = p[:, : p.shape[1] // 2], p[:, p.shape[1] // 2 :]
        p = np.stack([a1 | b1, (a1 & b1) | a2 | b2, (a1 & b2) | (a2 & b1) | a3 | b3])
    return p


def overlap_bound(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """No two sets of one row ([row, plane, word]) share more than this: smaller counts, and what cells above 3 may hide."""
    count = lambda p: np.bitwise_count(p).sum((1, 2), dtype=np.int64)
    return count(x & y) + np.minimum(n_x - count(x), n_y - count(y))


def may_link(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """False only where the sketches show that the sets overlap too little."""
    words = min(len(a), len(b)) // 24
    bound = overlap_bound(planes(a, words)[None], planes(b, words)[None], np.array([n_a]), np.array([n_b]))
    return 7 * int(bound[0]) >= 3 * (n_a + n_b)


def profile(docs: DataFrame) -> DataFrame:
    """(kind, a, b, digest, mins, sketch): kind 0 a document (id, set size, set digest, minhashes), kind 1 a slot and its count."""
    fields = [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("digest", pa.binary()), ("mins", pa.list_(pa.int64())), ("sketch", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            rows, slot_parts = [], []
            for doc_id, s in zip(batch.column(0).to_pylist(), row_shingles(batch.column(1))):
                slot_parts.append((s >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
                mins = [int(mix(s, 50 + k).min().astype(np.int64)) for k in range(STARS)] if len(s) else None
                rows.append((0, doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, mins, sketch(s) if len(s) else None))
            if rows:
                slots += np.bincount(np.concatenate(slot_parts), minlength=len(slots))
                yield from _table(rows, fields).to_batches()
        at = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(slots[at]), *(pa.nulls(len(at), t) for _, t in fields[3:])], names=[f for f, _ in fields])

    return map_arrow(docs, run, "kind int, a long, b long, digest binary, mins array<long>, sketch binary")


def frequency_levels(profiles: DataFrame) -> np.ndarray:
    """Level of each slot: 0 up to four deviations above the median count, then the logarithm of the excess."""
    got = profiles.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).toPandas()  # at most 2^SLOT_BITS rows
    counts = np.zeros(1 << SLOT_BITS)
    counts[got["a"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    middle = np.median(counts)
    return np.clip(np.log2(np.maximum((counts - middle) / (4 * np.sqrt(middle) + 4), 0.5)) + 1, 0, 31).astype(np.uint8)


def star_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): each class against the likely original of those that share a minhash with it, if sizes allow a link."""
    one = classes.select("rep", "n", F.posexplode("mins").alias("k", "m"))
    shared = one.groupBy("k", "m").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    fame = one.join(shared, ["k", "m"]).withColumn("fame", F.log2("c"))
    score = fame.groupBy("rep").agg(F.round(F.sum("fame"), 3).alias("score"))
    scored = fame.select("rep", "n", "k", "m").join(score, "rep")
    lead = scored.groupBy("k", "m").agg(F.max(F.struct("score", (-F.col("rep")).alias("back"), "n")).alias("lead"))
    pairs = scored.join(lead, ["k", "m"]).select((-F.col("lead.back")).alias("a"), F.col("rep").alias("b"), F.col("lead.n").alias("n_a"), "n").filter("a <> b")
    # the leader, which most share, is `a`
    return pairs.filter("4 * least(n_a, n) >= 3 * greatest(n_a, n)").select("a", "b").distinct()


def count_filter(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` whose sketches allow a link; no text is read."""
    known = classes.select("rep", "n", "sketch")
    both = pairs.join(known.toDF("a", "n_a", "s_a"), "a").join(known.toDF("b", "n_b", "s_b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, s_a, s_b = (c.to_pylist() for c in batch.columns[2:])
            keep = pa.array([may_link(*x) for x in zip(s_a, s_b, n_a, n_b)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return map_arrow(both, run, "a long, b long")


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, levels: np.ndarray | None) -> DataFrame:
    """The (a, b) of `pairs` that link. Each `a` meets its partners in a stream, its text sent once for some hundreds of them.

    levels: if given, pairs must first share prefix tokens under orders 1 and up.
    """
    pairs = materialize(count_filter(pairs, classes), "pairs")
    n = pairs.count()
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    salted = pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / PARTNERS)).cast("int").alias("salt"))
    asked = salted.select(F.col("b").alias("id"), "a", "salt", F.lit(1).alias("part")).union(salted.select(F.col("a").alias("id"), "a", "salt", F.lit(0).alias("part")).distinct())
    rows = join_small(docs.withColumnRenamed("doc_id", "id"), asked, "id", "inner", 2 * n)
    rows = rows.repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", "part", "id").select("a", "salt", "part", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead, fronts = None, None, []
        for batch in batches:
            out = []
            for a, salt, part, b, s in zip(*(c.to_pylist() for c in batch.columns[:4]), row_shingles(batch.column(4))):
                if part == 0:
                    if key != (a, salt):
                        key, lead = (a, salt), s
                        fronts = [prefix(s, levels, k) for k in range(1, ORDERS)] if levels is not None else []
                    continue
                meets = all(np.isin(prefix(s, levels, k + 1), f, assume_unique=True).any() for k, f in enumerate(fronts))
                if meets and similar(lead, s):
                    out.append((a, b))
            if out:
                yield from _table(out, [("a", pa.int64()), ("b", pa.int64())]).to_batches()

    return materialize(map_arrow(rows, run, "a long, b long").distinct(), "links")


def prefix_rows(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(token, doc, comp, n, idx) under order 0 of `docs` (doc_id, text, comp); idx: a smaller set must meet here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for token, doc, comp, n, idx in _prefixes(batch, levels):
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(doc), pa.array(comp), pa.array(n), pa.array(idx)], names=["token", "doc", "comp", "n", "idx"])

    return map_arrow(docs, run, "token long, doc long, comp long, n long, idx boolean")


def _prefixes(batch: pa.RecordBatch, levels: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    tokens, ids, comps, sizes = [], [], [], []
    for doc_id, s, comp in zip(batch.column(0).to_pylist(), row_shingles(batch.column(1)), batch.column(2).to_pylist()):
        if len(s):
            tokens.append(prefix(s, levels, 0))
            ids.append(doc_id)
            comps.append(comp)
            sizes.append(len(s))
    if tokens:
        p, n = np.array([len(t) for t in tokens]), np.array(sizes, np.int64)
        rank = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
        yield np.concatenate(tokens), np.repeat(np.array(ids, np.int64), p), np.repeat(np.array(comps, np.int64), p), np.repeat(n, p), rank < np.repeat(index_length(n), p)


def candidate_pairs(docs: DataFrame, levels: np.ndarray, bits: int) -> DataFrame:
    """(kind, token, a, b, n, idx): 0 a pair (a, b) of different components; 1 a row of a token of more than GROUP documents, `a` in
    component `b` with set size n; 2 a token some of whose rows were sent as one mark."""

    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        token, doc, comp, n, idx = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((comp, token))
        token, doc, comp, n, idx = token[order], doc[order], comp[order], n[order], idx[order]
        at = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (comp[1:] != comp[:-1])])
        size = np.diff(np.r_[at, len(token)])
        many = np.repeat(size > HOT, size)
        keep = ~many
        keep[at] = True
        token, doc, comp, n, idx, many = (x[keep] for x in (token, doc, comp, n, idx, many))
        rows = []
        for key, k in split_by(top_bits(token, bits), bits):
            k = k[np.lexsort((token[k], doc[k]))]
            rows.append((key, pack([token[k].tobytes(), squeeze(doc[k]), squeeze(comp[k] - doc[k]), squeeze(n[k]), np.packbits(idx[k]).tobytes(), np.packbits(many[k]).tobytes()])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["bucket", "blob"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for part in _prefixes(batch, levels):
                parts.append(part)
                rows += len(part[0])
            if rows >= CHUNK:
                yield flush(parts)
                parts, rows = [], 0
        if parts:
            yield flush(parts)

    def meet(t: pa.Table) -> pa.Table:
        cols = []
        for blob in t["blob"].to_pylist():
            raw = unpack(blob)
            token, doc, n = np.frombuffer(raw[0], np.uint64), unsqueeze(raw[1]), unsqueeze(raw[3])
            cols.append((token, doc, unsqueeze(raw[2]) + doc, n, *(np.unpackbits(np.frombuffer(r, np.uint8), count=len(n)).astype(bool) for r in raw[4:])))
        token, doc, comp, n, idx, many = (np.concatenate(c) for c in zip(*cols))
        order = np.lexsort((comp, token))
        token, comp = token[order], comp[order]
        at = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        end = np.r_[at[1:], len(token)]
        mixed = comp[at] != comp[end - 1]  # sorted by component within a token
        pairs, wide, closed = [], [], []
        for lo, hi in zip(at[mixed], end[mixed]):
            o = order[lo:hi]
            if many[o].any():
                closed.append(token[lo])
            elif hi - lo > GROUP:
                wide.append((lo, hi))
            else:
                d, c, m, x = doc[o], comp[lo:hi], n[o], idx[o]
                # (i, j): j is the smaller set and meets within its index prefix
                i, j = np.nonzero((c[:, None] != c) & (m[:, None] >= m) & x & (4 * m >= 3 * m[:, None]))
                if len(i):
                    pairs.append(np.stack([np.minimum(d[i], d[j]), np.maximum(d[i], d[j])]))
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
        rows = np.concatenate([np.arange(lo, hi) for lo, hi in wide]) if wide else np.empty(0, np.int64)
        o = order[rows]
        cols = {"kind": (np.zeros(len(a), np.int32), np.ones(len(o), np.int32), np.full(len(closed), 2, np.int32)), "token": (np.zeros(len(a), np.int64), token[rows].view(np.int64), np.array(closed, np.uint64).view(np.int64))}
        nil = np.zeros(len(closed), np.int64)
        cols |= {"a": (a, doc[o], nil), "b": (b, comp[rows], nil), "n": (np.zeros(len(a), np.int64), n[o], nil), "idx": (np.zeros(len(a), bool), idx[o], nil.astype(bool))}
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in cols.values()], names=list(cols))

    return map_arrow(docs, deal, "bucket int, blob binary").groupBy("bucket").applyInArrow(released_group(meet), "kind int, token long, a long, b long, n long, idx boolean")


def block_survivors(side: np.ndarray, doc: np.ndarray, comp: np.ndarray, n: np.ndarray, idx: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block (side 2), or between two blocks (sides 0 and 1), that differ in component and may link."""
    size = np.array([len(s) // 24 for s in sketches])
    found: list[np.ndarray] = []
    for w in np.unique(size):
        mine, near = np.flatnonzero(size == w), np.flatnonzero((size == w) | (size == 2 * w))
        here = np.stack([planes(sketches[i]) for i in mine])
        there = np.stack([planes(sketches[j], w) for j in near])
        a, b = mine[:, None], near[None]
        ok = ((n[b] >= n[a]) & idx[a]) | ((n[a] >= n[b]) & idx[b])
        ok &= (comp[b] != comp[a]) & (4 * np.minimum(n[b], n[a]) >= 3 * np.maximum(n[b], n[a]))
        # two of one size are met from both: once is enough
        ok &= np.where(side[a] == 2, (size[b] > w) | (b > a), (side[b] != side[a]) & ((size[b] > w) | (side[a] == 0)))
        i, j = np.nonzero(ok)
        for lo in range(0, len(i), step := max(1, 300_000 // int(w))):
            p, q = i[lo : lo + step], j[lo : lo + step]
            keep = 7 * overlap_bound(here[p], there[q], n[mine[p]], n[near[q]]) >= 3 * (n[mine[p]] + n[near[q]])
            found.append(np.stack([doc[mine[p[keep]]], doc[near[q[keep]]]]))
    both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return both.min(axis=0), both.max(axis=0)


def merged_tokens(rows: DataFrame) -> DataFrame:
    """The `rows` (token, doc, comp, n, idx) of tokens with two components or more, tokens of much the same documents made one.

    A token's lead is the least hash of its documents, so that tokens of one passage or one group of copies mostly share it. They become one token,
    with each document once, where that takes no more comparisons than they take alone. Documents that share a token share what it became.
    """
    sizes = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.xxhash64("doc")).alias("lead")).filter("lo < hi")
    known = materialize(rows.join(sizes.select("token", "c", "lead"), "token"), "shared")
    together = materialize(known.groupBy("lead", "doc").agg(F.min("comp").alias("comp"), F.min("n").alias("n"), F.max("idx").alias("idx")), "together")
    alone = known.groupBy("lead").agg(F.sum("c").alias("alone"))  # a token of c documents adds its c, c times
    verdict = materialize(together.groupBy("lead").agg(F.count(F.lit(1)).alias("u")).join(alone, "lead").select("lead", (F.col("u") * F.col("u") <= F.col("alone")).alias("merge")), "verdict")
    merged = together.join(verdict.filter("merge"), "lead").select(F.col("lead").alias("token"), "doc", "comp", "n", "idx")
    return merged.union(known.join(verdict.filter("NOT merge"), "lead").select("token", "doc", "comp", "n", "idx"))


def open_pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of different components that share a token of many documents (token, doc, comp, n, idx) and may link."""
    rows = merged_tokens(rows)
    sizes = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    known = rows.join(sizes, "token").join(classes.select(F.col("rep").alias("doc"), "sketch"), "doc").withColumn("i", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    dealt = known.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
    dealt = dealt.select("token", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), side.alias("side"), "doc", "comp", "n", "idx", "sketch")
    dealt = dealt.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            get = lambda c: t[c].to_numpy()
            a, b = block_survivors(get("side"), get("doc"), get("comp"), get("n"), get("idx"), t["sketch"].to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            token, p, q = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero(np.r_[True, (np.diff(token) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(token)]):
                if (token[lo], p[lo], q[lo]) != key:
                    if held:
                        yield done()
                    key, held = (int(token[lo]), int(p[lo]), int(q[lo])), []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield done()

    return map_arrow(dealt, run, "a long, b long").distinct()


def link_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`."""
    keyed, repeated = row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = link_texts(keyed.select(F.col("_key").alias("doc_id"), "text"))
    if not repeated:
        return found
    found = materialize(found.withColumnRenamed("doc_id", "_key"), "keyed")
    ids = materialize(keyed.filter("_key IS NOT NULL").select("_key", "doc_id").distinct(), "ids")
    rows = found.join(ids, "_key", "left")
    least = rows.filter("component_id IS NOT NULL").groupBy("component_id").agg(F.min("doc_id").alias("_least"))
    return rows.join(least, "component_id", "left").select("doc_id", "n_shingles", F.col("_least").alias("component_id"))


def link_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, where rows of one doc_id have one text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = materialize(profile(docs), "profiles")
    levels = frequency_levels(profiles)
    rows = profiles.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "digest", "mins", "sketch")
    known = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch")), "classes")

    stars = verify(docs, star_pairs(classes), classes, None)
    comps = materialize(connected_components(stars), "comps")

    # what is known of a document beyond itself: a copy isn't a representative, a linked one has a component
    copies = known.join(classes.select("digest", "rep"), "digest").filter("doc_id <> rep").select("doc_id", F.lit(None).cast("long").alias("comp")).distinct()
    marks = materialize(copies.union(comps.select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))).withColumn("known", F.lit(True)), "marks")
    reps = join_small(docs.filter("doc_id IS NOT NULL"), marks, "doc_id", "left", marks.count()).filter("known IS NULL OR comp IS NOT NULL").select("doc_id", "text", F.coalesce("comp", "doc_id").alias("comp"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, total / 4 / BUCKET_ROWS)))))
    found = materialize(candidate_pairs(reps, levels, bits), "candidates")
    pairs = found.filter("kind = 0").select("a", "b")
    wide = found.filter("kind = 1").select("token", F.col("a").alias("doc"), F.col("b").alias("comp"), "n", "idx")
    closed = found.filter("kind = 2").select("token").distinct()
    n_closed = closed.count()
    if n_closed:
        wide = wide.union(join_small(prefix_rows(reps, levels), closed, "token", "inner", n_closed))
    pairs = pairs.union(open_pairs(wide, classes))
    links = stars.union(verify(docs, pairs.distinct(), classes, levels))

    final = connected_components(links).withColumnsRenamed({"node": "rep", "component": "component_id"})
    whole = classes.select("digest", "rep").join(final, "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "digest").join(whole, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
