"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from agentsec.llm import components, decontamination, jaccard_join, nearest, packing, pii, sharding, substring_dedup, token_counts, token_files, tokens, toxicity, words
from agentsec.llm.common import gapless_rank, new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, rank string, token string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], DOCS)


def sentence(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [sentence(rng, rng.randrange(1, 90)) for _ in range(60)]
    rows = list(enumerate(base))
    rows += [(100 + k, base[k % 7]) for k in range(20)]  # copies
    for k in range(30):  # near copies of one text
        w = base[5].split() or ["a"]
        w = (w * 5)[:80]
        w[rng.randrange(len(w))] = f"x{k}"
        rows.append((200 + k, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "   "), (None, base[0]), (303, "A B c"), (304, "a b C"), (305, "long " * 30000)]
    rows.append(rows[3])  # a repeated row
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def collected(df):
    return df.collect()


# --- words --------------------------------------------------------------------------------------------------
def test_word_hashes_equal_split(monkeypatch):
    import pyarrow as pa

    rng = random.Random(0)
    rows = [None, "", " ", *("".join(rng.choices("ab \t\né", k=rng.randrange(40))) for _ in range(500))]
    for size in (1 << 20, 16):
        monkeypatch.setattr(words, "RANGE", size)
        words._powers.clear()
        seen, at = {}, 0
        for h, bounds in words.hashed(pa.array(rows), words.SAME):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                w = (rows[at] or "").encode().split()
                assert len(w) == hi - lo
                for a, b in zip(w, h[lo:hi]):
                    assert seen.setdefault(a, int(b)) == int(b)
                at += 1
        assert at == len(rows) and len(set(seen.values())) == len(seen)
    words._powers.clear()


def test_gapless_rank(spark):
    got = gapless_rank(spark.range(1000).selectExpr("id", "id % 3 AS g"), ["g"], ["id"], "n", rows_per_block=37).toPandas()
    for _, one in got.groupby("g"):
        assert sorted(one.n) == list(range(len(one)))


# --- 1 ------------------------------------------------------------------------------------------------------
BASE = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else False, 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choices("ab@.1+- ()29:[]é", k=40))
        assert pii.base_spans(t) == plain_base(t)
    assert pii.base_spans("1" * 200_000 + "@" + "a." * 100_000) is not None  # no run is scanned twice


def test_pii_spans(spark, docs, none):
    rows = [(1, "mail jo@x.org now"), (2, "call +1 (269) 555-3296 4524132264652876 ok"), (3, None), (4, "ip 10.0.0.1, 300.1.1.1"), (5, "card 4111 1111 1111 1111"), (6, "nothing"), (6, "nothing")]
    got = {r.doc_id: r for r in collected(pii.scan_documents(frame(spark, rows)))}
    assert got[1].n_email == 1 and got[1].spans == "email:5:13"
    assert got[4].n_ip == 1 and got[5].n_card == 1
    assert got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "phone:5:22" in got[2].spans and got[2].n_phone == 0  # the base match has too many digits; the method adds the number
    assert pii.scan_documents(frame(spark, rows)).count() == len(rows) and pii.scan_documents(none).count() == 0
    masked = {r.doc_id: r.text for r in collected(pii.mask_documents(frame(spark, rows)))}
    assert masked[1] == "mail [EMAIL] now" and masked[3] is None and masked[6] == "nothing"


def plain_classifier(found):
    """Probability by (kind, votes), from a Counter of (kind, code): the same estimate, one pattern and one labeler at a time."""
    out = {}
    for kind in {k for k, _ in found}:
        rows = [([code // 3 ** (pii.LABELERS - 1 - j) % 3 for j in range(pii.LABELERS)], n) for (k, code), n in sorted(found.items()) if k == kind]
        prior, start = 0.5, [0.6, 0.3, 0.1]
        rates = {(c, j, v): start[v if c == 0 else 2 - v] for c in (0, 1) for j in range(pii.LABELERS) for v in range(3)}
        for _ in range(pii.EM_ROUNDS):
            post = []
            for votes, _n in rows:
                no, yes = 1 - prior, prior
                for j, v in enumerate(votes):
                    no, yes = no * rates[0, j, v], yes * rates[1, j, v]
                post.append(yes / (no + yes))
            total, positive = sum(n for _, n in rows), sum(n * q for (_, n), q in zip(rows, post))
            prior = min(max((positive + 1) / (total + 2), 0.01), 0.99)
            for c, j, v in rates:
                share = [n * (q if c else 1 - q) for (_, n), q in zip(rows, post)]
                hits = sum(w for w, (votes, _n) in zip(share, rows) if votes[j] == v)
                rates[c, j, v] = (hits + 5 * start[v if c == 0 else 2 - v]) / (sum(share) + 5)
        w = [0.1] * pii.LABELERS + [0.0]
        at = lambda votes: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, [*(v - 1 for v in votes), 1]))))
        for _ in range(300):
            off = [n * (q - at(votes)) / total for (votes, n), q in zip(rows, post)]
            w = [x + 2.0 * (sum(o * [*(v - 1 for v in votes), 1][j] for o, (votes, _n) in zip(off, rows)) - 0.001 * x) for j, x in enumerate(w)]
        out |= {(kind, code): at([code // 3 ** (pii.LABELERS - 1 - j) % 3 for j in range(pii.LABELERS)]) for k, code in found if k == kind}
    return out


def test_pii_rows_equal_a_plain_version(spark):
    rng = random.Random(12)
    parts = ["jo@x.org", "call (415) 555-2671", "tel 415-555-2671", "serial 415-555-2671", "invoice 020-111-3333", "ann [at] mail [dot] com", "4111 1111 1111 1111", "order 4111111111111111",
             "host 10.1.2.3", "version 1.2.3.400", "+1 (269) 555-3296", "fe80:0:0:0:1:2:3:4", "é", "plain words"]
    rows = [(k, " ".join(rng.choices(parts, k=rng.randrange(0, 9)))) for k in range(150)] + [(900, None), (901, "")]
    found, every = Counter(), {}
    for i, t in rows:
        base = plain_base(t or "")
        more = pii.wide_spans(t or "", base)
        every[i] = (base, [(x, x[1], pii.votes(t, x, False)) for x in more])
        found.update([(x[1], pii.votes(t, x, True)) for x in base] + [(k, v) for _, k, v in every[i][1]])
    keep = plain_classifier(found)
    assert min(abs(q - pii.ACCEPT) for q in keep.values()) > 1e-9
    name = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    got = collected(pii.scan_documents(frame(spark, rows).repartition(5)))
    assert len(got) == len(rows)
    for r in got:
        base, more = every[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
        assert r.spans == name(sorted(base + [x for x, k, v in more if keep[k, v] >= pii.ACCEPT]))
    assert 0 < sum(keep[k, v] >= pii.ACCEPT for _, more in every.values() for _, k, v in more)


def test_reliabilities_separate_good_from_bad_votes():
    good, bad = int("222122", 3), int("100100", 3)
    table = pii.fit_votes(np.array([3, 3]), np.array([good, bad]), np.array([500, 300]))
    assert table[3, good] > 0.9 > 0.5 > table[3, bad]


# --- 2 ------------------------------------------------------------------------------------------------------
def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 2**63, 2000).astype(np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_shards(spark, docs, texts, none):
    got = sharding.assign_shards(docs).toPandas()
    assert len(got) == len(texts)
    moved = got[got["shard"] != got.grown_shard]
    assert set(moved.grown_shard) <= {16} and set(got["shard"]) <= set(range(16))
    for _, one in got.groupby("shard"):
        assert sorted(one.slot) == list(range(len(one)))
    size = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts if i is not None}
    assert all(size[int(r.doc_id)] == (r["size"], r.text_crc32) for _, r in got.dropna(subset=["doc_id"]).iterrows())
    assert sharding.assign_shards(none).count() == 0


# --- 3 ------------------------------------------------------------------------------------------------------
def test_decontamination_against_brute_force(spark, none):
    rng = random.Random(5)
    items = [(k, sentence(rng, n)) for k, n in enumerate([20, 35, 35, 50, 3, 1])] + [(7, None), (8, ""), (None, "a b c d e f")]
    rows = [(k, sentence(rng, 60)) for k in range(20)]
    for k in range(20):
        w = items[k % 4][1].split()
        if k >= 8:
            w[rng.randrange(len(w))] = "changed"
        if k >= 14:
            del w[rng.randrange(len(w))]
        rows.append((100 + k, sentence(rng, 30).upper() + "! " + ", ".join(w) + " " + sentence(rng, 10)))
    rows += [(200, None), (201, ""), (202, items[4][1]), (203, "x " * 20000 + items[0][1]), (None, items[0][1]), rows[25]]
    got = {(r.doc_id, r.item_id): r.similarity for r in collected(decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")))}
    norm = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    want = {}
    for i, t in rows:
        for j, b in items:
            w, v = norm(t), norm(b)
            if i is None or j is None or not v:
                continue
            k = min(5, len(v))
            grams = lambda x: [tuple(x[a : a + k]) for a in range(len(x) - k + 1)]
            theirs, all_, m = Counter(grams(v)), grams(w), len(v) - k + 1
            best = max((sum((Counter(all_[s : s + m]) & theirs).values()) for s in range(len(all_) - m + 1)), default=0)
            if best and best / (2 * m - best) >= 0.75:
                want[i, j] = best / (2 * m - best)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in got)
    assert len(want) > 12
    assert decontamination.contaminated(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontamination.contaminated(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_of_documents_shorter_than_the_item(spark):
    rng = random.Random(11)
    items = [(k, sentence(rng, n)) for k, n in enumerate([39, 39, 24, 60, 6, 4])]
    rows, want = [], {}
    for j, b in items:
        w = b.split()
        for cut in range(len(w)):  # the passage without its last words, its first words, or some inside
            for n, own in enumerate((w[: len(w) - cut], w[cut:], w[: len(w) // 2] + w[len(w) // 2 + cut :], w[:-1][: cut or None] + ["other"] + w[:-1][cut + 1 :])):
                rows.append((1000 * j + 10 * cut + n, " ".join(own)))
    rows += [(90_000, items[0][1]), (90_001, sentence(rng, 30)), (90_002, items[0][1].rsplit(" ", 1)[0]), (90_002, sentence(rng, 50))]
    for i, t in rows:
        for j, b in items:
            w, v = t.split(), b.split()
            k = min(5, len(v))
            grams = lambda x: Counter(tuple(x[a : a + k]) for a in range(len(x) - k + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                ours, theirs = grams(w[s : s + len(v)]), grams(v)
                both = sum((ours & theirs).values())
                whole = sum(ours.values()) + sum(theirs.values()) - both
                if both and both / whole >= 0.75 and both / whole > want.get((i, j), (0,))[0]:
                    want[i, j] = both / whole, s, min(len(w), len(v))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in collected(decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")))}
    assert got.keys() == want.keys() and all(abs(got[x][0] - want[x][0]) < 1e-9 and got[x][1:] == want[x][1:] for x in got)
    assert want[10, 0][2] == 38 and got[10, 0][0] > 0.9
    assert sum(n < len(items[j][1].split()) for (_, j), (_, _, n) in want.items()) > 40 and (90_002, 0) in want


# --- 4 ------------------------------------------------------------------------------------------------------
def test_substring_dedup_against_brute_force(spark, texts, none, monkeypatch):
    rng = random.Random(9)
    passage = sentence(rng, 60)
    rows = [r for r in texts if r[0] is not None] + [(400 + k, sentence(rng, 20) + " " + passage + " " + sentence(rng, k)) for k in range(12)]
    first, want = {}, {}
    for i, t in sorted(rows):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                keep[k : k + 13] = [False] * 13
        kept = [x for x, y in zip(w, keep) if y]
        want[i] = (len(w), len(w) - len(kept), b" ".join(kept).decode())
    for chunk in (800_000, 200):
        monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
        got = collected(substring_dedup.remove_repeats(frame(spark, [*rows, (None, passage)]).repartition(5)))
        assert len(got) == len(rows) + 1
        assert all((r.n_words, r.n_removed, r.kept) == want[r.doc_id] for r in got if r.doc_id is not None)
        assert [(r.n_words, r.n_removed) for r in got if r.doc_id is None] == [(60, 0)]
    assert substring_dedup.remove_repeats(none).count() == 0


# --- 5 ------------------------------------------------------------------------------------------------------
def test_nearest_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CLUSTER_ROWS", 100)
    monkeypatch.setattr(nearest, "BLOCK", 64)
    rng = np.random.default_rng(2)
    v = rng.standard_normal((900, 16)).astype(np.float32)
    v[300:600] = v[300]  # a third are one vector
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] + [1.0] * 15), (2200, [1.0, 2.0]), (None, [1.0] * 16), (0, v[0].tolist())]
    df = spark.createDataFrame([(*r, "a") for r in rows], "vec_id long, embedding array<float>, score string")
    got = nearest.nearest(df, df.filter("vec_id % 50 = 0")).toPandas()
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        one = got[got.query_id == q].sort_values("rank")
        assert list(one["rank"]) == [1, 2, 3, 4, 5] and q not in set(one.vec_id)
        assert np.allclose(one.score, u[one.vec_id] @ u[q], atol=1e-12)
        assert list(zip(-one.score.round(12), one.vec_id)) == sorted(zip(-one.score.round(12), one.vec_id))
        s = u @ u[q]
        s[q] = -9
        hits += len(set(one.vec_id) & set(np.lexsort((np.arange(900), -s.round(12)))[:5]))
    assert hits >= 0.9 * 5 * 18 and set(got.query_id) == set(range(0, 900, 50))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in collected(nearest.nearest(few))) == [(0, 50), (50, 0)]
    assert nearest.nearest(few.filter("vec_id < 0")).count() == 0


def test_nearest_with_an_id_repeated_ten_times(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((200, 16))
    v[1] = v[0] + 0.01 * v[1]  # close to the query, and ten times in the table
    for near in range(2, 6):
        v[near] = v[0] + 0.3 * near * v[near]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(1, v[1].tolist())] * 9
    rows += rows[6:]  # and others twice
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(df, df.filter("vec_id < 6")).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(6):
        s = u @ u[q]
        s[q] = -9
        one = got[got.query_id == q].sort_values("rank")
        assert list(one.vec_id) == list(np.argsort(-s, kind="stable")[:5]) and np.allclose(one.score, np.sort(s)[::-1][:5])


# --- 6 ------------------------------------------------------------------------------------------------------
def test_plan_uses_every_piece_once_and_fills_closest():
    rng = random.Random(4)
    for _ in range(20):
        counts = Counter(rng.randrange(1, 64) for _ in range(rng.randrange(1, 60)))
        plan = packing.minimum_slack_plan(dict(counts), 64)
        used = Counter()
        for repeats, fill in plan:
            assert sum(k * n for k, n in fill.items()) <= 64
            for k, n in fill.items():
                used[k] += repeats * n
        assert used == counts
        small = dict(list(counts.items())[:8])
        best, reach = 0, {0}
        for k, n in small.items():
            for _ in range(n):
                reach |= {r + k for r in reach if r + k <= 50}
        best = max(reach)
        fill = packing.closest_fill(small, 50)
        assert sum(k * n for k, n in fill.items()) == best and all(n <= small[k] for k, n in fill.items())


def test_packing(spark, docs, texts, none):
    from tokenizers import Tokenizer

    vocab = tokens.vocabulary("byte_bpe_50k.json")
    tk = Tokenizer.from_file(vocab)
    got = packing.pack(docs).toPandas()
    ids = {i: np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in texts if i is not None}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        want = ids[int(r.doc_id)]
        assert r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
    assert got.length.sum() == sum(len(x) for i, x in ids.items()) + len(ids[3]) + len(ids[0])  # the repeated row and the one without an id
    q = got.sort_values(["sequence_id", "offset"])
    assert (q.offset == q.groupby("sequence_id").length.cumsum() - q.length).all() and got.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack(none).count() == 0


def test_piece_encoder_equals_the_library(monkeypatch):
    rng = random.Random(8)
    t = ["", " a", "a  b\n\nc d", "x<|endoftext|>y", "it's\tnew 'll  ", "Zoë naïve ́x y", "a \n b", "\n", "x.'s y!!", "é!! ²,", "a\nb c\nd", "q " * 500 + "z"]
    t += ["".join(rng.choices("ab.'! \nÉ1", k=60)) for _ in range(300)]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        for limit, chars in ((500_000, 4 << 20), (20, 30)):
            monkeypatch.setattr(tokens, "PIECE_LIMIT", limit)
            monkeypatch.setattr(tokens, "GROUP_CHARS", chars)
            e = tokens.PieceEncoder(tokens.vocabulary(name), spaced)
            assert [list(x) for x in e.encode(t)] == [x.ids for x in e.tokenizer.encode_batch(t, add_special_tokens=False)]
            hard = ["\0", "x\0y, z", "a\1, b", "it,\" ¿qué?, ß). 3,4.5", "a\tb, c,", "\n, x,\n\ny.", "word, " * 9 + "<|endoftext|>, "]
            assert [list(x) for x in e.encode(hard)] == [x.ids for x in e.tokenizer.encode_batch(hard, add_special_tokens=False)]


# --- 7 ------------------------------------------------------------------------------------------------------
def test_toxicity_learns_words_and_skips_held_out_labels(spark, none):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        bad = k % 4 == 0
        w = sentence(rng, 30).split()
        if bad:
            w[rng.randrange(30)] = rng.choice(["Trash!", "scum", "idiot$$"])
        rows.append((k, " ".join(w)))
        held = zlib.crc32(str(k).encode()) % 3 == 1
        labels.append((k, int(bad) if not held else 1 - int(bad)))  # held-out labels are wrong: they must not matter
    rows += [(5000, None), (5001, ""), (None, "scum"), (5002, "scum " * 5000), rows[1]]
    lab = spark.createDataFrame([*labels, (0, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(frame(spark, rows), lab).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = got[got.doc_id.notna() & (got.doc_id < 900)]
    held = held[[zlib.crc32(str(int(k)).encode()) % 3 == 1 for k in held.doc_id]]
    assert ((held.doc_id % 4 == 0) == (held.predicted == 1)).mean() > 0.95
    assert got[got.doc_id == 5000].score.iloc[0] == got[got.doc_id == 5001].score.iloc[0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int").filter("doc_id < 0")
    assert set(toxicity.score_toxicity(frame(spark, rows[:5]), one).toPandas().score) == {0.5}
    assert toxicity.score_toxicity(none, lab).count() == 0


def test_ftrl_equals_a_plain_version():
    rng = random.Random(8)
    rows = [(np.unique(rng.choices(range(60), k=12)).astype(np.int64), int(rng.random() < 0.4)) for _ in range(200)]
    rows = [(np.append(s, 99) if y else s, y) for s, y in rows]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(3):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            slots, y = rows[k]
            names = ["bias", *slots.tolist()]
            w = {i: weight(i) for i in names}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (toxicity.POSITIVE_WEIGHT if y else 1.0)
            for i in names:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    bias, at, found = toxicity.ftrl(rows, epochs=3)
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert 0 < len(want) < 61 and 99 in want  # L1 leaves few
    assert dict(zip(at.tolist(), found)) == pytest.approx(want) and bias == pytest.approx(weight("bias"))


# --- 8 ------------------------------------------------------------------------------------------------------
def plain_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("settings", [{}, {"HOT": 1, "GROUP": 2, "STARS": 1, "BLOCK": 3}, {"GROUP": 1, "STARS": 1}])
def test_jaccard_join_against_brute_force(spark, texts, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(11)
    base, rows = sentence(rng, 60, 5000).split(), [r for r in texts if r[0] is not None]
    for k in range(40):  # a chain of edits: near neighbours link, ends don't
        base[rng.randrange(60)] = f"e{k}"
        rows.append((500 + k, " ".join(base)))
    want = plain_components(rows)
    got = collected(jaccard_join.link_documents(frame(spark, [*rows, (None, rows[0][1])]).repartition(4)))
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_merged_tokens_lose_no_shared_pair(spark):
    rng = random.Random(5)
    holders = {t: rng.sample(range(40), 12) for t in range(30)}
    holders |= {100 + t: list(range(20)) for t in range(6)}  # one passage: six tokens of the same documents
    holders[200] = [50, 52, 54]  # one component only
    comp = {d: d % 2 for d in range(60)}
    rows = [(t, d, comp[d], 10 + d, (t + d) % 3 == 0) for t, ds in holders.items() for d in ds]
    got = collected(jaccard_join.merged_tokens(spark.createDataFrame(rows, "token long, doc long, comp long, n long, idx boolean").repartition(3)))
    units = defaultdict(dict)
    for r in got:
        assert r.doc not in units[r.token] and (r.comp, r.n) == (comp[r.doc], 10 + r.doc)
        units[r.token][r.doc] = r.idx
    assert not any({50, 52, 54} & set(u) for u in units.values())
    assert len(units) <= len(holders) - 6 and sum(map(len, units.values())) < len(rows)
    for t, ds in holders.items():
        if t != 200:
            idx = {d: (t + d) % 3 == 0 for d in ds}
            assert any(all(d in u and u[d] >= idx[d] for d in ds) for u in units.values())


def test_jaccard_join_of_nothing(none):
    assert jaccard_join.link_documents(none).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5), (7, 6)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in collected(components.connected_components(spark.createDataFrame(pairs, "a long, b long")))}
    assert got == {k: 0 for k in range(41)} | {1000 + k: 1000 for k in range(50)}


# --- 9 ------------------------------------------------------------------------------------------------------
def test_token_counts_equal_the_library(spark, docs, texts, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.load_pieces(tokens.vocabulary("piece_bpe_32k.model"))
    tk = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tk.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    count = lambda t: len(tk.encode(t or "", add_special_tokens=False).ids)
    got = collected(token_counts.count_tokens(docs))
    want = Counter((i, count(t)) for i, t in texts)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    counter = token_counts.ViterbiCounter(pieces)
    for t in ["", " ", "  a", "a  b ", "日本語 ☃☃", "\n\t x", "<0x41> <s>", "▁x▁▁", "\U0001f600 z", "x" * 5000]:
        assert counter.text(t)[1] == count(t), t
    assert token_counts.count_tokens(none).count() == 0


def test_ties_keep_the_earlier_start():
    c = token_counts.ViterbiCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0)])
    assert c.word("ab") == (1, -2.0) and c.word("abc") == (1, -3.0)


# --- 10 -----------------------------------------------------------------------------------------------------
def test_token_files_round_trip(spark, docs, texts, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    uri = new_path(spark, "round-trip")
    manifest = token_files.write_token_files(docs, uri, shard_bytes=60_000)
    assert manifest.count() > 1
    got = token_files.read_token_files(manifest, uri, with_ids=True).toPandas()
    assert len(got) == len(texts)
    want = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    for r in got.itertuples():
        ids = want[None if np.isnan(r.doc_id) else int(r.doc_id)]
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    q = got.sort_values("start")
    assert (q.start == q.n_tokens.cumsum() - q.n_tokens).all() and q.doc_id.dropna().is_monotonic_increasing
    empty = new_path(spark, "round-trip")
    assert token_files.read_token_files(token_files.write_token_files(none, empty), empty).count() == 0


def test_a_shard_with_another_dictionary_is_refused(spark, docs):
    uri = new_path(spark, "round-trip")
    manifest = token_files.write_token_files(docs, uri)
    fs, root = token_files.open_fs(uri)
    row = manifest.first()
    reader = token_files.ShardReader(fs, root, row.file)
    assert len(reader.ids(0)) == reader.index[0]["n"]  # one document by its index alone
    with fs.open_output_stream(f"{root}/{row.dict_sha256}.zdict") as f:
        f.write(b"other")
    with pytest.raises(ValueError):
        token_files.ShardReader(fs, root, row.file)


def test_ids_beyond_16_bits_are_refused(spark, docs):
    with pytest.raises(Exception, match="16 bits"):
        token_files.write_token_files(docs, new_path(spark, "round-trip"), end_id=70_000)


def test_toxicity_keeps_columns_named_like_its_results(spark):
    docs = spark.createDataFrame([(1, "a b", "keep", 9)], "doc_id long, text string, score string, predicted int")
    out = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).first()
    assert (out.score_in, out.predicted_in, out.score, out.predicted) == ("keep", 9, 0.5, 0)


def test_links_of_rows_that_repeat_an_id(spark):
    rng = random.Random(8)
    a, b, c = (sentence(rng, 60, 4000) for _ in range(3))
    rows = [(1, a), (3, c), (3, a + " more"), (3, c), (5, b), (2, c + " x"), (None, a), (4, None), (4, b + " y")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in collected(jaccard_join.link_documents(frame(spark, rows))))
    assert got == sorted([(1, 56, 1), (3, 56, 2), (3, 57, 1), (3, 56, 2), (5, 56, 4), (2, 57, 2), (-1, 56, -1), (4, 0, 4), (4, 57, 4)])


def test_nearest_of_vectors_of_several_lengths(spark, monkeypatch):
    rng = np.random.default_rng(9)
    wide, flat = rng.standard_normal((60, 8)), rng.standard_normal((12, 2))
    rows = [(k, v.tolist()) for k, v in enumerate(wide)] + [(200 + 10 * k, v.tolist()) for k, v in enumerate(flat)] + [(1000, [1.0, 2.0, 3.0]), (1050, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(df, df.filter("vec_id % 50 = 0")).toPandas()
    for ids, v in ((list(range(60)), wide), ([200 + 10 * k for k in range(12)], flat)):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        for at, q in enumerate(ids):
            if q % 50 == 0:
                s = u @ u[at]
                s[at] = -9
                one = got[got.query_id == q].sort_values("rank")
                assert list(one.vec_id) == [ids[j] for j in np.argsort(-s, kind="stable")[:5]]
    assert set(got.query_id) == {0, 50, 200, 250, 300}  # alone of its length: no row
    monkeypatch.setattr(nearest, "MAX_LENGTHS", 2)
    with pytest.raises(ValueError, match="lengths"):
        nearest.nearest(df)
