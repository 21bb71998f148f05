"""Spelling variants, whitening and quality rules against brute force, and on nulls, ties, repeated rows, empty tables, clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from agentsec.llm import quality, spelling, whitening

CLASH = "doc_id long, text string, word string, n long, failed string, kept string, _id string, _text string, component int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "f", "k", "i", "t", 2) for i, t in rows], CLASH)


# --- 11 -----------------------------------------------------------------------------------------------------
def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    near = {w: {x for x in n if one_edit(w, x)} for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def found_variants(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("longest", [40, 6])
def test_variants_against_brute_force(spark, longest):
    rng = random.Random(longest)
    words = set()
    while len(words) < 250:
        w = "".join(rng.choices("abé", k=rng.choice([1, 2, 5, 6, 7, 9, 12])))
        words.add(w)
        k = rng.randrange(len(w))
        words.update((w[:k] + rng.choice("abÿ") + w[k + 1 :], w[:k] + rng.choice("ab") + w[k:]))
    words |= {"a" * k for k in range(1, 50)} | {"x" * 39 + "y", "x" * 41, "x" * 40, "x" * 20 + "y" + "x" * 20, "z" * 300, "z" * 301, "z" * 150 + "q" + "z" * 149}
    n = {w: rng.choice([3, 3, 6, 7, 14, 30, 10**12]) for w in words}
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found_variants(spelling.variants(counts, longest)) == plain_variants(n)


def test_ties_chains_and_no_words(spark):
    n = {"abcde": 3, "abcdf": 6, "abcdg": 6, "abcxg": 12, "abcxgg": 24, "other": 9}
    got = found_variants(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == plain_variants(n)
    assert got["abcde"][0] == "abcdf" and got["abcdg"][1] == "abcxgg" and got["other"] == (None, "other", 9, 0, None)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_damaged_words_of_documents(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["Hello", "ÀÉstr", "heLLo-World", "four", "abcdef×÷", "x1hellox"], k=30)) + "\n") for k in range(200)]
    rows += [(None, "Hello hello"), (5, None), (6, ""), (7, "é" * 5000 + " " + "hello " * 3000), rows[0], rows[0]]
    want, fold = Counter(), str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(fold)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                want[run] += 1
    got = {r.word: r.n for r in spelling.word_counts(spelling.damaged_words(documents(spark, rows))).collect()}
    assert got == {w: n for w, n in want.items() if n >= 3}
    assert any(w not in ("hello", "Àéstr".translate(fold)) for w in got)
    assert spelling.word_counts(spelling.damaged_words(documents(spark, []))).count() == 0


# --- 12 -----------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, n long, whitened string, _id string, _v string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "w", "i", "v", "c") for i, v in rows], VECTORS)


@pytest.mark.parametrize("d", [1, 2, 3, 9, 40])
def test_eigensolver(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    spectra = [rng.random(d) * 1e4, np.ones(d), np.r_[7.0, np.zeros(d - 1)], 5 + rng.random(d) * 1e-12, np.r_[1e8, rng.random(d - 1)], np.repeat(rng.random(d), 2)[:d]]
    for e in spectra:
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        values, v = whitening.leading_components(a, 8)
        norm = np.linalg.norm(a, 2)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][: len(values)]).max() < 1e-13 * norm
        assert np.abs(a @ v - v * values).max() < 1e-13 * norm and np.abs(v.T @ v - np.eye(len(values))).max() < 1e-12
    assert len(whitening.leading_components(np.zeros((d, d)), 8)[0]) == 0
    assert len(whitening.leading_components(q[:, :1] @ q[:, :1].T, 8)[0]) == 1


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(0)
    data = (rng.standard_normal((300, 12)) * rng.random(12) + 3).astype(np.float32)
    data[100:220] = data[3]  # many copies of one vector
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    bad = [(900, None), (901, [None] + [0.0] * 11), (902, [float("nan")] + [0.0] * 11), (903, [float("-inf")] + [0.0] * 11)]
    rows += [rows[7], (None, rows[8][1])]  # a repeated row, a row without id
    got = whitening.whiten(vectors(spark, rows + bad).repartition(5)).collect()
    x = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    want = (c @ axes) / np.sqrt(values)
    for k in range(8):
        mine = sorted((-1 if r.vec_id is None else r.vec_id, r.deviation, r.whitened) for r in got if r.component == k + 1)
        theirs = sorted((-1 if i is None else i, int(((n * row - s) ** 2).sum()), float(w)) for (i, _), row, w in zip(rows, x, want[:, k]))
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert all(abs(r.explained - values[k] / (c * c).sum() * n) < 1e-12 for r in got if r.component == k + 1)
    assert max(r.identity_error for r in got) < 1e-9
    again = whitening.whiten(vectors(spark, rows + bad).repartition(1)).collect()  # the same, however rows are dealt
    exact = lambda rows: sorted((r.vec_id is None, r.vec_id or 0, r.component, r.deviation, r.explained) for r in rows)
    assert exact(got) == exact(again)


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0  # no variance
    assert whitening.whiten(vectors(spark, [(1, []), (2, [])])).count() == 0
    flat = whitening.whiten(vectors(spark, [(k, [k, 2 * k, 5]) for k in range(9)])).collect()  # one direction only
    assert len(flat) == 9 and {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    with pytest.raises(ValueError, match="several lengths"):
        whitening.whiten(vectors(spark, [(1, [1, 2]), (2, [1])]))
    wide = whitening.whiten(vectors(spark, [(k, [k * 2.0**40, k % 3]) for k in range(50)])).collect()  # deviations beyond a long
    assert any(r.deviation is None for r in wide) and max(r.identity_error for r in wide) < 1e-6


def test_exact_gram_of_large_entries():
    y = np.array([[2**40, -3], [5, 2**31]], np.int64)
    want = [[2**80 + 25, -3 * 2**40 + 5 * 2**31], [-3 * 2**40 + 5 * 2**31, 9 + 2**62]]
    assert whitening.exact_gram(y).tolist() == want


# --- 13 -----------------------------------------------------------------------------------------------------
def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for k in range(len(w) - 7):
        places.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {k + j for ks in places.values() if len(ks) > 1 for k in ks for j in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered), sum(c.isalpha() for c in text))


def test_ledger_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 5000, "\x0ba\n a\na\r\na \n", "#" * 30 + " é𝄞 <b>", "long" * 50_000]
    for _ in range(150):
        w = [rng.choice("ab") + rng.choice(["", "é", "1"]) for _ in range(rng.randrange(60))]
        texts.append("".join(x + rng.choice([" ", "  ", "\n", "\t", " # "]) for x in w))
        texts.append(" ".join(rng.choices(["w%d" % k for k in range(40)], k=60) + w[:9] + w[:9]))
        texts.append(" ".join(rng.choices(["word", "another", "clean"], k=rng.randrange(10, 40))))
    rows = list(enumerate(texts)) + [(None, texts[5]), (0, texts[8]), (5, texts[5])]
    got = quality.apply_policy(quality.ledger(documents(spark, rows))).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *(r[m] for m in quality.MEASURES)) for r in got) == sorted((-1 if i is None else i, *plain_measures(t)) for i, t in rows)
    for r in got:
        named = {m: r[m] for m in quality.MEASURES}
        assert r.failed == sum(quality.BITS[name] for name, condition in quality.RULES if eval(condition, {}, named))
        mine = [name for name in quality.POLICIES[quality.CURRENT] if r.failed & quality.BITS[name]]
        assert r.kept == (not mine) and r.sole_rule == (mine[0] if len(mine) == 1 else None)
    assert {r.kept for r in got} == {True, False}
    assert quality.ledger(documents(spark, [])).count() == 0


@pytest.mark.parametrize("version", sorted(quality.POLICIES))
def test_ablation_equals_policies_with_a_rule_less(spark, version):
    rng = random.Random(version)
    masks = [rng.randrange(1 << len(quality.RULES)) if rng.random() < 0.6 else 1 << rng.randrange(len(quality.RULES)) for _ in range(400)] + [0] * 50
    rows = spark.createDataFrame([(k, m, f"s{k % 3}") for k, m in enumerate(masks)], "doc_id long, failed long, source string")
    rules = quality.POLICIES[version]
    for by in ([], ["source"]):
        for r in quality.ablation(rows, version, by).collect():
            mine = [m for k, m in enumerate(masks) if not by or f"s{k % 3}" == r.source]
            bit, rest = quality.BITS[r.rule], quality.mask_of(tuple(x for x in rules if x != r.rule))
            assert r.n_failed == sum(bool(m & bit) for m in mine) and r.n_kept == sum(not m & quality.mask_of(rules) for m in mine)
            assert r.n_kept_without == sum(not m & rest for m in mine) == r.n_kept + r.n_sole
    assert quality.ablation(rows, version).count() == len(rules)
