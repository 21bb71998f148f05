"""The pipeline's stages, one after the other, on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline as pipeline
from agentsec.llm.common import materialize, new_path


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(k, line(60)) for k in range(300)]
    rows += [(1000 + k, line(40) + " trash scum " + line(10)) for k in range(100)]
    item = line(30)
    rows += [(2000, line(20) + " " + item + " " + line(20)), (2001, rows[3][1]), (2002, rows[3][1] + " more"), (2003, "write to jo@x.org " + line(30)), (2004, None), (2005, "")]
    path = new_path(spark, "corpus")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in rows if i < 2000], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = materialize(stage(spark, docs, corpus), name)
        if name != pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        seen[name] = {r.doc_id: r for r in out.collect()} if name != "packing" else out.collect()
        docs = out
    assert set(range(300)) <= seen["toxicity"].keys() and sum(1000 <= k < 1100 for k in seen["toxicity"]) <= 5
    assert 3 in seen["jaccard_join"] and not {2001, 2002} & seen["jaccard_join"].keys()
    assert 2000 in seen["jaccard_join"] and 2000 not in seen["decontamination"]
    masked = seen["pii"][2003]
    assert "[EMAIL]" in masked.text and "jo@x.org" not in masked.text and masked.n_chars == len(masked.text)
    assert seen["pii"][2004].text is None
    assert {r.doc_id for r in seen["packing"]} == seen["pii"].keys()


def test_run_gives_the_last_stage(spark, corpus):
    assert pipeline.run(spark, corpus).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_of_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, corpus), name)
        assert docs.count() == 0


def test_repeated_ids_extra_columns_ties_and_long_texts(spark, corpus):
    """Decisions are by row: in every stage another text of the same doc_id stays or goes for itself."""
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    a, c, e, f, g, far = (line(60) for _ in range(6))
    item = spark.read.parquet(f"{corpus}/benchmark.parquet").first().text
    toxic = line(40) + " trash scum " + line(10)
    rows = [(1, a), (3, c), (3, a + " more"), (7, e), (7, f), (8, f + " x"), (9, g), (9, g), (9, g + " y"), (2, g + " z"), (None, a), (None, None)]
    rows += [(20, far), (20, far[:100] + " " + item), (30, line(30)), (30, toxic), (40, "mail jo@x.org " + line(30)), (40, line(20) + " mail al@y.org"), (50, ""), (50, None), (60, line(60_000))]
    shape = "doc_id long, text string, _key string, score string, component_id int, rank int, lang string"  # no source, no n_chars, clashing names
    docs = spark.createDataFrame([(i, t, "k", "s", 1, 2, "en") for i, t in rows], shape)
    kept = {}
    for name, stage in pipeline.STAGES:
        if name == "toxicity":  # too few labels here to learn from: taken as kept
            out = docs.filter(docs.text.isNull() | ~docs.text.contains("trash scum")).select("doc_id", "text", "lang")
        else:
            out = materialize(stage(spark, docs, corpus), name)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang"]
            kept[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
            docs = out
        else:
            pieces = out.collect()
    joined = kept["jaccard_join"]
    want = [(1, a), (3, c), (7, e), (7, f), (2, g + " z"), (None, a), (None, None), (20, far), (20, far[:100] + " " + item), (50, ""), (50, None)]
    assert all(row in joined for row in want)
    assert not {(3, a + " more"), (8, f + " x"), (9, g), (9, g + " y")} & set(joined)
    assert {i for i, _ in joined} == {1, 3, 7, 2, None, 20, 30, 40, 50, 60}
    assert (20, far) in kept["decontamination"] and len(kept["decontamination"]) == len(joined) - 1
    assert sum("[EMAIL]" in (t or "") for _, t in kept["pii"]) == 2
    whole = {}
    for p in pieces:
        whole[p.doc_id, p.doc_tokens] = whole.get((p.doc_id, p.doc_tokens), 0) + p.length
    assert {p.doc_id for p in pieces} == {i for i, _ in kept["pii"]} and sum(whole.values()) == sum(p.length for p in pieces)


def test_smallest_id_stays_when_keys_are_hashes(spark, corpus):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(50)) for _ in range(12)]
    rows = [(k, t + f" v{k}") for k in range(40) for t in rng.sample(texts, 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in pipeline.keep_one_of_each(spark, docs, corpus).collect())
    want = sorted((min(k for k, t in rows if t.startswith(base)), base) for base in texts)
    assert [(i, t.rsplit(" ", 1)[0]) for i, t in got] == want
