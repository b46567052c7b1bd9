"""The pipeline, stage by stage, against plain versions on a small table."""

import hashlib

import public_tokenizers as P
import pytest
from test_bpe import BRUTE
from test_native import base_pii
from test_simhash import brute_components, brute_wide_print, shingles

import corpus_pipeline
from linkgraph.llm import decontaminate as dc
from linkgraph.llm import toxicity as tox
from linkgraph.llm.simhash import bits_for

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "toxic")
    scores = {r.doc_id: r.predicted for r in tox.toxicity_digest(stages[0], labels).collect()}
    assert set(rows(stages[1])) == {i for i, p in scores.items() if not p}


def test_near_duplicates(stages):
    """The stage takes five words and a similarity of 0.8: against plain fingerprints, and against Jaccard."""
    before = sorted(rows(stages[1]).items())
    texts = [r.text for _, r in before]
    roots = brute_components([brute_wide_print(t) for t in texts], bits_for(0.8))
    kept = set(rows(stages[2]))
    assert kept == {i for k, (i, _) in enumerate(before) if roots[k] == k}
    sets = [shingles(t) for t in texts]
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a) if sets[a] & sets[b]}
    assert any(0.8 <= x < 1 for x in near.values())
    assert all(roots[a] == roots[b] for (a, b), x in near.items() if x >= 0.85)
    alone = set(range(len(sets))) - {k for pair, x in near.items() if x >= 0.6 for k in pair}
    assert {before[k][0] for k in alone if sets[k]} <= kept


def test_decontaminate(spark, stages):
    items = [(t, int(0.2 * len(t) + 1e-9)) for t in (dc.normalise(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect())]
    before = {i: dc.normalise(r.text) for i, r in rows(stages[2]).items()}
    kept = set(rows(stages[3]))
    for i, text in before.items():
        if len(text) < 3000:
            assert (i in kept) == (not any(dc.edit_distance(t, text)[0] <= d for t, d in items))


def test_pii(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not base_pii(r.text)
        assert r.n_chars == (len(r.text) if base_pii(before[i].text) else before[i].n_chars)
        if not base_pii(before[i].text) and "[" not in r.text:
            assert r.text == before[i].text


def test_bpe_and_run(spark, stages):
    before, after = rows(stages[4]), rows(stages[5])
    for i, r in before.items():
        ids = BRUTE.encode_ordinary(r.text)
        assert after[i].n_tokens == len(ids)
        assert after[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert after[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert P.PATTERN and rows(corpus_pipeline.run(spark, D)) == after


def test_odd_rows(spark, docs):
    df = docs([(1, None, "en", None, None), (None, "", None, "s", 0), (2, "a b c x@y.zz", "en", "s", 12), (2, "a b c x@y.zz", "en", "s", 12)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, D)
    assert sorted(map(tuple, df.collect()), key=str) == [(1, None, "en", None, None), (2, "a b c [EMAIL]", "en", "s", 13)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([], df.schema), D).count() == 0


def test_long_texts_and_ties(spark, docs):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i % 977} part{i % 613}" for i in range(120_000))
    df = docs([(5, long, "en", "s", 1), (5, long + " x", "en", "s", 1), (4, long + " and a few more", "en", "s", 1), (6, "of its own", "en", "s", 10)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, D)
    assert sorted(r.doc_id for r in df.collect()) == [4, 6]


def test_scratch_is_released(spark, docs):
    import os

    from linkgraph.llm import common

    kept = common.materialize(docs([(1, "a")]), "probe")
    assert os.path.isdir(kept.scratch)
    common.release(kept)
    common.release(docs([(1, "a")]))
    assert not os.path.exists(kept.scratch)


def test_clashing_columns(spark, docs):
    extra = "_row _text _found _items _score _pii _merged _before _order fp class contamination pii blob ids row start".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    df = docs([(1, "mail a@b.cd to them", "en", "s", 19, *extra), (2, "quite other words are here", "en", "s", 26, *extra)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, D)
        assert df.columns == [c.split()[0] for c in schema.split(", ")]
    want = [(1, "mail [EMAIL] to them", "en", "s", 20, *extra), (2, "quite other words are here", "en", "s", 26, *extra)]
    assert sorted(map(tuple, df.collect())) == want
    assert corpus_pipeline.STAGES[-1][1](spark, df, D).count() == 2
