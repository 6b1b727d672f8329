import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tesselle.llm import langid, spm, toxicity
from tesselle.llm.langid import fold
from tesselle.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file
from test_minhash import brute
from test_mixing import brute as plain_mix
from test_spm import ids, plain

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stages_equal_plain_versions(spark):
    """Every stage's rows against its operator's decisions taken row by row on the driver."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    words = toxicity.Words(model.net.p.buckets)
    clean = {k for k, r in rows.items() if model.scores([words.ids(r.text)])[0] < 0.5}
    one = cp.toxic(spark, docs, DATA).persist()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == clean and len(clean) > 0.8 * len(rows)

    lm = langid.fit(one, fold(F.col("doc_id"), 4) != 2)
    said = set()
    for k in clean:
        lang, score, cos = lm.compare([rows[k].text])
        own = cos[0][lm.langs.index(rows[k].lang)] if rows[k].lang in lm.langs else None
        if lang[0] != "und" and (own is None or score[0] - own <= cp.LANGUAGE_MARGIN):
            said.add(k)
    two = cp.language(spark, one, DATA).persist()
    assert {r.doc_id for r in two.collect()} == said

    comp = {k: c for k, (_, c) in brute([(k, rows[k].text) for k in said], cp.SIMILAR).items()}
    three = cp.near_duplicates(spark, two, DATA).persist()
    assert {r.doc_id for r in three.collect()} == {k for k in said if comp[k] == k}

    taken = {i: t for i, _, t, _ in plain_mix([(r.doc_id, r.text, r.lang, r.source) for r in three.collect()])}
    four = cp.mix(spark, three, DATA).persist()
    got = {}
    for r in four.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == {k: t for k, t in taken.items() if t}

    v = spm.Vocabulary(tokenizer_file("piece_bpe_32k.model"))
    want = {t: plain(v, v.prepare(t))[0] for t in {r.text for r in four.collect()}}
    five = cp.token_ids(spark, four, DATA).collect()
    assert sorted((r.doc_id, ids(r.ids)) for r in five) == sorted((r.doc_id, want[r.text]) for r in four.collect())
    assert all(r.n_pieces == len(r.ids) // 4 for r in five)


def test_stages_take_odd_and_empty_tables(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        now = docs
        for k, (_, stage) in enumerate(cp.STAGES):
            now = stage(spark, now, str(tmp_path)).persist()
            assert now.columns == docs.columns or k == len(cp.STAGES) - 1
            now.count()


def test_registry():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert len(cp.STAGES) == 5
