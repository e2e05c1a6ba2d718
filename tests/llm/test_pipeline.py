import hashlib
import os
from array import array

import pytest
from test_decontam import brute as decontam_brute
from test_minhash import brute as minhash_brute
from test_secrets import brute as secrets_brute

import corpus_pipeline
from urbanloom.llm import bpe, quality, secrets
from urbanloom.llm.queries import vocabulary
from urbanloom.llm.training import held_out

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_equals_a_brute_force_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~held_out("doc_id", 4, 2))
    good = {r.doc_id for r in quality.classify(docs, weights).where("score >= 0.7").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    comp = minhash_brute(rows, 5, 80)
    rows = [(d, t) for d, t in rows if comp[d][1] == d]
    hits = decontam_brute(rows, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    rows = [(d, t) for d, t in rows if not hits[d][1]]
    codec, want = bpe.Codec(*vocabulary()), {}
    for (d, t), spans in zip(rows, secrets_brute([t for _, t in rows])):
        ids = list(array("i", codec.encode(secrets.redact(t, spans))))
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) > 50


def test_one_document_of_each_group_stays(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(5, words), (5, words), (None, words), (9, words + " more"), (7, "another text of six words"), (None, "no id and no copy here"), (None, "only null"), (None, "only null"), (3, ""), (3, ""), (4, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], schema)
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(5, words), (7, "another text of six words"), (None, "no id and no copy here"), (None, "only null"), (3, ""), (3, ""), (4, None)], key=str)


def test_stages_keep_the_columns_and_handle_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0)], empty.schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, SF).count() == 0
        out = stage(spark, odd, SF)
        # without a labelled row the classifier scores 0.5, which it rejects
        assert out.count() == (3 if k else 0), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == empty.columns
