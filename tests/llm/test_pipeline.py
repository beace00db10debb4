"""The pipeline's stages, each on its own input and all together."""

import corpus_pipeline as pipe
import pytest

from cellweave.llm import bpe, jaccard_join, secrets


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_stages_keep_columns(spark, docs, small, tmp_path):
    d = docs
    for k, (name, stage) in enumerate(pipe.STAGES[:-1]):
        out = stage(spark, d, small)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        d = spark.read.parquet(str(tmp_path / str(k)))
        assert d.count() > 0
    last = pipe.STAGES[-1][1](spark, d, small)
    c = bpe.default_codec()
    import numpy as np

    text = {r.doc_id: r.text for r in d.collect()}
    for r in last.collect():
        assert c.decode_bytes(np.array(r.ids, "<u4").tobytes()).decode() == text[r.doc_id] and r.n_tokens == len(r.ids)


def test_one_document_of_each_group(spark, docs, small):
    out = pipe.near_duplicate_stage(spark, docs, small)
    classes = {r.key: r.class_id for r in jaccard_join.near_classes(docs).collect()}
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(set(classes.values()))


def test_secrets_are_gone(spark, docs, small):
    s = secrets.default_scanner()
    out = pipe.secret_stage(spark, docs, small).collect()
    assert sum(len([x for x in s.spans(r.text) if x[0] != "random"]) for r in out) == 0
    assert all(r.n_chars == len(r.text) for r in out)


def test_run(spark, small):
    assert pipe.run(spark, small).count() > 0
