"""The pipeline's stages take effect and keep clean documents."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    draw = random.Random(1)
    words = ["".join(draw.choice(["the", "an", "er", "on", "st", "ou", "ea"]) for _ in range(3)) for _ in range(500)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    clean = [(i, text(80), "en", "s") for i in range(40)]
    passage = text(30)
    near = clean[3][1].split(" ")
    near[40] = "other"
    odd = [(50, None, "en", "s"), (51, "12 34", None, None), (52, clean[1][1].upper(), "en", "s"), (53, " ".join(near), "en", "s"), (54, text(20) + " " + passage + " " + text(20), "en", "s")]
    rows = [(*r, 0) for r in clean + odd]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_drop_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.materialise(stage(spark, docs, folder), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append({r.doc_id for r in docs.collect()})
    assert [a - b for a, b in zip(ids, ids[1:])] == [{50, 51}, {1}, {53}, {54}]
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == ids[-1] and all(r.n_tokens > 0 for r in out)


def test_empty_table_passes(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
