import numpy as np

import corpus_pipeline
from panelwright.llm import packing

from . import corpus, test_langid


def folder(spark, tmp_path, rows, items):
    corpus.docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, tmp_path):
    rows = test_langid.sample(80)
    rows = [(i, t + f" w{i} x{i} y{i} z{i}", *rest) for i, t, *rest in rows]
    copies = [(500 + i, rows[i][1], *rows[i][2:]) for i in range(5)]
    bad = [(600, "12 34 !!", None, "s", 0, 0, 0.0, 0, ""), (601, None, None, "s", 0, 0, 0.0, 0, "")]
    passage = " ".join("bench%d" % i for i in range(30))
    dirty = [(700, f"some english thing and {passage} there", "en", "s", 0, 0, 0.0, 0, "")]
    sf = folder(spark, tmp_path, rows + copies + bad + dirty, [(1, passage)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name != "pack":
            assert docs.columns == before.columns
            seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    clean = set(range(80))
    assert set(seen["language_id"]) == clean | {500 + i for i in range(5)} | {700}
    assert sorted(seen["near_dedup"]) == sorted(clean | {700})
    assert sorted(seen["decontaminate"]) == sorted(clean)
    assert set(seen["mix"]) <= clean and len(seen["mix"]) > 70
    packed = docs.collect()
    assert {d for r in packed for d in r.doc_ids} == set(seen["mix"])
    assert all(len(np.frombuffer(r.input_ids, "<u4")) == 2048 for r in packed)


def test_run_equals_stages_and_stands_awkward_rows(spark, tmp_path):
    sf = folder(spark, tmp_path, corpus.rows(), [(1, "never seen"), (None, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(packing.unpack(docs).toPandas().doc_id.fillna(-1)) == sorted(packing.unpack(corpus_pipeline.run(spark, sf)).toPandas().doc_id.fillna(-1))


def test_mix_takes_alike_rows_one_by_one(spark):
    rows = [(None, "w " * 100, "en", "ab"[i % 4 > 0], 0, 0, 0.0, 0, "") for i in range(199)] + [(1, "w " * 99 + "x", "en", "b", 0, 0, 0.0, 0, "")]
    got = corpus_pipeline.mix(spark, corpus.docs(spark, rows), "")
    assert got.columns == corpus.docs(spark, rows).columns
    # a third of all words, which is 4/3 of a's 50 rows, and two thirds, which is 8/9 of b's 150
    assert {r.source: r["count"] for r in got.groupBy("source").count().collect()} == {"a": 67, "b": 133}


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [])).count() == 0
