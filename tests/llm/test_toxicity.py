import zlib

import numpy as np

from filmcrate.llm import toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n = label.sum()
    return (rank[label == 1].mean() - (n - 1) / 2) / (len(label) - n)


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.op1_ftrl_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    score, predicted, label = map(np.array, zip(*held, strict=True))
    assert auc(score, label) > 0.9
    assert label[predicted == 1].mean() > 0.8 and predicted[label == 1].mean() > 0.6


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "you idiot", 9.0), (2, "", 9.0), (4, "w " * 200000, 9.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score_documents(docs, toxicity.train(docs, none)).collect()
    assert len(out) == 5 and {r["predicted"] for r in out} == {0}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    assert len(toxicity.score_documents(docs, toxicity.train(docs, one)).collect()) == 5
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


def test_weights_are_sparse_and_the_sample_is_bounded():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) + (" vile" if i % 4 == 0 else "") for i in range(600)]
    model = toxicity.fit(toxicity.feature_sets(texts), np.array([float(i % 4 == 0) for i in range(600)]))
    assert len(model.index) < 200
    assert (model.scores(["alpha beta vile", "alpha beta gamma"]) >= 0.5).tolist() == [True, False]
