import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemill.llm import language_id, quality, queries


def test_languages_are_told_apart_on_rows_not_learned_from(spark, documents):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"])
    held = got.merge(truth, on="doc_id").query("held_out")
    assert len(got) == len(truth) and held.lang_pred.eq(held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_ftrl_leaves_most_weights_zero_and_temperature_fits():
    rng = np.random.default_rng(1)
    rows = [(y, np.array([y, 10 + int(rng.integers(90))], np.int32), np.array([3, 1])) for y in rng.integers(0, 2, 200)]
    w = language_id.fit_ftrl(rows, 2, np.ones(language_id.PLACES))
    assert (w != 0).sum() < 400 and w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    logits = [np.array([4.0, 0.0])] * 60 + [np.array([0.0, 4.0])] * 40
    assert language_id.fit_temperature(logits, [0] * 60 + [0] * 40) > 1.5


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    got = {(r["doc_id"], r["text"]): r for r in language_id.identify(odd_docs, model).collect()}
    assert language_id.identify(odd_docs, model).count() == odd_docs.count()
    for key in [(3, None), (4, ""), (5, "   \n\t "), (8, "!!! ??? 123")]:
        assert got[key]["lang_pred"] == "und" and got[key]["score"] == 0.0
    empty = language_id.fit(no_docs)
    assert empty.languages == [] and language_id.identify(no_docs, empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, empty).collect()} == {"und"}


def test_quality_on_rows_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_quality(spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    held = got.merge(labels, on="doc_id").query("held_out")
    assert held.predicted.eq(held.quality).mean() > 0.9 and got.score.between(0, 1).all()


def test_discriminant_equals_a_plain_one(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (300, quality.SIZE)), rng.normal(1, 2, (200, quality.SIZE))])
    y = [0] * 300 + [1] * 200
    df = spark.createDataFrame([(r.tolist(), c) for r, c in zip(x, y)], "stats array<double>, label int")
    sums = {c: (float((np.array(y) == c).sum()), x[np.array(y) == c].sum(0), x[np.array(y) == c].T @ x[np.array(y) == c]) for c in (0, 1)}
    a, b = quality.fit(df), quality.model_from_sums(sums)
    assert np.allclose(a.scores(x), b.scores(x), atol=1e-9)
    cov = [np.linalg.inv(f @ f.T) for f in b.factors]
    d = [(o - 0.5 * np.einsum("ij,jk,ik->i", x - m, s, x - m)) for o, m, s in zip(b.offsets, b.means, cov)]
    assert np.allclose(b.scores(x), 1 / (1 + np.exp(np.clip(d[0] - d[1], -50, 50))))


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    measured = quality.with_statistics(odd_docs)
    assert measured.count() == odd_docs.count()
    one_class = quality.fit(measured.withColumn("label", F.lit(1)))
    assert {r["score"] for r in quality.score(measured, one_class).collect()} == {1.0}
    nothing = quality.fit(quality.with_statistics(no_docs).withColumn("label", F.lit(None).cast("int")))
    assert {r["score"] for r in quality.score(measured, nothing).collect()} == {0.5}
    assert quality.score(quality.with_statistics(no_docs), nothing).count() == 0
