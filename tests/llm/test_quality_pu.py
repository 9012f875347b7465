import zlib

import numpy as np

from strandlake.llm import common, quality_pu, sampling


def test_features_are_total():
    for text in (None, b"", b" \n\t", b"a", "é ß\n\nÄ".encode(), b"x " * 50000, b"\xff\xfe"):
        x = quality_pu.features(text)
        assert len(x) == quality_pu.N_FEATURES and np.isfinite(x).all()
    assert quality_pu.features(None) == quality_pu.features(b"")


def test_risk_separates_without_negatives():
    rng = np.random.default_rng(5)
    p = rng.normal(1.5, 1, (800, 1))
    y = rng.random(3000) < 0.7
    u = np.where(y[:, None], rng.normal(1.5, 1, (3000, 1)), rng.normal(-1.5, 1, (3000, 1)))
    ones = lambda x: np.concatenate([x, np.ones((len(x), 1))], 1)
    x, half = ones(u), np.arange(len(u)) % 2
    part = lambda k: x if k is None else x[half == k]
    evaluate = lambda tasks: [quality_pu.sums(part(k), w) for w, k in tasks]
    above = lambda tasks: [np.append(((part(k) @ w)[:, None] >= at).sum(0), len(part(k))) for w, k, at in tasks]
    w, prior = quality_pu.fit(ones(p), evaluate, above)
    assert abs(prior - 0.7) < 0.08
    assert ((quality_pu.sigmoid(ones(u) @ w) >= 0.5) == y).mean() > 0.92


def test_held_out_accuracy_and_contract(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = quality_pu.quality(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    pos, neg = held[held.quality == 1].score, held[held.quality == 0].score
    assert (pos.to_numpy()[:, None] > neg.to_numpy()).mean() > 0.95
    assert (held.predicted == held.quality).mean() > 0.9
    again = quality_pu.quality(docs.repartition(3), labels.repartition(2)).toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score, atol=1e-9)


def test_held_out_labels_are_not_read(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(sampling.fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_pu.quality(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert a.equals(b)


def test_odd_rows(spark):
    rows = [(1, None, "positive", 1), (2, "", "x", 1), (2, "again", "x", 1), (None, "no id", "x", 1), (4, "w " * 20000, "x", 1), (4, "w " * 20000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = quality_pu.quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality_pu.quality(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality_pu.quality(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality_pu.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 6


def test_sums_over_the_cluster_equal_plain_ones(spark):
    """The Newton steps' sums, and the minimum of the risk against plain gradient descent on the same rows."""
    docs, labels = (common.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    model = quality_pu.train(docs.repartition(5), labels)
    marked = {r.doc_id for r in labels.collect() if r.quality == 1}
    learned = [(r.doc_id, r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x = model.shape.matrix(np.array([quality_pu.features((t or "").encode()) for _, t in learned]))
    p = x[[d in marked for d, _ in learned]]
    w = model.weights
    own = quality_pu.risk(p, model.prior)
    total = quality_pu.sums(x, w)
    own_at = lambda w, t: own(w, t[-1, 0] / len(x), t[:-1, -1] / len(x), t[:-1, :-1] / len(x))
    value, gradient, _ = own_at(w, total)
    assert total[-1, 1] == len(x) and total[-1, 0] / len(x) - model.prior * np.logaddexp(0, p @ w).mean() > -0.02
    v = quality_pu.descend(lambda w: own_at(w, quality_pu.sums(x, w))[1], x.shape[1], 300)
    assert value <= own_at(v, quality_pu.sums(x, v))[0] + 2e-3
