"""Sequence functions, windows, sampling and statistics against plain Python and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import kmers, segments
from strandlake.operators import relational, sampling, stats, windows


def entropies(s):
    n = [s.count(k) for k in kmers.vocabulary()]
    p = [x / max(sum(n), 1) for x in n]
    return [-x * math.log(x, 4) if x else 0.0 for x in p]


SEQS = ["", "N", "AAA", "ACGTACGT", "acgt", "TTTTTTTTT", "ACGNNACG", "".join(random.Random(1).choice("ACGTN") for _ in range(500))]


def test_vocabulary_and_counts(spark):
    assert len(set(kmers.vocabulary())) == 84
    df = spark.createDataFrame([(k, s) for k, s in enumerate(SEQS)], "id long, seq string")
    got = {(r.id, r.kmer): r for r in kmers.long_form(df, "id").collect()}
    for k, s in enumerate(SEQS):
        for sign, h in zip(kmers.vocabulary(), entropies(s)):
            assert got[k, sign].cnt == s.count(sign) and abs(got[k, sign].entropy - h) < 1e-12
        total = sum(got[k, x].frequency for x in kmers.vocabulary())
        assert abs(total - 1) < 1e-9 or total == 0
    assert max(r.entropy for r in got.values()) <= 0.2655
    wide = kmers.feature_table(df, ["id"]).select("id", "features", kmers.vectorised_features()(F.lit("ACGTACGT")).alias("v")).collect()
    for r in wide:
        assert np.allclose(r.features, entropies(SEQS[r.id])) and np.allclose(r.v, entropies("ACGTACGT"))
    assert kmers.long_form(df, "id", upper=True).where("id = 4 AND kmer = 'A'").first().cnt == 1


def test_segments(spark):
    df = spark.createDataFrame([("ACGTACGTAC", 5, 7, 2)], "seq string, start long, stop long, off long")
    r = segments.with_context(df, 10, F.col("off")).first()
    assert [k for k, b in enumerate(r["mask"]) if b] == [1, 2, 3] and r.segment == "ACGTACGTAC"[2:]
    r = segments.with_context(df, 10, F.lit(0)).first()
    assert len(r["mask"]) == 10 and [k for k, b in enumerate(r["mask"]) if b] == [0, 1]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    ones = F.array(*map(F.lit, [0, 1, 1, 0, 1]))
    assert one(segments.bracketed(F.lit("ACGTA"), ones)) == "A[CG]T[A]"
    with pytest.raises(Exception, match="differ in length"):
        one(segments.bracketed(F.lit("AC"), ones))
    assert one(segments.one_hot(F.lit("AT"))) == [[1, 0, 0, 0], [0, 0, 0, 1]]
    with pytest.raises(Exception, match="outside the alphabet"):
        one(segments.one_hot(F.lit("ANT")))
    assert one(segments.padded_codes(F.lit("GA"), 4)) == [0, 0, 3, 1] and one(segments.padded_codes(F.lit("ACGTA"), 2)) == [4, 1]
    pre, after = segments.halves(F.lit(201))
    assert (one(pre), one(after)) == (399, 400)
    assert one(segments.zero_mask(3)) == [0, 0, 0]
    scores = [0.0, 1.0, 0.5]
    assert np.allclose(one(segments.resampled(F.array(*map(F.lit, scores)), 4)), np.interp(range(9), [0, 4, 8], scores))
    assert one(segments.min_max(F.array(F.lit(-1.0), F.lit(1.0), F.lit(3.0)))) == [0, 1 / 3, 1] and one(segments.min_max(F.array(F.lit(2.0)))) == [0]


def test_windows(spark):
    seq = "".join(random.Random(2).choice("ACGT") for _ in range(80))
    contigs = spark.createDataFrame([(1, seq)], "seqid long, seq string")
    regions = spark.createDataFrame([(7, 1, 10, 20)], "id long, seqid long, s long, e long")
    got = {(r.pos, r.window): r["sub"] for r in windows.scan(regions, contigs, [25, 4], 5).collect()}
    want = {(p, w): seq[max(0, p - w // 2) : max(0, p + w // 2)] for p in range(-10, 40, 5) for w in (25, 4)}
    assert got == want and len(got[30, 25]) == 24


def test_sampling(spark):
    df = spark.range(1000).withColumn("target", (F.col("id") % 10 == 0).cast("int"))
    for by, share in ((["target"], 0.7), ([], 0.8)):
        a = sampling.split(df, share, by, 42)
        b = sampling.split(df.repartition(7), share, by, 42)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        assert a.where("fold = 'train'").count() == round(1000 * share)
    assert sampling.split(df, 0.7, ["target"], 42).where("fold = 'train' AND target = 1").count() == 70
    sizes = [r["count"] for r in sampling.batches(df, 128, 1).groupBy("batch").count().collect()]
    assert sorted(sizes) == [104] + [128] * 7
    r = sampling.random_intervals(spark, 4000).selectExpr("min(s) a", "max(s) b", "avg(e - s) m", "min(e - s) n").first()
    assert r.a >= 1e4 and r.b < 2e8 and 390 < r.m < 440 and r.n >= 16
    drawn = sampling.with_replacement(relational.numbered(df, ["id"]), 50, 1)
    assert drawn.count() == 50


def test_statistics(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + y[:, None] * [2, 0, 1, 0]
    df = spark.createDataFrame([(k, int(t), v.tolist()) for k, (t, v) in enumerate(zip(y, x))], "id long, target int, features array<double>")
    scaler = stats.Scaler(df)
    z = (x - x.mean(0)) / x.std(0)
    scaled = scaler.transform(df)
    assert np.allclose([r.features for r in scaled.orderBy("id").collect()], z)
    pca = stats.Pca(scaled)
    values = np.linalg.eigvalsh(np.cov(z.T, bias=True))[::-1]
    assert np.allclose(pca.explained, values / values.sum()) and pca.k == np.searchsorted(np.cumsum(values / values.sum()), 0.85) + 1
    lda = stats.Lda(scaled)
    d = np.array([r.features[0] for r in lda.transform(scaled).orderBy("id").collect()])
    within = sum((z[y == k] - z[y == k].mean(0)).T @ (z[y == k] - z[y == k].mean(0)) for k in (0, 1)) / len(y)
    w = np.linalg.solve(within, z[y == 1].mean(0) - z[y == 0].mean(0))
    assert abs(np.corrcoef(d, z @ w)[0, 1]) > 1 - 1e-9 and d[y == 1].mean() > d[y == 0].mean()
    values = spark.createDataFrame([(float(v),) for v in [0, 1, 1.5, 9.99, 10]], "v double")
    assert {r.bin: r.cnt for r in stats.histogram(values, "v", 10, 0, 10).collect()} == {0: 1, 1: 2, 9: 2}
    pairs = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "t int, p int")
    r = stats.f1(pairs, "t", "p").first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and abs(r.f1 - 2 / 3) < 1e-12
    assert stats.f1(pairs.where("t = 0 AND p = 0"), "t", "p").first().f1 == 0


def test_numbering_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 7)
    got = {r.id: r.row_id for r in relational.numbered(df.repartition(5), ["k", "id"]).collect()}
    order = sorted(range(500), key=lambda i: (i % 7, i))
    assert got == {i: n for n, i in enumerate(order)}


def test_fixed_decimals_are_those_of_the_binary_value(spark):
    rng = random.Random(5)
    values = [0.2975, 0.0625, 0.1875, 0.3125, 0.9995, 0.9996, 2.5, 3.5, -0.0, -0.0001, -1.2345, 5e-324, 0.0005, 123456789.0005, 2.0**52 + 1, 2.0**62, 1e15 + 0.125]
    values += [rng.randrange(1, 10**7) * 10.0 ** -rng.randrange(3, 6) + 0.0005 for _ in range(2000)] + [rng.random() * 10.0 ** rng.randrange(-5, 15) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan"), float("-inf"), None]], "x double")
    out = df.select("x", *[relational.fixed(F.col("x"), k).alias(f"d{k}") for k in (0, 1, 3, 4)]).collect()
    for r in out:
        if r.x is not None and math.isfinite(r.x):
            assert (r.d0, r.d1, r.d3, r.d4) == tuple(f"{r.x:.{k}f}" for k in (0, 1, 3, 4)), r
    assert [r.d3 for r in out[-3:]] == ["nan", "-inf", None]


def test_split_sizes_are_exact_and_no_row_is_lost(spark):
    def rows(n, kind, first=0):
        return [(first + k, kind) for k in range(n)]

    data = rows(45, "a") + rows(85, "b", 100) + rows(15, "c", 1000) + rows(10, None, 2000) + [(None, "d")] + rows(4, "d", -9)
    out = sampling.split(spark.createDataFrame(data, "id long, kind string"), 0.7, ["kind"], 42).collect()
    train = {k: sum(r.kind == k and r.fold == "train" for r in out) for k in ("a", "b", "c", None, "d")}
    assert sorted(map(str, ((r.id, r.kind) for r in out))) == sorted(map(str, data))
    assert train == {"a": 32, "b": 60, "c": 11, None: 7, "d": 4}
    assert next(r.fold for r in out if r.id is None) == "test"
