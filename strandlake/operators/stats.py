"""Statistics and evaluation: scaling, principal components, linear discriminant, histograms, confusion, F1, Dice."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def summary(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.max(value).alias("longest"), F.min(value).alias("shortest"), F.avg(value).alias("mean"))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float, density: bool = False) -> DataFrame:
    """(bin, cnt[, density]) of equal bins on the closed range [low, high]; the last bin holds its end."""
    w = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / w), F.lit(bins - 1)).cast("long")
    counted = df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    if not density:
        return counted
    total = counted.agg(F.sum("cnt").alias("_n"))
    return counted.join(F.broadcast(total)).withColumn("density", F.col("cnt") / (F.col("_n") * w)).drop("_n")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("cnt"))


def f1(df: DataFrame, truth: str, predicted: str, positive: int = 1) -> DataFrame:
    """precision, recall and f1 of the positive class; 0 where a denominator is 0."""
    t, p = F.col(truth) == positive, F.col(predicted) == positive
    n = lambda c: F.sum(c.cast("long"))
    s = df.agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def dice(scores: Column, truth: Column) -> Column:
    """2 I / (truth + predicted area) of a score array over five lengths of a region: I is the area of the central ``truth`` places."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    inner = F.aggregate(F.slice(scores, (2 * truth + 1).cast("int"), truth.cast("int")), F.lit(0.0), lambda a, x: a + x)
    return F.when(truth + total > 0, 2 * inner / (truth + total)).otherwise(F.lit(0.0))


class Scaler:
    """Column means and population deviations of a feature array; a constant column is only shifted."""

    def __init__(self, df: DataFrame, features: str = "features"):
        rows = df.select(F.posexplode(features)).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
        self.mean, self.std = [r.m for r in rows], [r.s or 1.0 for r in rows]

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        m, s = F.array(*map(F.lit, self.mean)), F.array(*map(F.lit, self.std))
        return df.withColumn(features, F.transform(features, lambda x, i: (x - m[i]) / s[i]))


def _sums(df: DataFrame, features: str, label: str | None = None) -> list:
    """(label, n, sum of x, sum of x xT) by class: partial sums of each batch in the map tasks, then one row for each class."""
    import pandas as pd

    def partial(frames):
        for f in frames:
            for k, part in f.groupby("k"):
                x = np.array(part["x"].tolist(), float)
                yield pd.DataFrame({"k": [k], "n": [len(x)], "s": [x.sum(0).tolist()], "q": [(x.T @ x).ravel().tolist()]})

    ready = df.select((F.col(label) if label else F.lit(0)).cast("int").alias("k"), F.col(features).alias("x"))
    parts = ready.mapInPandas(partial, "k int, n long, s array<double>, q array<double>")
    long = parts.select("k", "n", F.posexplode(F.concat("s", "q")))
    got = long.groupBy("k", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("v")).orderBy("k", "pos").collect()
    out = []
    for k in sorted({r.k for r in got}):
        rows = [r for r in got if r.k == k]
        v = np.array([r.v for r in rows])
        d = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
        out.append((k, rows[0].n, v[:d], v[d:].reshape(d, d)))
    return out


class Pca:
    """The components of a feature array that explain ``share`` of the variance; the moments are one distributed pass."""

    def __init__(self, df: DataFrame, features: str = "features", share: float = 0.85):
        ((_, n, s, q),) = _sums(df, features)
        self.mean = s / n
        cov = q / n - np.outer(self.mean, self.mean)
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        vectors = vectors * np.where(np.abs(vectors).max(0) == vectors.max(0), 1, -1)
        self.explained = values / max(values.sum(), 1e-300)
        self.k = int(np.searchsorted(np.cumsum(self.explained), share - 1e-12) + 1)
        self.vectors = vectors[:, : self.k]

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        return _projected(df, features, self.mean, self.vectors)


class Lda:
    """Linear discriminant of two classes: class means and pooled covariance in one pass, solved on the driver by a pseudo-inverse."""

    def __init__(self, df: DataFrame, features: str = "features", label: str = "target"):
        groups = _sums(df, features, label)
        total = sum(n for _, n, _, _ in groups)
        means = {k: s / n for k, n, s, _ in groups}
        within = sum(q - n * np.outer(s / n, s / n) for _, n, s, q in groups) / total
        self.mean = sum(s for _, _, s, _ in groups) / total
        (_, low), *_, (_, high) = sorted(means.items())
        w = np.linalg.pinv(within, rcond=1e-10, hermitian=True) @ (high - low)
        scale = np.sqrt(max(w @ within @ w, 1e-300))
        self.vectors = (w / scale)[:, None]

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        return _projected(df, features, self.mean, self.vectors)


def _projected(df: DataFrame, features: str, mean: np.ndarray, vectors: np.ndarray) -> DataFrame:
    shift = (mean @ vectors).tolist()
    columns = [F.array(*map(F.lit, v.tolist())) for v in vectors.T]
    dot = lambda c, b: F.aggregate(F.zip_with(features, c, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) - b
    return df.withColumn(features, F.array(*[dot(c, b) for c, b in zip(columns, shift)]))


def metric_summary(df: DataFrame, setting: str, metric: str) -> DataFrame:
    """Mean and population deviation of a metric for each setting."""
    return df.groupBy(setting).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def best(df: DataFrame, value: str, *columns: str) -> DataFrame:
    """The row with the greatest value, the first in the order of ``columns`` among equals."""
    return df.orderBy(F.col(value).desc(), *columns).limit(1).select(*columns, value)
