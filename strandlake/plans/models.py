"""Boundary classifiers on Spark ML: support vector machines with a linear or a Gaussian kernel, and their randomized search."""

from __future__ import annotations

import math
from collections.abc import Callable, Generator
from dataclasses import asdict

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import sampling
from strandlake.operators.lineage import cut
from strandlake.sources.config import Svm

FOURIER = 64
#: A fit reads its rows some hundred times, once for each step of its line searches: with fewer rows in a task, starting tasks is what costs.
ROWS_OF_A_TASK = 100_000


class SvmModel:
    """A linear support vector machine; the Gaussian kernel is approximated by random Fourier features, which are plain columns.

    ``tol`` is the solver's tolerance, ``C`` the inverse of its penalty per row, and the class weights are row weights.
    """

    def __init__(self, params: Svm, features: str = "features", label: str = "target", seed: int = 0):
        self.params, self.features, self.label, self.seed = params, features, label, seed

    def _inputs(self, df: DataFrame) -> DataFrame:
        x = F.col(self.features)
        if self.params.kernel == "rbf":
            dot = lambda w: F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            if len(self.waves[0]) <= 8:  # the same sum in the same order, in generated code
                dot = lambda w: sum((x[k] * v for k, v in enumerate(w)), F.lit(0.0))
            rows = [dot(w) + b for w, b in zip(self.waves, self.shifts)]
            x = F.array(*[F.cos(r) * math.sqrt(2 / FOURIER) for r in rows])
        return df.withColumn("_x", array_to_vector(x))

    def fit(self, df: DataFrame) -> SvmModel:
        y = F.col(self.label)
        size, rows, low, high = df.agg(F.max(F.size(self.features)), F.count(F.lit(1)), F.min(y), F.max(y)).first()  # one pass for all of them
        if self.params.kernel == "rbf":
            var = df.select(F.explode(self.features).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
            gamma = 1 / (size * var) if self.params.gamma == "scale" else 1 / size
            waves, shifts = _fourier(size, gamma, self.seed)
            self.waves, self.shifts = waves.tolist(), shifts.tolist()
        weight = F.lit(1.0)
        for k, w in self.params.class_weight.items():
            weight = F.when(F.col(self.label) == k, float(w)).otherwise(weight)
        self.only = int(low) if rows and low == high else None
        if self.only is not None:  # one class: nothing to part
            return self
        svc = LinearSVC(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1 / (max(self.params.C, 1e-9) * max(rows, 1)), tol=max(self.params.tol, 1e-6), maxIter=50, predictionCol="prediction", rawPredictionCol="_raw")
        inputs = self._inputs(df).select("_x", F.col(self.label).cast("double").alias("_y"), weight.alias("_w"))
        self.model = svc.fit(inputs.coalesce(max(1, math.ceil(rows / ROWS_OF_A_TASK))))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` (int) and ``score``, a logistic function of the decision value."""
        if self.only is not None:
            return df.withColumn("score", F.lit(float(self.only))).withColumn("prediction", F.lit(self.only))
        out = self.model.transform(self._inputs(df))
        raw = vector_to_array("_raw")[1]
        return out.withColumn("score", 1 / (1 + F.exp(-raw))).withColumn("prediction", F.col("prediction").cast("int")).drop("_x", "_raw")


def other_classifier(name: str, label: str = "target"):
    """An estimator of Spark ML on a vector column ``_x``, by name."""
    kinds = {"gaussian_nb": lambda **k: NaiveBayes(modelType="gaussian", **k), "logistic": LogisticRegression, "forest": RandomForestClassifier, "boosting": GBTClassifier}
    return kinds[name](featuresCol="_x", labelCol=label)


def candidates(n: int = 10, seed: int = 0) -> list[Svm]:
    """Random parameters: C in [1, 201], tol in [0, 0.1], both kernels and gammas, four maps of class weights.

    The shape of the decision function is drawn and kept too; with two classes it changes nothing.
    """
    rng = np.random.default_rng(seed)
    weights = [{0: 1.0, 1: 1.0}, {0: 1.0, 1: 2.0}, {0: 1.0, 1: 3.0}, {0: 2.0, 1: 1.0}]  # fixed values
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    return [Svm(C=float(1 + 200 * rng.random()), tol=float(0.1 * rng.random()), kernel=pick(["linear", "rbf"]), gamma=pick(["scale", "auto"]), class_weight=pick(weights), decision_function_shape=pick(["ovo", "ovr"])) for _ in range(n)]


#: Rows of a block that a search packs into one value, and of a task.
ROWS_OF_A_BLOCK, ROWS_OF_A_SEARCH_TASK = 10_000, 40_000


def _fourier(size: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    waves = rng.normal(size=(FOURIER, size)) * math.sqrt(2 * gamma)
    return waves, rng.uniform(0, 2 * math.pi, FOURIER)


def _minimised(x: np.ndarray, tol: float, steps: int = 50, memory: int = 10, tries: int = 12) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS with LinearSVC's bounds for an end; bisection for the weak Wolfe conditions, as the hinge loss has edges.

    Yields a point, is sent its value and gradient, returns the best point. So many of them can share a pass over the rows.
    """
    f, g = yield x
    first, values, pairs = abs(f), [f], []
    for step in range(steps):
        if np.linalg.norm(g) <= max(tol * abs(f), 1e-8):
            break
        d, kept = -g, []
        for s, y in reversed(pairs):
            kept.append((s @ d) / (y @ s))
            d = d - kept[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(kept)):
            d = d + s * (a - (y @ d) / (y @ s))
        slope = g @ d
        if slope >= 0:
            d, pairs, slope = -g, [], -(g @ g)
        a, low, high, found = (0.5 / np.linalg.norm(g) if step == 0 else 1.0), 0.0, math.inf, None
        for _ in range(tries):
            f2, g2 = yield x + a * d
            if f2 < f and (found is None or f2 < found[1]):
                found = (x + a * d, f2, g2)
            if f2 > f + a * slope * 1e-4:
                high = a
            elif g2 @ d < 0.9 * slope:
                low = a
            else:
                break
            a = (low + high) / 2 if high < math.inf else 2 * a
        if found is None:
            break
        s, y = found[0] - x, found[2] - g
        x, f, g = found
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        values.append(f)
        if max(values[-21:-1]) - f <= tol * first:
            break
    return x


class _Folds:
    """All fits of a search on one packed table: a pass over the rows gives the loss and the gradient of every fit that asks.

    Rows of equal features, label and fold are one with a weight, which changes no sum. Fits of the same random Fourier features share them.
    """

    def __init__(self, df: DataFrame, label: str, seed: int):
        rows = df.groupBy("features", F.col(label).cast("double").alias("y"), F.col("_fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        block = ROWS_OF_A_BLOCK

        def packed(batches):
            import pyarrow as pa

            for b in batches:
                for at in range(0, b.num_rows, block):
                    part = b.slice(at, block)
                    x = np.array(part.column(0).to_pylist(), float)
                    cells = [np.ascontiguousarray(v, float).tobytes() for v in (x, *(part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)))]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*cells, len(x))], names=["x", "y", "fold", "n", "rows"])

        rows = cut(rows)
        tasks = max(1, math.ceil(rows.count() / ROWS_OF_A_SEARCH_TASK))
        self.rows = cut(rows.repartition(tasks).mapInArrow(packed, "x binary, y binary, fold binary, n binary, rows long"))
        self.seed = seed

    def _pass(self, of: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of what ``of`` makes of (x, y, fold, n), an array of a fixed length."""

        def summed(batches):
            import pyarrow as pa

            total = None
            for b in batches:
                for r in b.to_pylist():
                    y, fold, n = (np.frombuffer(r[c]) for c in ("y", "fold", "n"))
                    got = of(np.frombuffer(r["x"]).reshape(r["rows"], -1), y, fold, n)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, float).tobytes()])], names=["v"])

        return sum(np.frombuffer(r.v) for r in self.rows.mapInArrow(summed, "v binary").collect())

    def scores(self, tried: list[Svm], folds: int) -> list[float]:
        """F1 of each of ``tried`` on each fold, of a fit on the others, in this order."""
        head = self.rows.first()
        if head is None:
            raise ValueError("a search needs rows")
        size = len(head.x) // 8 // head.rows
        of = lambda x, y, fold, n: np.array([[(m := n * (fold == k) * (y == c)).sum(), m @ x.sum(1), m @ (x * x).sum(1)] for k in range(folds) for c in (0, 1)]).ravel()
        sums = self._pass(of).reshape(folds, 2, 3)
        others = lambda k, v: sum(v[i] for i in range(folds) if i != k)

        maps, jobs = {"linear": None}, []
        for p in tried:
            for k in range(folds):
                n, s, q = others(k, sums.sum(1)) if folds > 1 else np.zeros(3)
                name = "linear"
                if p.kernel == "rbf":
                    var = max(q / (n * size) - (s / (n * size)) ** 2, 0.0) if n else 0.0
                    gamma = 1 / (size * (var or 1.0)) if p.gamma == "scale" else 1 / size
                    maps[name := gamma] = _fourier(size, gamma, self.seed)
                jobs.append({"params": p, "fold": k, "map": name, "weight": [float(p.class_weight.get(c, 1.0)) for c in (0, 1)]})
        root = math.sqrt(2 / FOURIER)

        def seen(name, x):
            return x if maps[name] is None else np.cos(x @ maps[name][0].T + maps[name][1]) * root

        def moments(x, y, fold, n):
            out = []
            for name in maps:
                z = seen(name, x)
                for k in range(folds):
                    for c in (0, 1):
                        m = n * (fold == k) * (y == c)
                        out += [[m.sum()], m @ z, m @ (z * z)]
            return np.concatenate(out)

        flat, at = self._pass(moments), 0
        stats_of = {}
        for name, m in maps.items():
            width = size if m is None else FOURIER
            stats_of[name] = flat[at : (at := at + folds * 2 * (1 + 2 * width))].reshape(folds, 2, -1)
        for j in jobs:
            width = size if maps[j["map"]] is None else FOURIER
            v = others(j["fold"], stats_of[j["map"]]) if folds > 1 else np.zeros((2, 1 + 2 * width))
            counts, c = v[:, 0], np.array(j["weight"])
            j["only"] = None if counts.min() > 0 else int(counts[1] > 0)
            j["sum"] = max(counts @ c, 1e-300)
            mean, square = c @ v[:, 1 : 1 + width] / j["sum"], c @ v[:, 1 + width :] / j["sum"]
            free = 1 - counts @ c**2 / j["sum"] ** 2
            std = np.sqrt(np.maximum(square - mean**2, 0) / free) if free > 0 else np.zeros(width)
            std[std <= 1e-9 * np.sqrt(np.maximum(square, 1e-300))] = 0  # a constant column
            j["mean"], j["inverse"] = mean, np.divide(1, std, out=np.zeros(width), where=std > 0)
            j["penalty"] = 1 / (max(j["params"].C, 1e-9) * max(counts.sum(), 1))

        def plane(j, point):
            w = point[:-1] * j["inverse"]
            return np.append(w, point[-1] - w @ j["mean"])

        def grouped(points):
            """By map: the indexes of fits, their planes as columns, folds and class weights."""
            out = {}
            for i in points:
                out.setdefault(jobs[i]["map"], []).append(i)
            return [(name, np.array([plane(jobs[i], points[i]) for i in own]).T, np.array([jobs[i]["fold"] for i in own]), np.array([jobs[i]["weight"] for i in own]), own) for name, own in out.items()]

        def evaluated(points):
            groups = [g[:4] for g in grouped(points)]

            def losses(x, y, fold, n):
                out, sign = [], (2 * y - 1)[:, None]
                for name, planes, own, weights in groups:
                    z = seen(name, x)
                    miss = 1 - sign * (z @ planes[:-1] + planes[-1])
                    w = n[:, None] * (fold[:, None] != own) * np.where(y[:, None] == 1, weights[:, 1], weights[:, 0]) * (miss > 0)
                    out += [(w * miss).sum(0)[:, None], -(w * sign).T @ z, -(w * sign).sum(0)[:, None]]
                return np.concatenate([v.ravel() for v in out])

            flat, at, got = self._pass(losses), 0, {}
            for _, planes, _, _, own in grouped(points):
                m, width = len(own), len(planes) - 1
                loss = flat[at : at + m]
                slopes = flat[at + m : at + m + m * width].reshape(m, width)
                offsets = flat[at + m + m * width : (at := at + m + m * width + m)]
                for i, f, gw, gb in zip(own, loss, slopes, offsets):
                    j, beta = jobs[i], points[i][:-1]
                    g = (gw - gb * j["mean"]) * j["inverse"] / j["sum"] + j["penalty"] * beta
                    got[i] = float(f / j["sum"] + j["penalty"] / 2 * (beta @ beta)), np.append(g, gb / j["sum"])
            return got

        runs = {i: _minimised(np.zeros(len(j["mean"]) + 1), max(j["params"].tol, 1e-6)) for i, j in enumerate(jobs) if j["only"] is None}
        asked, found = {i: next(r) for i, r in runs.items()}, {}
        while asked:
            got = evaluated(asked)
            for i in list(asked):
                try:
                    asked[i] = runs[i].send(got[i])
                except StopIteration as end:
                    found[i] = end.value
                    del asked[i]
        groups, constant = [g[:4] for g in grouped(found)], [(i, j["fold"], j["only"]) for i, j in enumerate(jobs) if j["only"] is not None]
        order = [i for g in grouped(found) for i in g[4]] + [i for i, _, _ in constant]

        def outcomes(x, y, fold, n):
            said = [(((seen(name, x) @ planes[:-1] + planes[-1]) > 0), own) for name, planes, own, _ in groups]
            said += [(np.full((len(y), 1), only == 1), np.array([k])) for _, k, only in constant]
            out = []
            for p, own in said:
                w = n[:, None] * (fold[:, None] == own)
                t = y[:, None] == 1
                out.append(np.array([(w * (t & p)).sum(0), (w * (~t & p)).sum(0), (w * (t & ~p)).sum(0)]).T)
            return np.concatenate(out).ravel()

        f1 = dict(zip(order, (2 * tp / d if (d := 2 * tp + fp + fn) > 0 else 0.0 for tp, fp, fn in self._pass(outcomes).reshape(-1, 3))))
        self.planes = {i: plane(jobs[i], v) for i, v in found.items()}
        return [float(f1[i]) for i in range(len(jobs))]


def search(df: DataFrame, n: int = 10, folds: int = 5, seed: int = 0, id: str = "id", label: str = "target") -> tuple[Svm, list[dict]]:
    """The parameters with the best mean F1 over the folds, and all results. Folds follow the ids; all fits take their steps in the same passes."""
    tried = candidates(n, seed)
    df = df.withColumn("_fold", F.pmod(sampling.arithmetic(F.col(id), seed), F.lit(folds)))
    scores = _Folds(df, label, 0).scores(tried, folds)
    results = [asdict(params) | {"f1": float(np.mean(scores[i * folds : (i + 1) * folds]))} for i, params in enumerate(tried)]
    return tried[max(range(len(tried)), key=lambda k: (results[k]["f1"], -k))], results
