"""Quality by positive-unlabelled learning: the non-negative unbiased risk with an estimated class prior.

Positives are labelled rows of quality 1 outside the held-out fold, a bounded sample of them (``POSITIVES``) drawn by a hash of the id, so a
rerun draws the same. The unlabelled side is web text as it comes: all rows outside that fold. Rows labelled 0 are never used as such.

A first model tells positives from unlabelled rows; the class prior is the least ratio of the two sides' shares above any of its
scores (with a margin for small counts, on halves that it wasn't fitted to). The final model minimises

    prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior * loss(positives as 0))

with the logistic loss, for which the sum within is convex. Each Newton step reads the sums over all unlabelled rows' features, which are
saved once; where the second part would fall below zero, a steep square takes its place. The sigmoid of the model is the score.

Inputs are shape features of the whole text only (characters by class, repeats, lengths), each as a value and as quantile bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common, sampling

POSITIVES = 12_000
HELD_OUT = 1
FOLDS = 3
BINS = 12
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASSES = [b" \t\r\x0b\x0c", b"\n", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>~^=+@_", b"|", b"!", b".,;:?", b"{}[]()/\\\"'`-"]
_CLASS = np.full(256, len(_CLASSES) + 1, np.intp)
_CLASS[:128] = len(_CLASSES)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _k
N_FEATURES = 15


def features(text: bytes | None) -> list[float]:
    """Shape of a text; a null one counts as empty."""
    text = text or b""
    words = text.split()
    n = len(words)
    _, ends, upper, lower, digits, marks, bars, calls, stops, braces, control, beyond = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 2).tolist()
    lines = [x for x in text.split(b"\n") if x.strip()]
    some, letters, chars = max(n, 1), max(upper + lower + beyond, 1), max(len(text), 1)
    folded = len(set(words)) / some
    return [
        np.log1p(n), marks / some, upper / letters, bars / some, calls / some, sum(map(eq, words, islice(words, 1, None))) / some, folded, folded * np.log1p(n),
        1 - len(set(lines)) / max(len(lines), 1), (len(text) - ends) / some, stops / some, digits / chars, braces / some, beyond / chars, ends / some,
    ]


CUTS = [*np.linspace(0, 1, BINS + 1)[1:-1].tolist(), 0.97, 0.99]


class Shape:
    """Scaling and quantile bins of the unlabelled rows' features."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, quantiles: list[np.ndarray]):
        self.mean, self.std = mean, np.where(std > 0, std, 1)
        self.edges = [np.unique(q) for q in quantiles]
        self.size = len(mean) + 1 + sum(map(len, self.edges))

    def matrix(self, x: np.ndarray) -> np.ndarray:
        parts = [np.clip((x - self.mean) / self.std, -4, 4), np.ones((len(x), 1))]
        for k, edges in enumerate(self.edges):
            parts.append((x[:, k : k + 1] > edges).astype(float))
        return np.concatenate(parts, 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One matrix of sums over rows: the second derivatives of the loss as 0, beside them its gradient; below, the loss and the rows."""
    z = x @ w
    s = sigmoid(z)
    last = np.zeros(len(w) + 1)
    last[:2] = np.logaddexp(0, z).sum(), len(x)
    return np.vstack([np.column_stack([(x * (s * (1 - s))[:, None]).T @ x, x.T @ s]), last])


def minimise(evaluate, own: list, size: int, passes: int = 40) -> list[np.ndarray]:
    """Damped Newton steps for several risks side by side.

    ``evaluate(weights)`` gives the ``sums`` of the unlabelled rows for each risk; ``own[k](w, loss, gradient, second)`` adds the positives'
    part to their means. A step that makes nothing better is halved.
    """
    trial = [np.zeros(size) for _ in own]
    best: list = [None] * len(own)
    step, way, done = [1.0] * len(own), [np.zeros(size)] * len(own), [False] * len(own)
    for _ in range(passes):
        for k, total in enumerate(evaluate(trial)):
            if done[k]:
                continue
            n = max(total[-1, 1], 1)
            value, gradient, second = own[k](trial[k], total[-1, 0] / n, total[:-1, -1] / n, total[:-1, :-1] / n)
            if best[k] is None or value <= best[k][0] + 1e-13:
                done[k] = best[k] is not None and best[k][0] - value < 1e-12
                best[k], step[k], way[k] = (value, trial[k]), 1.0, np.linalg.solve(second, gradient)
            else:
                step[k] /= 2
                done[k] = step[k] < 1e-4
            trial[k] = best[k][1] - step[k] * way[k]
        if all(done):
            break
    return [b[1] for b in best]


def apart(p: np.ndarray, penalty: float = 1e-3):
    """The risk of telling positives from unlabelled rows."""

    def own(w, loss, gradient, second):
        z = p @ w
        s = sigmoid(z)
        value = loss + np.logaddexp(0, -z).mean() + penalty / 2 * w @ w
        return value, gradient - p.T @ (1 - s) / len(p) + penalty * w, second + (p * (s * (1 - s))[:, None]).T @ p / len(p) + penalty * np.eye(len(w))

    return own


def risk(p: np.ndarray, pi: float, penalty: float = 0.03, bound: float = 1e2):
    """The unbiased risk; its part without the positives' as ones is held from below zero by a steep square."""

    def own(w, loss, gradient, second):
        z = p @ w
        s = sigmoid(z)
        rest = loss - pi * np.logaddexp(0, z).mean()
        below, way = min(0.0, rest), gradient - pi * p.T @ s / len(p)
        value = pi * np.logaddexp(0, -z).mean() + rest + bound / 2 * below**2 + penalty / 2 * w @ w
        second = second + penalty * np.eye(len(w)) + (bound * np.outer(way, way) if below else 0)
        return value, gradient - pi * p.mean(0) + bound * below * way + penalty * w, second

    return own


def cuts(p: np.ndarray) -> np.ndarray:
    """Scores at which shares are compared; at least half of the positives stay above: smaller shares are noise."""
    return np.quantile(p, np.linspace(0.02, 0.5, 49))


def prior(p: np.ndarray, at: np.ndarray, above: np.ndarray, n: float) -> float:
    """The class prior of ``n`` rows, ``above`` of which lie above each cut: the least upper bound on their share by that of ``p``."""
    a, b = above / max(n, 1), (p[:, None] >= at).mean(0)
    slack = np.sqrt(np.log(40) / (2 * max(n, 1))) + np.sqrt(np.log(40) / (2 * len(p)))
    best = int(np.argmin((a + slack) / np.maximum(b, 1e-9)))
    return float(np.clip(a[best] / b[best], 0.05, 0.98))


def fit(p: np.ndarray, evaluate, above) -> tuple[np.ndarray, float]:
    """Weights and class prior from the positives' matrix and what is summed over the unlabelled rows.

    ``evaluate([(w, half), ...])``: ``sums`` of the rows of a half (None: all); ``above([(w, half, cuts), ...])``: rows above each cut and all.
    """
    size = p.shape[1]
    halves = [p[k::2] if len(p) > 1 else p for k in range(2)]
    first = minimise(lambda ws: evaluate([(w, k) for k, w in enumerate(ws)]), [apart(x) for x in halves], size)
    at = [cuts(halves[1 - k] @ first[k]) for k in range(2)]  # on rows not fitted to
    counted = above([(first[k], 1 - k, at[k]) for k in range(2)])
    pi = float(np.mean([prior(halves[1 - k] @ first[k], at[k], c[:-1], c[-1]) for k, c in enumerate(counted)]))
    return minimise(lambda ws: evaluate([(ws[0], None)]), [risk(p, pi)], size)[0], pi


class Model:
    """What scoring needs; a few hundred numbers whatever the size of the corpus."""

    def __init__(self, shape: Shape | None = None, weights: np.ndarray | None = None, pi: float = 0.5):
        self.shape, self.weights, self.prior = shape, weights, pi

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.shape is None else sigmoid(self.shape.matrix(x) @ self.weights)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64()))], names=["x"])


_PART = "task int, row int, numbers binary"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            column = batch.column("x")
            yield column.flatten().to_numpy().reshape(-1, N_FEATURES), batch.column("half").to_numpy()


def _added(df: DataFrame) -> dict[int, np.ndarray]:
    """Adds up the parts' rows of numbers, side by side on the executors; a fixed number of rows comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for task, row, raw in zip(batch.column("task").to_pylist(), batch.column("row").to_pylist(), batch.column("numbers")):
                v = np.frombuffer(raw.as_py(), "<f8")
                held[task, row] = held[task, row] + v if (task, row) in held else v
        for (task, row), v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([row], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["task", "row", "numbers"])

    got = sorted(df.repartition(16, "task", "row").mapInArrow(add, _PART).collect(), key=lambda r: (r.task, r.row))
    return {t: np.stack([np.frombuffer(r.numbers, "<f8") for r in got if r.task == t]) for t in {r.task for r in got}}


def _summed(vectors: DataFrame, shape: Shape, tasks: list, each) -> list[np.ndarray]:
    """For each task (weights, half or None, ...) the sum over its rows of ``each(matrix, task)``."""
    held = vectors.sparkSession.sparkContext.broadcast((shape, tasks))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, tasks = held.value
        total = [0.0] * len(tasks)
        for x, half in _matrices(batches):
            m = shape.matrix(x)
            for k, task in enumerate(tasks):
                total[k] = total[k] + each(m if task[1] is None else m[half == task[1]], task)
        for k, t in enumerate(total):
            if not np.isscalar(t):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(t), pa.int32()), pa.array(range(len(t)), pa.int32()), pa.array([r.tobytes() for r in t], pa.binary())], names=["task", "row", "numbers"])

    got = _added(vectors.mapInArrow(rows, _PART))
    return [got[k] for k in range(len(tasks))]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample of labelled positives outside the held-out fold, and on all text outside it as the unlabelled side."""
    usable = sampling.one_label(labels, "quality").where((F.col("label") == 1) & (sampling.fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    bound = sampling.share(usable.count(), POSITIVES)
    chosen = usable.where(sampling.place(F.col("doc_id"), 7) < bound).select("doc_id")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(sampling.fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    got = rows.join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(_vectors, "x array<double>").limit(8 * POSITIVES + 1).toPandas()
    if len(got) > 8 * POSITIVES:
        raise ValueError("far more rows than ids are labelled: ids are repeated too often to learn from")
    p = np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES)
    vectors = common.saved(rows.select("text").mapInArrow(_vectors, "x array<double>").withColumn("half", F.pmod(F.xxhash64("x"), F.lit(2)).cast("int")), "quality-features")
    of = [F.col("x")[k] for k in range(N_FEATURES)]
    r = vectors.agg(F.count(F.lit(1)), *[F.avg(c) for c in of], *[F.stddev_pop(c) for c in of], *[F.percentile_approx(c, CUTS, 10_000) for c in of]).first()
    if not len(p) or not r[0]:
        return Model()
    mean, std, quantiles = (r[1 + k * N_FEATURES : 1 + (k + 1) * N_FEATURES] for k in range(3))
    shape = Shape(np.array(mean), np.array(std), [np.array(q) for q in quantiles])
    p = shape.matrix(p[np.lexsort(p.T)])  # sums then don't depend on the order of rows

    def above(tasks: list) -> list[np.ndarray]:
        count = lambda m, t: np.append(((m @ t[0])[:, None] >= t[2]).sum(0), len(m)).astype(float)[None]
        return [x[0] for x in _summed(vectors, shape, tasks, count)]

    weights, pi = fit(p, lambda tasks: _summed(vectors, shape, tasks, lambda m, t: sums(m, t[0])), above)
    return Model(shape, weights, pi)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of whole texts. A null text is scored as an empty one; every row is scored for itself, whatever shares its id."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], float).reshape(-1, N_FEATURES)
            s = held.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (sampling.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return ready.mapInArrow(rows, SCHEMA)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Without labelled positives or text to learn from, each score is 0.5."""
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only()
        for batch in batches:
            text = (t.as_py() for t in batch.column("text"))
            x = np.array([features(t.encode() if t is not None else None) for t in text], float).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(held.value.score(x) >= 0.5))

    return docs.mapInArrow(rows, docs.schema)
