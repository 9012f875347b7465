"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other; each link is a logistic regression on the document's terms and on the probabilities of
the categories before it. While a link is trained, those probabilities come from models that were not fitted to the row (out of fold);
when a document is scored, they are the chain's own.

Terms are the words of the whole text in lower case, and the beginnings of words at ``STEMS`` lengths, so that inflected or compounded
forms of a word share evidence. Of a bounded sample of labelled rows (``SAMPLE``), all terms are counted by label, and the ``TERMS``
terms that stand out most form the inputs; nothing else of the corpus is gathered. What is lost by the bound are terms of weaker evidence.

The categories are the given label columns, in their order. Where there is one alone, the chain's categories are severities of it
(``CATEGORIES``), told by the number of words that occur among toxic rows above all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common, sampling
from strandlake.llm.decontaminate import split
from strandlake.llm.quality_pu import descend, sigmoid

SAMPLE = 16_000
TERMS = 1500
STEMS = (4, 6, 8)
FOLDS = 5
#: Words that a worker remembers the terms of.
REMEMBER = 500_000
#: Categories in the order of the chain, milder ones last: a document labelled toxic with that many toxic words at least.
CATEGORIES = {"severe": 4, "repeated": 2, "toxic": 0}
#: A term counts as toxic if its rate among toxic rows is so many times that among the others.
TIMES = 20


def terms(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


class Bag:
    """Counts of known terms of texts, as sparse rows; the terms of a word are remembered."""

    def __init__(self, known: list[bytes]):
        self.known = {t: k for k, t in enumerate(known)}
        self.of: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"known": self.known, "of": {}}

    def rows(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, log of 1 + count), for the terms that occur."""
        of, known = self.of, self.known
        row, col, val = [], [], []
        for r, text in enumerate(texts):
            words = split(text)
            found = list(map(of.get, words))
            if None in found:
                if len(of) > REMEMBER:
                    of.clear()
                for k, x in enumerate(found):
                    if x is None:
                        w = words[k]
                        found[k] = of[w] = tuple(known[t] for t in terms(w) if t in known)
            for term, n in Counter(t for x in found if x for t in x).items():
                row.append(r)
                col.append(term)
                val.append(np.log1p(n))
        return np.array(row, np.int64), np.array(col, np.int64), np.array(val, float)


def _linear(x, n: int, w: np.ndarray) -> np.ndarray:
    row, col, val = x
    return np.bincount(row, val * w[col], n) if len(row) else np.zeros(n)


def fit_linear(x, extra: np.ndarray, y: np.ndarray, terms: int, penalty: float = 3e-4, steps: int = 150) -> np.ndarray:
    """Logistic regression on sparse terms, dense extra inputs and a constant."""
    row, col, val = x
    n, more = extra.shape

    def gradient(w: np.ndarray) -> np.ndarray:
        d = (sigmoid(_linear(x, n, w) + extra @ w[terms : terms + more] + w[-1]) - y) / n
        g = np.concatenate([np.bincount(col, val * d[row], terms) if len(row) else np.zeros(terms), extra.T @ d, [d.sum()]])
        g[:-1] += penalty * w[:-1]
        return g

    return descend(gradient, terms + more + 1, steps, 0.15)


class Chain:
    """The links in order: weights of terms, of the probabilities before, and a constant."""

    def __init__(self, x, labels: np.ndarray, terms: int, fold: np.ndarray):
        n, self.terms = len(labels), terms
        self.links: list[np.ndarray] = []
        before = np.zeros((n, 0))
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(float)
            self.links.append(fit_linear(x, before, y, terms) if n else np.zeros(terms + k + 1))
            if k + 1 < labels.shape[1]:
                before = np.concatenate([before, self._out_of_fold(x, before, y, fold)[:, None]], 1)

    def _out_of_fold(self, x, before: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        row, col, val = x
        out = np.zeros(len(y))
        for f in range(FOLDS):
            fitted = np.flatnonzero(fold != f)
            place = np.full(len(y), -1)
            place[fitted] = np.arange(len(fitted))
            keep = place[row] >= 0 if len(row) else np.zeros(0, bool)
            w = fit_linear((place[row[keep]], col[keep], val[keep]), before[fitted], y[fitted], self.terms)
            at = np.flatnonzero(fold == f)
            out[at] = self._apply(x, len(y), before, w)[at]
        return out

    def _apply(self, x, n: int, before: np.ndarray, w: np.ndarray) -> np.ndarray:
        return sigmoid(_linear(x, n, w) + before @ w[self.terms : self.terms + before.shape[1]] + w[-1])

    def probabilities(self, x, n: int) -> np.ndarray:
        before = np.zeros((n, 0))
        for w in self.links:
            before = np.concatenate([before, self._apply(x, n, before, w)[:, None]], 1)
        return before


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            found = sorted({t for w in set(split(batch.column("text")[k].as_py())) for t in terms(w)})
            own = batch.column("labels")[k].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([own] * len(found), pa.list_(pa.int32()))], names=["term", "labels"])


class Model:
    def __init__(self, bag: Bag, chain: Chain, categories: list[str]):
        self.bag, self.chain, self.categories = bag, chain, categories

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return self.chain.probabilities(self.bag.rows(texts), len(texts))


def train(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("toxic",), held_out: int | None = None) -> Model:
    """Fits the chain on a bounded sample of labelled rows; ``held_out``: a fold of crc32(doc_id) modulo 3 that isn't learned from.

    Rows labelled in the last of ``columns`` are learned from; where another column has no label for such a row, it counts as 0.
    """
    names = list(columns) if len(columns) > 1 else list(CATEGORIES)
    usable = sampling.one_label(labels, columns[-1]).withColumnRenamed("label", "_last")
    if held_out is not None:
        usable = usable.where(sampling.fold(F.col("doc_id"), 3) != held_out)
    bound = sampling.share(usable.count(), SAMPLE)
    chosen = usable.where(sampling.place(F.col("doc_id"), 23) < bound)  # about SAMPLE ids, by their hashes
    for k, column in enumerate(columns[:-1]):
        chosen = chosen.join(sampling.one_label(labels, column).withColumnRenamed("label", f"_{k}"), "doc_id", "left")
    chosen = chosen.select("doc_id", F.array(*[F.coalesce(f"_{k}", F.lit(0)) for k in range(len(columns) - 1)], F.col("_last")).alias("labels"))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "labels").agg(F.min("text").alias("text"))  # of rows that share an id, the least text is learned from
    rows = common.saved(rows, "toxic-sample")
    of = [F.coalesce(F.sum(F.col("labels")[k]), F.lit(0)).alias(f"y{k}") for k in range(len(columns))]
    counted = rows.mapInArrow(_terms_of, "term binary, labels array<int>").groupBy("term").agg(F.count(F.lit(1)).alias("n"), *of).where("n >= 4")
    total = rows.agg(F.count(F.lit(1)).alias("n"), *of).first()
    shares = [total[f"y{k}"] / max(total.n, 1) for k in range(len(columns))]
    if not 0 < shares[-1] < 1:
        return Model(Bag([]), Chain((np.zeros(0, np.int64),) * 3, np.zeros((0, len(names))), 0, np.zeros(0)), names)
    z = [F.abs((F.col(f"y{k}") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))) for k, p in enumerate(shares) if 0 < p < 1]
    best = counted.withColumn("z", F.greatest(*z) if len(z) > 1 else z[0]).orderBy(F.col("z").desc(), "term").limit(TERMS).collect()
    bag = Bag([bytes(r.term) for r in best])
    toxic = total[f"y{len(columns) - 1}"]
    rate = lambda r, y: (y / toxic) / ((r.n - y + 0.5) / (total.n - toxic))
    marked = {k for k, r in enumerate(best) if rate(r, r[f"y{len(columns) - 1}"]) > TIMES and bytes(r.term)[-1:] != b"*"}

    held = rows.sparkSession.sparkContext.broadcast(bag)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            row, col, val = held.value.rows(texts)
            edge = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(edge, pa.array(v)) for v in (col, val)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("labels"), *lists], names=["doc_id", "labels", "col", "val"])

    got = rows.mapInArrow(sparse, "doc_id long, labels array<int>, col array<long>, val array<double>").toPandas().sort_values("doc_id")
    sizes = got["col"].map(len).to_numpy()
    x = (np.repeat(np.arange(len(got)), sizes), np.concatenate([*got["col"], np.zeros(0)]).astype(np.int64), np.concatenate([*got["val"], np.zeros(0)]))
    y = np.array(got["labels"].tolist()).reshape(-1, len(columns)) > 0
    if len(columns) == 1:
        hits = np.bincount(x[0], np.expm1(x[2]) * np.isin(x[1], list(marked)), len(got))
        y = np.stack([y[:, 0] & (hits >= least) for least in CATEGORIES.values()], 1)
    return Model(bag, Chain(x, y, len(bag.known), np.arange(len(got)) % FOLDS), names)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int | None = None, columns: tuple[str, ...] = ("toxic",)) -> DataFrame:
    """doc_id, p_<category> for each category of the chain, and ``toxic``: whether the last one is 0.5 or more.

    A null or empty text has the probabilities of a text without terms; every row is scored for itself, whatever shares its id. Without
    labels of both kinds to learn from, all probabilities are 0.5 and nothing is called toxic. Other columns are not read.
    """
    model = train(docs, labels, columns, held_out)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{c}" for c in model.categories]
    learned = bool(model.bag.known)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                p = held.value.score([t.as_py() for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in p.T.copy()), pa.array((p[:, -1] >= 0.5) & learned)], names=["doc_id", *names, "toxic"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return ready.mapInArrow(rows, ", ".join(["doc_id long", *(f"{n} double" for n in names), "toxic boolean"]))
