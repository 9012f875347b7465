"""Readers, writers, configuration, the end-to-end plan and its parts, and the driver's entry."""

import builtins
import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import stats
from strandlake.plans import models, pipeline
from strandlake.sources import config, files


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nACGT\nAC\n>two\n\nGG\n>three\nT")
    read = {r.seqid: r.seq for r in files.read_fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert read == {"one": "ACGTAC", "two": "GG", "three": "T"}
    assert [tuple(r) for r in files.read_fasta(spark, str(tmp_path / "x.fa"), last_only=True).collect()] == [("three", "T")]
    df = spark.createDataFrame([("a", "ACGT" * 40), ("b", ""), ("c", "A" * 60)], "seqid string, seq string")
    files.write_fasta(df, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))


def test_annotations(spark, tmp_path):
    (tmp_path / "x.gff").write_text("##gff-version 3\n1\tRefSeq\texon\t5\t9\t.\t+\t.\tID=\"q\"\n1\tRefSeq\tCDS\tx\t9\t.\t-\t0\tID=b\n")
    rows = files.read_annotations(spark, str(tmp_path / "x.gff")).collect()
    assert [(r.type, r.start, r.strand, r.score, r.attributes) for r in rows] == [("exon", "5", "+", None, 'ID="q"'), ("CDS", "x", "-", None, "ID=b")]


def test_config(tmp_path):
    path = str(tmp_path / "c.yaml")
    config.save(config.PRESETS["pipeline_start"], path)
    assert config.load(path) == config.PRESETS["pipeline_start"]
    config.update_params(path, {"C": np.float64(3.5), "kernel": "linear"})
    assert config.load(path).svm == config.Svm(C=3.5, kernel="linear") and config.load(path).preprocess.most_3 == 15000


def table(spark, n=300):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, n)
    return spark.createDataFrame([(k, int(t), [float(rng.normal() + 4 * t)]) for k, t in enumerate(y)], "id long, target int, features array<double>").cache()


def test_models(spark):
    df = table(spark)
    for kernel in ("linear", "rbf"):
        out = models.SvmModel(config.Svm(kernel=kernel)).fit(df).transform(df)
        assert stats.accuracy(out, "target", "prediction").first().accuracy > 0.9
    best, tried = models.search(df, n=3, folds=2)
    assert len(tried) == 3 and max(t["f1"] for t in tried) > 0.9
    assert models.candidates(4, 0) == models.candidates(4, 0)
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("_x", array_to_vector("features"))
    for name in ("gaussian_nb", "logistic", "forest", "boosting"):
        assert models.other_classifier(name).fit(x).transform(x).where("prediction = target").count() > 270


def test_a_fit_reads_few_rows_in_one_task(spark):
    from strandlake.plans.models import SvmModel
    from strandlake.sources.config import Svm

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([([float(v)], int(v + rng.normal() > 0)) for v in rng.normal(size=400)], "features array<double>, target int").repartition(8).persist()
    tracker = spark.sparkContext.statusTracker()
    for kernel in ("linear", "rbf"):
        spark.sparkContext.setJobGroup(kernel, kernel)
        SvmModel(Svm(kernel=kernel)).fit(df)
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(kernel) for s in tracker.getJobInfo(j).stageIds]
        tasks = [s.numTasks for s in stages if s and s.numCompletedTasks]  # others are skipped
        assert len(tasks) > 10 and sum(n > 1 for n in tasks) <= 4, tasks
    spark.sparkContext._jsc.clearJobGroup()


def test_boundary_plan(spark):
    rng = np.random.default_rng(2)
    letters = lambda n, p: "".join(rng.choice(list("ACGT"), n, p=p))
    seqs = [(k, letters(200, [0.25] * 4) + letters(40, [0.05, 0.45, 0.45, 0.05]) + letters(200, [0.25] * 4)) for k in range(300)]
    contigs = spark.createDataFrame(seqs, "seqid long, seq string")
    positive = spark.range(300).select(F.col("id").alias("seqid"), F.lit(200).cast("long").alias("s"), F.lit(240).cast("long").alias("e"))
    negative = spark.range(300).select(F.col("id").alias("seqid"), F.lit(20).cast("long").alias("s"), F.lit(60).cast("long").alias("e"))
    c = config.Config(windows=[20, 30], step=10, preprocess=config.Preprocess(drop_n=True, upper=True))
    t = pipeline.feature_table(positive, negative, contigs, c).cache()
    assert t.count() == 600
    model = pipeline.Boundary(c, n_search=2, folds=2).fit(t)
    assert model.f1 > 0.7
    found = positive.limit(4).withColumn("id", F.col("seqid"))
    scanned = model.scan(found, contigs).cache()
    assert scanned.count() == 4 * 20
    inside = scanned.where("pos BETWEEN 210 AND 230").agg(F.avg("mean_score")).first()[0]
    assert inside > scanned.where("pos < 180").agg(F.avg("mean_score")).first()[0] + 0.3
    assert 0 < model.dice(found, scanned).agg(F.avg("dice")).first()[0] <= 1


def test_entry_without_the_optional_parts(spark, monkeypatch):
    real = builtins.__import__

    def without(name, *a, **k):
        if name.startswith(("strandlake.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith(("strandlake.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", without)
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 16800


@pytest.mark.parametrize("name", ["randomized_search", "boundary_scan"])
def test_search_runs_with_all_draws_and_folds(spark, name, monkeypatch):
    import inspect

    from strandlake import queries
    from strandlake.plans import models, pipeline

    asked, real = [], inspect.signature(models.search)

    def noted(*args, **given):
        asked.append(real.bind(*args, **given))
        asked[-1].apply_defaults()
        return models.candidates(1)[0], [{"C": 1.0, "tol": 0.1, "kernel": "linear", "f1": 0.5}]

    monkeypatch.setattr(models, "search", noted)
    monkeypatch.setattr(pipeline, "search", noted)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [(x.arguments["n"], x.arguments["folds"]) for x in asked] == [(10, 5)]


def _objective(x, y, weight, c, plane):
    """The mean weighted hinge loss and the penalty of the plane on columns of deviation 1, as LinearSVC has them."""
    mean = (weight @ x) / weight.sum()
    std = np.sqrt(weight @ (x - mean) ** 2 / (weight.sum() - (weight**2).sum() / weight.sum()))
    hinge = np.maximum(1 - (2 * y - 1) * (x @ plane[:-1] + plane[-1]), 0)
    return weight @ hinge / weight.sum() + ((plane[:-1] * std) ** 2).sum() / (2 * c * len(y))


def test_fits_of_a_search_share_passes_and_reach_the_optimum(spark):
    from pyspark.ml.functions import vector_to_array

    from strandlake.operators import stats
    from strandlake.plans import models
    from strandlake.sources.config import Svm

    rng = np.random.default_rng(5)
    values = np.round(rng.normal(size=(600, 2)), 1)  # with equal rows
    labels = (values.sum(1) + rng.normal(size=600) > 0.8).astype(int)
    df = spark.createDataFrame([(k, [float(v) for v in x], int(y), k % 3) for k, (x, y) in enumerate(zip(values, labels))], "id long, features array<double>, target int, _fold int").persist()
    tried = [Svm(kernel=kind, gamma=gamma, C=c, tol=1e-6, class_weight=w) for kind, gamma, c, w in (("linear", "auto", 2.0, {0: 1.0, 1: 3.0}), ("rbf", "scale", 50.0, {0: 2.0, 1: 1.0}), ("rbf", "auto", 9.0, {0: 1.0, 1: 1.0}))]
    folds = models._Folds(df, "target", 0)
    scores = folds.scores(tried, 3)
    for i, p in enumerate(tried):
        train, test = df.where("_fold <> 0"), df.where("_fold = 0")
        model = models.SvmModel(p).fit(train)
        rows = model._inputs(train).select(vector_to_array("_x").alias("x"), "target").toPandas()
        x, y = np.array(rows.x.tolist()), rows.target.to_numpy()
        weight = np.array([p.class_weight[v] for v in y])
        theirs = _objective(x, y, weight, p.C, np.append(model.model.coefficients.toArray(), model.model.intercept))
        assert _objective(x, y, weight, p.C, folds.planes[3 * i]) <= theirs * 1.01, p
        assert abs(scores[3 * i] - stats.f1(model.transform(test), "target", "prediction").first().f1) < 0.06, p
    spark.sparkContext.setJobGroup("search", "search")
    _, results = models.search(df.drop("_fold"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("search"))
    spark.sparkContext._jsc.clearJobGroup()
    assert len(results) == 10 and 0.5 < max(r["f1"] for r in results) <= 1
    assert jobs < 400, jobs  # a fit of its own for each draw and fold took thousands


def test_a_search_with_folds_of_one_class(spark):
    from strandlake.plans import models

    df = spark.createDataFrame([(k, [float(k)], int(k == 4)) for k in range(8)], "id long, features array<double>, target int")
    _, results = models.search(df, n=3, folds=4)
    assert len(results) == 3 and all(0 <= r["f1"] <= 1 for r in results)


def test_fixtures_of_saved_tables_are_the_same(spark):
    from strandlake import fixtures as fx

    d = "/root/testdata/sf0.001"
    seqs = fx.contigs(spark, d).persist()
    found = fx.features(spark, d, seqs).persist()
    for view in (fx.utr3, fx.utr5):
        assert sorted(map(tuple, view(spark, d, seqs, found).collect())) == sorted(map(tuple, view(spark, d).collect()))
