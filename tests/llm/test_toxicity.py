import numpy as np

from strandlake.llm import common, toxicity


def test_terms():
    assert toxicity.terms(b"bad") == [b"bad"]
    assert toxicity.terms(b"abcdefg") == [b"abcdefg", b"abcd*", b"abcdef*"]


def test_bag_counts_known_terms():
    bag = toxicity.Bag([b"bad", b"abcd*"])
    row, col, val = bag.rows([b"Bad, bad! abcdx", None, b"", b"abcdy good"])
    assert sorted(zip(row.tolist(), col.tolist(), np.expm1(val).round().astype(int).tolist())) == [(0, 0, 2), (0, 1, 1), (3, 1, 1)]


def test_later_links_use_earlier_probabilities_out_of_fold():
    rng = np.random.default_rng(1)
    n = 600
    a = rng.random(n) < 0.5
    x = (np.flatnonzero(a), np.zeros(a.sum(), np.int64), np.ones(a.sum()))
    chain = toxicity.Chain(x, np.stack([a, a], 1), 1, np.arange(n) % toxicity.FOLDS)
    assert [len(w) for w in chain.links] == [2, 3]
    assert chain.links[1][1] > 0.5
    p = chain.probabilities(x, n)
    assert ((p >= 0.5) == a[:, None]).all()
    noise = rng.random(n) < 0.5
    unique = (np.arange(n), np.arange(n), np.ones(n))
    fitted = toxicity.Chain(unique, np.stack([noise, noise], 1), n, np.arange(n) % toxicity.FOLDS)
    out = fitted._out_of_fold(unique, np.zeros((n, 0)), noise.astype(float), np.arange(n) % toxicity.FOLDS)
    assert abs(np.corrcoef(out, noise)[0, 1]) < 0.3  # a term of one row tells nothing out of fold


def test_held_out_accuracy(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels, held_out=1).toPandas()
    assert len(got) == docs.count() and got.doc_id.is_unique
    import zlib

    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]].merge(labels.toPandas(), on="doc_id", suffixes=("", "_label"))
    found = held.toxic & (held.toxic_label == 1)
    assert found.sum() / (held.toxic_label == 1).sum() > 0.85
    assert found.sum() / held.toxic.sum() > 0.9


def test_odd_rows(spark):
    rows = [(1, None, True), (2, "", True), (3, "bad bad bad", False), (3, "bad bad bad", False), (None, "bad " * 20000, True), (5, "fine words", True), (6, "Bad bad", True), (7, "bad bad bad bad words", True), (8, "bad fine", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (5, 0), (6, 1), (7, 1), (8, 1), (None, 1), (9, None), (5, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.p_toxic <= 1 for r in got)
    assert {r.doc_id: r.toxic for r in got}[3] and {r.doc_id: r.toxic for r in got}[None] and not {r.doc_id: r.toxic for r in got}[5]
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    assert not any(r.toxic for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_chain_of_label_columns_beats_independent_models(spark):
    """The second category needs the first, which any number of many words tells; fitted to the same rows, held against others."""
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for k in range(1200):
        n = int(rng.choice([0, 1, 8]))
        flip = rng.random() < 0.5
        words = [f"n{rng.integers(60)}" for _ in range(8)] + [f"mark{j}" for j in rng.choice(30, n, replace=False)] + ["flip"] * int(flip)
        rows.append((k, " ".join(words)))
        marks.append((k, int(n > 0), int(n > 0 and flip)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks[:600], "doc_id long, insult int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels, columns=("insult", "toxic")).collect()}
    assert set(out[0].asDict()) == {"doc_id", "p_insult", "p_toxic", "toxic"}
    model = toxicity.train(docs, labels, ("insult", "toxic"))
    texts = [t.encode() for _, t in rows]
    y = np.array([[m[1], m[2]] for m in marks]) > 0
    alone = toxicity.Chain(model.bag.rows(texts[:600]), y[:600, 1:], len(model.bag.known), np.arange(600) % toxicity.FOLDS).probabilities(model.bag.rows(texts), 1200)[600:, 0]
    chain = np.array([out[k].p_toxic for k in range(600, 1200)])
    loss = lambda p: -np.log(np.clip(np.where(y[600:, 1], p, 1 - p), 1e-9, 1)).mean()
    print(loss(chain), loss(alone))
    assert loss(chain) < loss(alone)
    assert np.mean([out[k].toxic == y[k, 1] for k in range(600, 1200)]) > 0.9


def test_the_least_text_of_an_id_is_learned_from(spark):
    rows = [(k, ("bad " if k % 2 else "fine ") * 5) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    one = spark.createDataFrame(rows, "doc_id long, text string")
    more = one.union(spark.createDataFrame([(k, "zzz other words") for k in range(40)], "doc_id long, text string"))
    want = {r.doc_id: round(r.p_toxic, 9) for r in toxicity.toxicity(one, labels).collect()}
    got = {(r.doc_id, round(r.p_toxic, 9)) for r in toxicity.toxicity(more.repartition(7), labels).collect()}
    assert set(want.items()) <= got
