import numpy as np

from strandlake.plans import network


def plain(s, convolutions, dense):
    h = []
    for w, b, padding in convolutions:
        x = [[0.0] * 4] * padding + [[float(c == a) for a in "ACGT"] for c in s] + [[0.0] * 4] * padding
        for k in range(w.shape[2]):
            h.append(max(max(0.0, b[k] + sum(x[p + i][c] * w[i, c, k] for i in range(w.shape[0]) for c in range(4))) for p in range(len(x) - w.shape[0] + 1)))
    for w, b in dense:
        h = [1 / (1 + np.exp(-(b[j] + sum(h[i] * w[i, j] for i in range(len(h)))))) for j in range(w.shape[1])]
    return h[0]


def test_forward_pass(spark):
    rng = np.random.default_rng(0)
    convolutions = [(rng.normal(size=(w, 4, 3)), rng.normal(size=3), p) for w, p in ((2, 0), (4, 3))]
    dense = [(rng.normal(size=(6, 5)), rng.normal(size=5)), (rng.normal(size=(5, 1)), rng.normal(size=1))]
    rows = [(k, "".join(rng.choice(list("ACGT"), 8 + k % 3))) for k in range(30)]
    out = network.scored(spark.createDataFrame(rows, "id long, segment string"), convolutions, dense).collect()
    assert len(out) == 30
    for r in out:
        assert abs(r.probability - plain(r.segment, convolutions, dense)) < 1e-6
