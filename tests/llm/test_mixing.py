import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from strandlake.llm import common, mixing


def greedy(weights, seats, most):
    got = [0] * len(weights)
    for _ in range(min(seats, sum(m for m, w in zip(most, weights) if w > 0))):
        k = max((k for k in range(len(got)) if got[k] < most[k] and weights[k] > 0), key=lambda k: (Fraction(weights[k]) / (2 * got[k] + 1), -k))
        got[k] += 1
    return got


def test_apportionment_equals_the_plain_rule():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 9)
        weights = [float(rng.choice([0, 1, 2, 5, 5, rng.randrange(1, 1000)])) for _ in range(n)]
        most = [rng.choice([0, 1, 3, 50, 10**6]) for _ in range(n)]
        seats = rng.randrange(0, 120)
        assert mixing.sainte_lague(weights, seats, most) == greedy(weights, seats, most)


def test_targets():
    assert mixing.targets([]) == []
    assert mixing.targets([0, 0]) == [0, 0]
    assert mixing.targets([10, 10, 10]) == [18.75, 7.5, 3.75]
    assert mixing.targets([1, 100, 100]) == [3.0, 132.0, 66.0]
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 10, rng.randrange(10**6)]) for _ in range(rng.randrange(1, 12))]
        t = mixing.targets(sizes)
        assert all(x <= 3 * s + 1e-6 for x, s in zip(t, sizes)) and sum(t) <= sum(sizes) + 1e-3
        free = {mixing.WEIGHTS[k % 3]: x / mixing.WEIGHTS[k % 3] for k, (x, s) in enumerate(zip(t, sizes)) if x < 3 * s - 1e-6}
        assert max(free.values(), default=0) - min(free.values(), default=0) < 1e-3 * max(1, *free.values(), 1)


def by_hand(spark, docs):
    """What each document gives, block by block, from the plan's columns."""
    sized = mixing._sized(docs).cache()
    plan, block = mixing.placed(sized, sized)
    out = Counter()
    for r in plan.collect():
        parts = mixing.chosen_ranges(r._at, r.size, r._n, r._more, r._phase, block)
        out[r.doc_id, r.size, r._full * r.size + sum(b - a for a, b in parts)] += 1
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_come_near_their_targets(spark, sf):
    docs = common.table(spark, f"/root/testdata/{sf}", "documents")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(got) == sorted(again) and len(got) == docs.count()
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    source = {r.doc_id: r.source for r in docs.collect()}
    took, target, size = Counter(), {}, Counter()
    for r in got:
        took[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r["size"]
        target[source[r.doc_id]] = r.target
    order = sorted(size)
    assert [target[s] for s in order] == mixing.targets([size[s] for s in order])
    assert {r.source_size for r in got} == set(size.values())
    assert max(abs(took[s] - target[s]) / max(target[s], 1) for s in order) < 0.02
    assert by_hand(spark, docs) == Counter((r.doc_id, r["size"], r.taken) for r in got)


def test_odd_rows(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, text(500), None, 1), (4, text(30), "b", 1), (4, text(30), "b", 1), (None, text(7), "b", 1), (5, text(20000), "é", 1), (6, "\t x\ny ", "B", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in got) == [(0, 7), (1, 0), (2, 0), (3, 500), (4, 30), (4, 30), (5, 20000), (6, 2)]
    of = {r.doc_id: r for r in got}
    order = ["B", "a", "b", "é", None]
    want = dict(zip(order, mixing.targets([2, 0, 67, 20000, 500])))
    assert of[6].target == want["B"] and of[1].target == 0 and of[5].target == want["é"] and of[3].target == want[None]
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mix(docs.where("doc_id < 3")).count() == 2


def test_mixed_rows_hold_what_the_plan_takes(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got, whole = defaultdict(int), {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        got[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
        assert all(part in whole[r.doc_id] for part in r.text.split("\n"))
    assert dict(got) == {k: v for k, v in plan.items() if v}


def test_clashing_columns_and_a_given_block(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(50 + k)), "ab"[k % 2], k, "x", 1.5) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int, _row string, target double")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and all(r._size == r.doc_id and r._row == "x" for r in out.collect())
    got = mixing.mix(docs, block=10).collect()
    words = {s: sum(r.taken for r in got if "ab"[r.doc_id % 2] == s) for s in "ab"}
    goal = {"ab"[r.doc_id % 2]: r.target for r in got}
    assert all(abs(words[s] - goal[s]) <= 30 for s in "ab")
