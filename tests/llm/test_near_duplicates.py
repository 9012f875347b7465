import random
import re

import pytest

from strandlake.llm import common, connected, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, size, component) by comparing every pair that shares a shingle."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    of = {}
    for k, s in enumerate(sets):
        if rows[k][0] is None:
            continue
        near = {}
        for x in s:
            for j in of.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            of[x].append(k)
        for j, n in near.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                label[max(a, b)] = min(a, b)
    return sorted(((d, len(sets[k]), None if d is None else rows[find(k)][0]) for k, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(map(tuple, near_duplicates.near_duplicates(df).collect()), key=str)


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def corpus(seed, n):
    rng = random.Random(seed)
    new = lambda k: [rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(k)]
    shared, base, out = new(40), new(150), []
    for k in range(n):
        kind = rng.random()
        if kind < 0.3:
            w = edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))
        elif kind < 0.5:
            w = new(60) + shared + new(20)
        elif kind < 0.7 and out:
            w = edited(rng, rng.choice(out)[1].split(), rng.choice([0, 0.02, 0.04]))
        else:
            w = new(rng.randrange(0, 120))
        out.append((k, " ".join(w)))
    return out


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5000 + k) for k in range(1, 50)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = dict(map(tuple, connected.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_odd_rows(spark):
    rows = [(9, None), (8, ""), (7, " \n"), (6, "Same few words"), (5, "same FEW\twords"), (4, "same few word"), (3, "a b c d e"), (2, "A b c d E"), (None, "a b c d e"), (None, None),
            (11, "x " * 30), (12, "x " * 9), (13, " ".join(map(str, range(20000)))), (10, " ".join(map(str, range(19000)))), (14, "dup id one two three four"), (14, "dup id one two three four"), (15, "dup id one two three four"), (16, "é É b c d"), (17, "É É b c d")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, cid int, component_id string")
    assert got(docs) == brute(rows)
    assert got(docs.limit(0)) == []


def test_real_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert got(docs) == want
    assert len({c for _, _, c in want}) < len(want)


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_blocks_and_parts_lose_no_link(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(near_duplicates, "LIST", 6)
        monkeypatch.setattr(near_duplicates, "BLOCK", 5)
    rows = corpus(seed, 260)
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs.repartition(4)) == want
    kept = {r.doc_id for r in near_duplicates.one_of_each(docs).collect()}
    assert kept == {d for d, _, c in want if d == c}


def test_one_of_each_decides_by_row_and_keeps_columns(spark):
    a, b, c = ("one two three four five six " + x for x in ("seven eight", "seven EIGHT", "nine ten eleven twelve thirteen fourteen fifteen sixteen"))
    rows = [(1, a), (7, b), (7, c), (7, c), (None, a), (None, a), (8, None), (8, ""), (9, c), (3, "unlike any other text of this table here"), (3, "unlike any other text of this TABLE here")]
    docs = spark.createDataFrame([(*r, k, "x", 0, True) for k, r in enumerate(rows)], "doc_id long, text string, _gone int, _again string, id int, row boolean")
    out = near_duplicates.one_of_each(docs)
    assert out.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert found == sorted([(1, a), (7, c), (None, a), (None, a), (8, None), (3, "unlike any other text of this TABLE here")], key=str)
    assert near_duplicates.one_of_each(docs.limit(0)).collect() == []
