import hashlib
import random
import re

import numpy as np
import pytest

from strandlake.llm import common, decontaminate
from strandlake.llm.fm_index import FmIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    of = {}
    for item, text in items:
        w = WORD.findall(low(text))
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            of.setdefault(tuple(w[k : k + size]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in of}
    out = []
    for doc, text in docs:
        w, hit, met = WORD.findall(low(text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := of.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    met |= found
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(a, b, "x", "y") for a, b in docs], "doc_id long, text string, item_id string, items string")
    b = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, decontaminate.digest(decontaminate.search(d, b)).collect()), key=str)


def test_suffix_order():
    rng = np.random.default_rng(1)
    for top, n in ((1, 40), (3, 200), (5000, 300), (2, 1000)):
        text = np.append(rng.integers(1, top + 1, n), 0)
        text[n // 2 : n] = text[: n - n // 2]
        assert suffix_order(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("top", [1, 2, 9, 300])
def test_index_finds_every_place(top):
    rng = np.random.default_rng(top)
    text = rng.integers(1, top + 1, 400)
    index = FmIndex(text, top, sample=5)
    patterns = np.array([text[i : i + 4] for i in range(0, 390, 7)] + [[top, 1, top, 1]])
    for pattern, a, b in zip(patterns, *index.search(patterns)):
        want = [i for i in range(len(text) - 3) if (text[i : i + 4] == pattern).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_odd_rows(spark):
    long_item = " ".join(f"w{i}" for i in range(25))
    items = [(1, long_item), (2, "short one"), (3, None), (4, ""), (5, long_item), (None, "no id here"), (6, "a a a a a a a a a a a a"), (1, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    docs = [
        (1, "x " + long_item.upper() + " y"), (2, None), (3, ""), (4, "Short! ONE"), (5, "no id, here"), (6, "a " * 50), (7, "a " * 9), (8, "w0 " + long_item[:40]),
        (9, "short"), (10, "one"), (11, "naïve short-one É"), (11, "naïve short-one É"), (None, long_item), (12, " ".join(f"w{i}" for i in range(9)) + " gap " + " ".join(f"w{i}" for i in range(9, 25))),
        (13, "z " * 20000 + long_item + " q" * 20000),
    ]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_random_rows(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n, v: " ".join(f"t{rng.randrange(v)}" for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 12, 30]), 4)) for i in range(12)]
    docs = [(i, text(rng.randrange(60), 4)) for i in range(60)]
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_and_shards_do_not_change_rows(spark, monkeypatch):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    bench = common.table(spark, "/root/testdata/sf0.001", "benchmark").select("item_id", "text")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert sorted(map(tuple, decontaminate.digest(decontaminate.search(docs, bench)).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert len(decontaminate.benchmark_blocks(bench)) > 3
    assert sorted(map(tuple, decontaminate.digest(decontaminate.search(docs, bench)).collect()), key=str) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_clean_cuts_the_spans_and_leaves_the_rest(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"Ahead, {item}! behind", 5), (2, "Nothing here.  ", 15), (3, item, 3), (4, None, 0), (None, f"{item} after", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = sorted(map(tuple, decontaminate.clean(docs, bench).collect()), key=str)
    assert out == sorted([(1, "Ahead,\n! behind", 15), (2, "Nothing here.  ", 15), (4, None, 0), (None, "after", 5)], key=str)
    assert not decontaminate.search(decontaminate.clean(docs, bench), bench).where("n_hit > 0").count()
