import math
import re
import zlib
from collections import Counter

import numpy as np

from strandlake.llm import common, hpylm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    train = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    toks = [[*WORD.findall(low(t)), None] for _, t in rows]
    counts = Counter(w for (d, _), ws in zip(rows, toks) if train(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(((d, not train(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for (d, _), ws in zip(rows, toks)), key=str)


def got(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)


def test_counts_and_base_of_real_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    out = hpylm.score(docs).cache()
    assert got(out) == expected([tuple(r) for r in docs.collect()])
    held = [r for r in out.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in held)
    again = {r.doc_id: r.score for r in hpylm.score(docs).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in out.collect())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, "a b A"), (None, "a c"), (4, "x " * 20000), (5, "\t a\nÉ é"), (5, "\t a\nÉ é"), (16, "a b c d e"), (17, "new words only")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, block string")
    assert got(hpylm.score(docs)) == expected(rows)
    assert hpylm.score(docs.limit(0)).collect() == []
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    only = [(d, "a b") for d in held]
    assert got(hpylm.score(spark.createDataFrame(only, "doc_id long, text string"))) == expected(only)


def test_scores_do_not_depend_on_partitions(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (1, 4, 9, 31):
            spark.conf.set("spark.sql.shuffle.partitions", str(1 + n // 2))
            found.append({r.doc_id: r.score for r in hpylm.score(docs.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(abs(f[k] - found[0][k]) < 1e-6 for f in found for k in found[0]) and len({len(f) for f in found}) == 1


def test_several_cells_and_hot_words(spark, monkeypatch):
    """Many small cells, and hot words dealt over several, give the same counts and nearly the same scores."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join("the" if x < 4 else f"w{x}" for x in rng.zipf(1.4, 300) if x < 5000)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = {r.doc_id: r for r in hpylm.score(docs).collect()}
    monkeypatch.setattr(hpylm, "CELL_BYTES", 8000)
    monkeypatch.setattr(hpylm, "HOT", 2000)  # in the driver; workers count by their own, so only the number of cells changes there
    many = {r.doc_id: r for r in hpylm.score(docs).collect()}
    assert got(hpylm.score(docs)) == expected(rows)
    change = [abs(many[k].score / one[k].score - 1) for k in one]
    assert max(change) < 0.02 and sum(change) / len(change) < 0.005, (max(change), sum(change) / len(change))


def test_hot_words_are_dealt_over_cells():
    hot = {"ids": np.array([3, 9]), "n": np.array([10**6, 10**6]), "parts": np.array([4, 2])}
    keys = np.sort(np.concatenate([np.uint64(k << 32) | np.arange(500, dtype=np.uint64) for k in (2, 3, 9, 11)]))
    cell = hpylm._cell_of(keys, 7, hot)
    of = {k: set(cell[keys >> np.uint64(32) == k].tolist()) for k in (2, 3, 9, 11)}
    assert of[2] == {2} and of[11] == {4} and len(of[3]) == 4 and len(of[9]) == 2


def posterior(rows, d, d_root, sweeps, burn, rng):
    """Mean predictive probability of each (word before, word) by a plain sampler: every customer sits at a table, one moves at a time."""
    train = [(t, not (zlib.crc32(str(k).encode()) % 7 == 2)) for k, t in rows]
    seqs = [[None, *low(t).split(), None] for t, ok in train if ok]
    vocabulary = {w for s in seqs for w in s[1:]}
    base = 1 / (len(vocabulary) + 1)
    seats, root = {}, {}  # (context, word) -> sizes of tables; word -> sizes of the root's tables
    in_context, root_n, root_t = Counter(), 0, 0

    def p_root(w):
        t = root.get(w, [])
        return (sum(t) - d_root * len(t) + (hpylm.ROOT_STRENGTH + d_root * root_t) * base) / (hpylm.ROOT_STRENGTH + root_n)

    def choose(tables, new, disc):
        u = rng.random() * (sum(tables) - disc * len(tables) + new)
        for k, x in enumerate(tables):
            u -= x - disc
            if u < 0:
                return k
        return len(tables)

    def add_root(w):
        nonlocal root_n, root_t
        t = root.setdefault(w, [])
        k = choose(t, (hpylm.ROOT_STRENGTH + d_root * root_t) * base, d_root)
        if k == len(t):
            t.append(0)
            root_t += 1
        t[k] += 1
        root_n += 1

    def leave(t):
        u = rng.random() * sum(t)
        for k, x in enumerate(t):
            u -= x
            if u < 0:
                break
        t[k] -= 1
        if not t[k]:
            t.pop(k)
            return True
        return False

    def add(c, w):
        t = seats.setdefault((c, w), [])
        k = choose(t, (hpylm.STRENGTH + d * in_context[c]) * p_root(w), d)
        if k == len(t):
            t.append(0)
            in_context[c] += 1
            add_root(w)
        t[k] += 1

    pairs = [(a, b) for s in seqs for a, b in zip(s, s[1:])]
    for c, w in pairs:
        add(c, w)
    customers, total, n = Counter(c for c, _ in pairs), Counter(), 0
    asked = {(a, b) for _, t in rows for s in [[None, *low(t).split(), None]] for a, b in zip(s, s[1:])}
    for sweep in range(sweeps):
        for c, w in pairs:
            if leave(seats[c, w]):
                in_context[c] -= 1
                if leave(root[w]):
                    root_t -= 1
                root_n -= 1
            add(c, w)
        if sweep >= burn:
            n += 1
            for c, w in asked:
                t = seats.get((c, w), [])
                total[c, w] += (sum(t) - d * len(t) + (hpylm.STRENGTH + d * in_context[c]) * p_root(w)) / (hpylm.STRENGTH + customers[c])
    return {k: v / n for k, v in total.items()}


def test_scores_against_a_plain_sampler(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.6, 60), 40))) for k in range(24)]
    monkeypatch.setattr(hpylm, "SAMPLES", 30)
    scores = {r.doc_id: r.score for r in hpylm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [[None, *t.split(), None] for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    pairs = Counter((a, b) for s in train for a, b in zip(s, s[1:]))
    share = lambda ones, twos: min(max(ones / max(ones + 2 * twos, 1), 0.05), 0.95)
    first = Counter()
    for (_, w), c in pairs.items():
        first[w] += int(hpylm.first_tables(np.array([c]))[0])
    d = share(*[sum(c == k for c in pairs.values()) for k in (1, 2)])
    d_root = share(*[sum(c == k for c in first.values()) for k in (1, 2)])
    p = posterior(rows, d, d_root, 60, 20, np.random.default_rng(1))
    want = {k: sum(math.log10(p[a, b]) for a, b in zip([None, *t.split()], [*t.split(), None])) for k, t in rows}
    change = {k: abs(scores[k] / want[k] - 1) for k in want}
    assert max(change.values()) < 0.02 and sum(change.values()) / len(change) < 0.007, change


def whole_of(**more):
    return {"hot": {"ids": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "parts": np.zeros(0, np.int64)}, **more}


def test_probabilities_of_each_context_add_up():
    """Over the vocabulary and the unknown word, after sweeps that keep every table count possible."""
    rng = np.random.default_rng(0)
    n_words, contexts = 60, 5
    before, word = (x.ravel() for x in np.meshgrid(np.arange(contexts), np.arange(n_words), indexing="ij"))
    c = rng.poisson(np.exp(rng.normal(0, 2, len(word)))).astype(np.int64)
    w = whole_of(base=1 / (n_words + 1), d=0.6, d_root=0.5)
    b = {"before": hpylm.pack(np.arange(contexts)), "lens": hpylm.pack(np.full(contexts, n_words)), "words": hpylm.pack(np.arange(n_words)), "word": hpylm.pack(word), "c": hpylm.pack(c)}
    r = hpylm.Restaurants(b, w["hot"])
    r.t = hpylm.first_tables(r.c)
    for _ in range(3):
        customers = np.bincount(word, r.t, n_words).astype(np.int64)
        tables = hpylm.drawn(customers, np.full(n_words, 10.0), np.full(n_words, w["base"]), 0.5, rng, 0.0)
        assert ((tables <= customers) & ((tables > 0) == (customers > 0))).all()
        w |= {"root_customers": float(customers.sum()), "root_tables": float(tables.sum())}
        p = hpylm.root_probability(customers, tables, w)
        unknown = hpylm.root_probability(np.zeros(1), np.zeros(1), w)[0]
        assert abs(p.sum() + unknown - 1) < 1e-9
        r.sweep(p, np.zeros(0), 0.6, rng)
        assert ((r.t <= r.c) & ((r.t > 0) == (r.c > 0))).all()
    q = r.predictive(p, np.zeros(0), 0.6)
    for k in range(contexts):
        rest = (hpylm.STRENGTH + 0.6 * r.t[before == k].sum()) / (hpylm.STRENGTH + c[before == k].sum()) * unknown
        assert abs(q[before == k].sum() + rest - 1) < 1e-9


def test_one_dish_follows_the_seating_law():
    """Number of tables of one dish with four customers against all ways to seat them, with other tables in the restaurant."""
    d, strength, others, p, c = 0.5, 0.7, 3, 0.4, 4
    weight = Counter()

    def seat(tables, left, w):
        if not left:
            weight[len(tables)] += w
            return
        for k, x in enumerate(tables):
            seat([*tables[:k], x + 1, *tables[k + 1 :]], left - 1, w * (x - d))
        seat([*tables, 1], left - 1, w * (strength + d * (others + len(tables))) * p)

    seat([], c, 1.0)
    t = hpylm.drawn(np.full(60000, c), np.full(60000, strength + d * others), np.full(60000, p), d, np.random.default_rng(3))
    found = Counter(t.tolist())
    assert all(abs(found[k] / len(t) - w / sum(weight.values())) < 0.01 for k, w in weight.items())


def test_tables_follow_the_exact_law():
    """Mean and variance of the number of tables against generalised Stirling numbers in logs, at small counts and over EXACT."""
    rng = np.random.default_rng(7)
    for d, counts in ((0.6, (2, 3, 9, 33, 200, 1000, 5000)), (0.3, (60, 3000))):
        last = np.array([-np.inf, 0.0])
        for c in range(1, counts[-1]):
            stay = np.log(c - d * np.arange(1, c + 1)) + last[1:]
            last = np.concatenate([[-np.inf], np.logaddexp(last[:-1], stay), last[-1:]])
            if c + 1 not in counts:
                continue
            for step in (0.0, d):
                for seats, p in ((5.0, 0.01), (5.0, 0.3), (5.0, 1.0), (50.0, 1.0), (5000.0, 0.2)):
                    if c >= hpylm.EXACT and step and p > 0.5:
                        continue  # a parent with one word alone
                    w = last[1:] + np.arange(1, c + 2) * math.log(p) + np.log(seats + step * np.arange(c + 1)).cumsum()
                    share = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
                    mean = (share * np.arange(1, c + 2)).sum()
                    var = (share * (np.arange(1, c + 2) - mean) ** 2).sum()
                    t = hpylm.drawn(np.full(4000, c + 1), np.full(4000, seats), np.full(4000, p), d, rng, step)
                    assert abs(t.mean() - mean) < 0.02 * mean + 5 * math.sqrt(var / 4000), (d, c + 1, step, seats, p, t.mean(), mean)
                    assert abs(t.var() - var) < 0.15 * var + 0.02, (d, c + 1, step, seats, p, t.var(), var)


def test_packed_numbers():
    for top in (0, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**63):
        a = np.array([0, top // 2, top], np.uint64)
        assert (hpylm.unpack(hpylm.pack(a)) == a).all()
    assert len(hpylm.unpack(hpylm.pack(np.zeros(0, np.int64)))) == 0
