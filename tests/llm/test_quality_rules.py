import math
import re
from collections import Counter

from strandlake.llm import common, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    found = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if found[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def rows_of(df):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()]


def test_measures_of_real_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(r.text), r.doc_id
    labels = {r.doc_id: r.quality for r in common.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    judged = [(labels[d], g.kept) for d, g in got.items() if d in labels and not g.base_failed]
    good = [k for q, k in judged if q]
    bad = [k for q, k in judged if not q]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2
    assert all(not g.kept for g in got.values() if g.base_failed)


def test_odd_rows(spark):
    many = " ".join(f"a{i % 40} b{i % 40} c{i % 41}" for i in range(4000))
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y z x y z x y", "p\n\np\n p\np\x0b", "naïve €😀 ###|", many, "w " * 30000, "é b c d é b c"]
    docs = spark.createDataFrame([(i if i != 4 else None, t, 1) for i, t in enumerate(texts)] + [(1, "a b", 1)], "doc_id long, text string, kept int")
    got = quality_rules.quality_rules(docs)
    assert sorted(rows_of(got)) == sorted([brute(t) for t in texts] + [brute("a b")])
    assert quality_rules.quality_rules(docs.limit(0)).collect() == []


def test_estimate_equals_plain_em(spark):
    votes = [(1, 1, 0)] * 40 + [(1, 0, 1)] * 30 + [(-1, 0, -1)] * 9 + [(-1, 1, 0)] * 4 + [(0, 0, 0)] * 7 + [(0, -1, 1)] * 3
    names = ["a", "b", "c"]
    got = quality_rules.estimate(spark.createDataFrame(votes, "a int, b int, c int"), names)
    post = [0.1 if min(v) == -1 else 0.9 for v in votes]
    last = None
    for _ in range(quality_rules.ROUNDS):
        g = sum(post)
        share = lambda x, t: (x + 0.5) / (t + 1.5)
        good = [[share(sum(p for p, v in zip(post, votes) if v[k] == x), g) for x in (-1, 0, 1)] for k in range(3)]
        bad = [[share(sum(1 - p for p, v in zip(post, votes) if v[k] == x), len(votes) - g) for x in (-1, 0, 1)] for k in range(3)]
        prior = (g + 0.5) / (len(votes) + 1)
        now = [prior, *sum(good, []), *sum(bad, [])]
        if last and max(abs(a - b) for a, b in zip(now, last)) < quality_rules.CLOSE:
            break
        last = now
        odds = [math.log(prior / (1 - prior)) + sum(math.log(good[k][v[k] + 1] / bad[k][v[k] + 1]) for k in range(3)) for v in votes]
        post = [1 / (1 + math.exp(-o)) for o in odds]
    assert abs(got["prior"] - prior) < 1e-9
    for k, r in enumerate(names):
        assert all(abs(a - b) < 1e-9 for a, b in zip(got["rules"][r][0] + got["rules"][r][1], good[k] + bad[k]))


def test_main_path_is_native(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    plan = quality_rules.measures(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
