import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import common, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(word, first, later):
    n, at, pieces = 0, 0, first
    while at < len(word):
        size = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in pieces), default=0)
        if not size:
            return -1
        n, at, pieces = n + 1, at + size, later
    return n


pieces = st.sets(st.text("ab", min_size=1, max_size=5).map(str.encode), max_size=12)


@settings(max_examples=400, deadline=None)
@given(pieces, pieces, st.text("abc", max_size=14).map(str.encode))
def test_counts_equal_plain_greedy_matching(first, later, word):
    assert token_counts.Automaton(first, later).count(word) == greedy(word, first, later)


def expected(rows):
    all_pieces = set(token_counts.read_ranks(PATH))
    first, later = {p for p in all_pieces if p[:1] == b" "}, {p for p in all_pieces if p[:1] != b" "}
    memo = {}
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        for w in words:
            if w not in memo:
                memo[w] = greedy(b" " + w, first, later)
        out.append((doc, len(words), sum(memo[w] for w in words)))
    return sorted(out, key=str)


def test_real_and_odd_rows(spark, monkeypatch):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    got = sorted(map(tuple, token_counts.token_counts(docs, PATH).collect()), key=str)
    assert got == expected([tuple(r) for r in docs.collect()])
    rows = [(1, None), (2, ""), (2, " \n"), (None, "Hello, wörld ナ x"), (4, "ab" * 300), (5, "w " * 30000), (5, "w " * 30000)]
    odd = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_words int")
    assert sorted(map(tuple, token_counts.token_counts(odd, PATH).collect()), key=str) == expected(rows)
    assert token_counts.token_counts(odd.limit(0), PATH).collect() == []


def test_long_words_take_linear_time():
    c = token_counts.counts(PATH)
    assert c.of([b"a" * 2_000_000]) > 1000
