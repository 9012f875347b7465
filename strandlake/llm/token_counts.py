"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. A node's failure link leads to the node for what is left after the greedy pieces of its string are popped, and
the number of those pieces is stored with it. Reading a word then takes a number of steps in proportion to its bytes, and the count of
its greedy longest-match pieces is the sum of the stored numbers; no piece is built.

Pieces that begin a word and pieces that continue one are two sets, with a root each. From a byte-level vocabulary, the pieces with a
leading space begin words and the others continue them, so a word is read with a space before it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common

#: Counts that a worker remembers, and the longest word that is remembered. Only speed depends on them.
REMEMBER, LONGEST = 600_000, 64
SCHEMA = "doc_id long, n_words long, n_tokens long"


class Automaton:
    """Greedy longest-match counts of words; ``count`` is -1 for a word that the pieces can't cover."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        #: (node << 8 | byte) -> node; node 0 is the root of words, node 1 that of their later parts.
        self.child: dict[int, int] = {}
        ends, parent, byte = {}, [-1, -1], [0, 0]
        order: list[list[int]] = [[], []]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    key = node << 8 | c
                    if key not in self.child:
                        self.child[key] = len(parent)
                        parent.append(node)
                        byte.append(c)
                    node = self.child[key]
                if piece:
                    ends[node] = True
            level = [root]
            while level:
                level = [n for node in level for n in map(self.child.get, range(node << 8, (node << 8) + 256)) if n is not None]
                order[root] += level
        self.fail, self.pops = [-1] * len(parent), [0] * len(parent)
        for node in order[1] + order[0]:  # links lead to the second trie, to shorter strings
            if node in ends:
                self.fail[node], self.pops[node] = 1, 1
                continue
            up, popped = self.fail[parent[node]], self.pops[parent[node]]
            while up >= 0 and (up << 8 | byte[node]) not in self.child:
                popped += self.pops[up]
                up = self.fail[up]
            if up >= 0:
                self.fail[node], self.pops[node] = self.child[up << 8 | byte[node]], popped

    def count(self, word: bytes) -> int:
        node, n, child, fail, pops = 0, 0, self.child, self.fail, self.pops
        for c in word:
            while (to := child.get(node << 8 | c)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = to
        while node > 1:
            n += pops[node]
            node = fail[node]
        return n if node >= 0 else -1


class Counts(dict):
    """Pieces of words: remembered, or read by the automaton. A word that can't be covered counts as one unknown piece."""

    def __init__(self, automaton: Automaton, mark: bytes):
        super().__init__()
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.mark + word)
        n = 1 if n < 0 else n
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def of(self, words: list[bytes]) -> int:
        if len(self) > REMEMBER:
            self.clear()
        return sum(map(self.__getitem__, words))


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a vocabulary file with a base64 piece and a rank in each line."""
    import base64

    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_COUNTS: dict[str, Counts] = {}
common.CACHES["token_counts"] = lambda: [c.clear() for c in _COUNTS.values()]


def counts(path: str) -> Counts:
    """One automaton for each worker process and vocabulary."""
    if path not in _COUNTS:
        pieces = read_ranks(path)
        _COUNTS[path] = Counts(Automaton((p for p in pieces if p[:1] == b" "), (p for p in pieces if p[:1] != b" ")), b" ")
    return _COUNTS[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document, from its whole text. Words are parted by ASCII white space; case counts.

    A null or empty text has none. Rows that share an id are counted each for itself. Other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only("token_counts")
        known = counts(path)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text"):
                w = (text.as_py() or b"").split()
                words.append(len(w))
                tokens.append(known.of(w))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, SCHEMA)
