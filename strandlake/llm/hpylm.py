"""A hierarchical Pitman-Yor language model over words, trained on all training documents and scored on all documents.

Each word that comes before another has a restaurant, whose customers are the words that follow it; the tables of all these restaurants are the
customers of the root, their common parent. The root's base is uniform over the vocabulary and one unknown word. A document's first word
follows the end. No context is left out or put together with others.

The seating is sampled by Gibbs steps. What a prediction needs of a seating are the numbers of tables, so a step takes all customers of a dish
from a restaurant and seats them again: the number of their tables is drawn from its conditional law, given all other tables of the restaurant,
``P ** t * S(c, t) * (A)(A + d) ... (A + (t - 1) d)`` with the generalised Stirling numbers S, A = strength + d * other tables, and the parent's
probability P. A sweep draws one half of a restaurant's dishes given the other half's tables, then the other half. Dishes with more than
``EXACT`` customers are drawn by a saddle point of that law (a test holds both against exact laws).

Words have numbers, dealt by frequency into ``cells`` whose number follows from the bytes of text alone, so no result depends on how rows lie in
partitions. Steps, each linear in the text and without a table that any worker must hold whole:

1. Blocks of documents leave their words as numbers in a file, and send the distinct ones with training counts to the words' cells.
2. A words' cell numbers its words, and answers each block. The block sends its distinct pairs (word before, word) to the cell of the word
   before; a word with more than ``HOT`` customers has its pairs dealt over as many cells as that takes.
3. A pairs' cell holds whole restaurants (or parts of the hot ones, whose tables are summed over cells in each round). In each round it
   gets the root's probabilities of its words, makes ``SWEEPS`` sweeps, and sends its tables by word to the words' cells, where the root is seated.
4. After the rounds, the predictive probabilities of the last ``SAMPLES`` of them are averaged and go back to the blocks, which add up scores.

Blocks and cells are files under names that depend on what they hold, so a task that runs again leaves the same or a new file. To the driver
come a row for each cell (``CELL_BYTES`` of text) and the hot words, one for ``HOT`` tokens at most.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common, sampling
from strandlake.llm.near_duplicates import _runs
from strandlake.llm.token_files import _rename, filesystem

HELD_OUT, FOLDS = 2, 7
#: Up to so many customers, the law of the number of tables is exact; from there, customers are followed in runs.
EXACT = 1024
BURN, SAMPLES, SWEEPS = 1, 3, 2
STRENGTH, ROOT_STRENGTH = 5.0, 10.0
BLOCK_BYTES = 12 << 20
CELL_BYTES = 24 << 20
HOT = 400_000
SEED = 29
_CODEC = "zstd"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def pack(a: np.ndarray) -> bytes:
    """Unsigned numbers at the least width that fits, byte by byte, so that compression finds the empty ones."""
    top = int(a.max()) if len(a) else 0
    w = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([w]) + a.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    w = raw[0]
    if len(raw) == 1:
        return np.zeros(0, f"<u{w}")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(w, -1).T).view(f"<u{w}").ravel()


def _save(uri: str, name: str, value) -> None:
    raw = pickle.dumps(value, protocol=5)
    fs, root = filesystem(uri)
    held = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(held) as f:
        f.write(len(raw).to_bytes(8, "little") + pa.compress(raw, _CODEC, asbytes=True))
    _rename(fs, held, f"{root}/{name}")


def _load(uri: str, name: str):
    fs, root = filesystem(uri)
    with fs.open_input_file(f"{root}/{name}") as f:
        raw = f.read()
    return pickle.loads(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), _CODEC, asbytes=True))


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_SPOKEN = "block string, cell int, words binary, counts binary"


def _blocks(batches: Iterator[pa.RecordBatch], cells: int, uri: str) -> Iterator[pa.RecordBatch]:
    """Leaves each block in a file and sends its distinct words, with their training counts, to their cells."""
    common.keep_only()
    number = 0

    def block(docs: list, trains: list, texts: list) -> Iterator[pa.RecordBatch]:
        nonlocal number
        known = _Numbers()
        known[None] = 0  # the end of a document
        coded = [np.fromiter(map(known.__getitem__, tokens(t)), np.int32) for t in texts]
        sizes = np.array([len(c) + 1 for c in coded])
        codes = np.concatenate([x for c in coded for x in (c, np.zeros(1, np.int32))])
        del coded
        hashes = np.fromiter((0 if w is None else xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
        cell = ((hashes >> np.uint64(17)) % np.uint64(cells)).astype(np.int64)
        order = np.lexsort((hashes, cell))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[codes]
        counts = np.bincount(codes, np.repeat(np.array(trains, float), sizes), len(order)).astype(np.int64)
        name = f"block-{TaskContext.get().partitionId()}-{number}-{xxhash.xxh64_hexdigest(repr((docs[:50], len(docs), len(codes), docs[-50:])))}"
        number += 1
        _save(uri, name, {"docs": docs, "trains": trains, "sizes": sizes, "codes": pack(codes), "end": int(place[0])})
        hashes, cell = hashes[order], cell[order]
        present, at = np.unique(cell, return_index=True)
        edge = [*at.tolist(), len(cell)]
        yield _batch(_SPOKEN, [(name, k, hashes[a:b].tobytes(), pack(counts[a:b])) for k, a, b in zip(present.tolist(), edge, edge[1:])])

    docs, trains, texts, size = [], [], [], 0
    for batch in batches:
        for doc, train, text in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), batch.column("text")):
            text = text.as_py() or b""
            if docs and size + len(text) > BLOCK_BYTES:
                yield from block(docs, trains, texts)
                docs, trains, texts, size = [], [], [], 0
            docs.append(doc)
            trains.append(train)
            texts.append(text)
            size += len(text)
    if docs:
        yield from block(docs, trains, texts)


_NUMBERED = "cell int, tokens long, words long, hot binary"


def _words(batches: Iterator[pa.RecordBatch], cells: int, uri: str) -> Iterator[pa.RecordBatch]:
    """Numbers a cell's words by frequency, leaves what each block asked for in a file, and gives sums and the hot words."""
    for group in _runs(batches, ["cell"]):
        cell, names = group.column("cell")[0].as_py(), group.column("block").to_pylist()
        words = [np.frombuffer(w.as_py(), np.uint64) for w in group.column("words")]
        merged = np.unique(np.concatenate(words))
        at = [np.searchsorted(merged, w) for w in words]
        n = np.bincount(np.concatenate(at), np.concatenate([unpack(c.as_py()) for c in group.column("counts")]), len(merged)).astype(np.int64)
        ids = np.empty(len(merged), np.int64)
        ids[np.lexsort((merged, -n))] = np.arange(len(merged)) * cells + cell
        if len(ids) and ids.max() >= 1 << 32:
            raise ValueError("more than 2 ** 32 numbers of words; raise CELL_BYTES")
        _save(uri, f"words-{cell}", [(b, pack(ids[w]), pack(n[w])) for b, w in zip(names, at)])
        hot = np.flatnonzero(n > HOT)
        yield _batch(_NUMBERED, [(cell, int(n.sum()), int((n > 0).sum()), np.stack([ids[hot], n[hot]]).tobytes())])


_TOLD = "block string, cell int, ids binary, n binary"


def _tell(batches: Iterator[pa.RecordBatch], cells: list[int], uri: str) -> Iterator[pa.RecordBatch]:
    for k in (cells[k] for b in batches for k in b.column(0).to_pylist()):
        for block, ids, n in _load(uri, f"words-{k}"):
            yield _batch(_TOLD, [(block, k, ids, n)])


def _keys(ids: np.ndarray, b: dict) -> np.ndarray:
    """The pair (word before, word) of each token as one number; a first word follows the end."""
    at = ids.astype(np.uint64)[unpack(b["codes"])]
    before = np.concatenate([ids[b["end"] : b["end"] + 1].astype(np.uint64), at[:-1]])  # an end is the word before the next document's first
    return before << np.uint64(32) | at


def _cell_of(keys: np.ndarray, cells: int, hot: dict) -> np.ndarray:
    """The cell of each of the sorted pairs: that of the word before, or one of several if that word is hot."""
    before = (keys >> np.uint64(32)).astype(np.int64)
    cell = before % cells
    if len(hot["ids"]):
        at = np.minimum(np.searchsorted(hot["ids"], before), len(hot["ids"]) - 1)
        dealt = np.flatnonzero(hot["ids"][at] == before)
        spread = (keys[dealt] & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        cell[dealt] = (cell[dealt] + (spread % hot["parts"][at[dealt]].astype(np.uint64)).astype(np.int64)) % cells
    return cell


_COUNTED = "block string, cell int, before binary, per_word binary, words binary, counts binary"


def _pairs(batches: Iterator[pa.RecordBatch], cells: int, uri: str, whole: dict) -> Iterator[pa.RecordBatch]:
    """A block's distinct pairs with their training counts, to their cells; its base scores and word numbers go to a file."""
    common.keep_only()
    for group in _runs(batches, ["block"]):
        name = group.column("block")[0].as_py()
        b = _load(uri, name)
        ids = np.concatenate([unpack(x.as_py()) for x in group.column("ids")])
        n = np.concatenate([unpack(x.as_py()) for x in group.column("n")]).astype(np.int64)
        codes = unpack(b["codes"])
        start = np.concatenate([[0], np.cumsum(b["sizes"])[:-1]])
        base = np.log10((n + 1) / (whole["tokens"] + whole["words"] + 1))
        _save(uri, f"base-{name}", {"ids": pack(ids), "known": np.add.reduceat((n > 0)[codes].astype(np.int64), start), "base": np.add.reduceat(base[codes], start)})
        keys, which = np.unique(_keys(ids, b), return_inverse=True)
        counts = np.bincount(which, np.repeat(np.array(b["trains"], float), b["sizes"]), len(keys)).astype(np.int64)
        del which, codes
        cell = _cell_of(keys, cells, whole["hot"])
        order = np.argsort(cell, kind="stable")
        cell, keys, counts = cell[order], keys[order], counts[order]
        present, at = np.unique(cell, return_index=True)
        edge = [*at.tolist(), len(cell)]
        for k, x, y in zip(present.tolist(), edge, edge[1:]):
            before, lens = np.unique(keys[x:y] >> np.uint64(32), return_counts=True)
            yield _batch(_COUNTED, [(name, k, pack(before), pack(lens), pack(keys[x:y] & np.uint64(0xFFFFFFFF)), pack(counts[x:y]))])


def first_tables(c: np.ndarray) -> np.ndarray:
    """Tables to begin with."""
    return np.where(c > 0, np.maximum(1, np.rint(np.power(np.maximum(c, 1), 0.75))), 0).astype(np.int64)


_UP = "origin int, cell int, places binary, tables binary, extra binary"


class Restaurants:
    """The restaurants of a pairs' cell: one row for each pair, sorted by the word before."""

    def __init__(self, b: dict, hot: dict):
        self.before, self.lens, self.words = unpack(b["before"]).astype(np.int64), unpack(b["lens"]).astype(np.int64), unpack(b["words"])
        self.word, self.c = unpack(b["word"]).astype(np.int64), unpack(b["c"]).astype(np.int64)
        self.of = np.repeat(np.arange(len(self.before)), self.lens)
        self.several = np.flatnonzero(self.c > 1)
        self.t = np.minimum(self.c, 1)
        self.hot = np.flatnonzero(np.isin(self.before, hot["ids"]))
        self.hot_at = np.searchsorted(hot["ids"], self.before[self.hot])
        self.customers = np.bincount(self.of, self.c, len(self.before))
        self.customers[self.hot] = hot["n"][self.hot_at]

    def tables(self, of_hot: np.ndarray | None) -> np.ndarray:
        """Tables of each restaurant; those of hot ones, which lie in several cells, are given."""
        out = np.bincount(self.of, self.t, len(self.before)).astype(np.int64)
        if of_hot is not None:
            out[self.hot] = of_hot[self.hot_at]
        return out

    def sweep(self, p: np.ndarray, of_hot: np.ndarray, d: float, rng: np.random.Generator) -> None:
        for half in (0, 1):
            total = self.tables(of_hot)
            some = self.several[self.several % 2 == half]
            of = self.of[some]
            others = np.maximum(total[of] - self.t[some], 0)
            self.t[some] = drawn(self.c[some], STRENGTH + d * others, p[self.word[some]], d, rng)

    def predictive(self, p: np.ndarray, of_hot: np.ndarray, d: float) -> np.ndarray:
        return (self.c - d * self.t + (STRENGTH + d * self.tables(of_hot)[self.of]) * p[self.word]) / (STRENGTH + self.customers[self.of])

    def up(self, cell: int, cells: int, first: bool) -> pa.RecordBatch:
        """Tables by word for the words' cells; in the first round with the words' places there, and the counts of ones and twos."""
        tables = np.bincount(self.word, self.t, len(self.words)).astype(np.int64)
        to, place = np.divmod(self.words.astype(np.int64), cells)[::-1]
        present, at = np.unique(to, return_index=True)
        edge = [*at.tolist(), len(to)]
        rows = [(cell, k, pack(place[a:b]) if first else None, pack(tables[a:b]), None) for k, a, b in zip(present.tolist(), edge, edge[1:])]
        part = np.bincount(self.of, self.t, len(self.before)).astype(np.int64)[self.hot]
        extra = np.concatenate([[int((self.c == 1).sum()), int((self.c == 2).sum())], self.hot_at, part]).astype("<i8")
        return _batch(_UP, [*rows, (cell, cell, None, None, extra.tobytes())])


def _gather(batches: Iterator[pa.RecordBatch], cells: int, uri: str, whole: dict) -> Iterator[pa.RecordBatch]:
    """Merges a cell's pairs of all blocks, leaves them in a file, and sends the first tables up."""
    common.keep_only()
    for group in _runs(batches, ["cell"]):
        cell, names = group.column("cell")[0].as_py(), group.column("block").to_pylist()
        keys = []
        for before, lens, words in zip(group.column("before"), group.column("per_word"), group.column("words")):
            keys.append(np.repeat(unpack(before.as_py()).astype(np.uint64) << np.uint64(32), unpack(lens.as_py())) | unpack(words.as_py()).astype(np.uint64))
        merged = np.unique(np.concatenate(keys))
        which = [np.searchsorted(merged, k) for k in keys]
        c = np.zeros(len(merged), np.int64)
        for w, counts in zip(which, group.column("counts")):
            c[w] += unpack(counts.as_py())
        before, lens = np.unique(merged >> np.uint64(32), return_counts=True)
        words, word = np.unique(merged & np.uint64(0xFFFFFFFF), return_inverse=True)
        order = np.lexsort((words // np.uint64(cells), words % np.uint64(cells)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        b = {"before": pack(before), "lens": pack(lens), "words": pack(words[order]), "word": pack(place[word]), "c": pack(c)}
        _save(uri, f"cell-{cell}", b)
        _save(uri, f"asked-{cell}", [(name, pack(w)) for name, w in zip(names, which)])
        r = Restaurants(b, whole["hot"])
        r.t = first_tables(r.c)
        _save(uri, f"state-0-{cell}", pack(r.t[r.several]))
        yield r.up(cell, cells, True)


_SUMS = "cell int, customers long, tables long, ones long, twos long, extra binary"


def _root(batches: Iterator[pa.RecordBatch], uri: str, turn: int, whole: dict) -> Iterator[pa.RecordBatch]:
    """Seats the root's customers, the tables of all restaurants by word, in a words' cell."""
    for group in _runs(batches, ["cell"]):
        cell, rows = group.column("cell")[0].as_py(), group.to_pylist()
        extra = next((r["extra"] for r in rows if r["extra"] is not None), None)
        rows = sorted((r for r in rows if r["tables"] is not None), key=lambda r: r["origin"])
        places = [unpack(r["places"]) for r in rows] if turn == 0 else [unpack(x) for _, x in _load(uri, f"places-{cell}")]
        if turn == 0:
            _save(uri, f"places-{cell}", [(r["origin"], r["places"]) for r in rows])
        customers = np.zeros(max((int(x.max()) + 1 for x in places), default=0), np.int64)
        for x, r in zip(places, rows):
            customers[x] += unpack(r["tables"])
        if turn == 0:
            tables = first_tables(customers)
        else:
            tables = drawn(customers, np.full(len(customers), ROOT_STRENGTH + whole["d_root"] * whole["root_tables"]), np.full(len(customers), whole["base"]), whole["d_root"], np.random.default_rng([SEED, turn, cell, 1]), 0.0)
        _save(uri, f"root-{turn}-{cell}", (pack(customers), pack(tables)))
        yield _batch(_SUMS, [(cell, int(customers.sum()), int(tables.sum()), int((customers == 1).sum()), int((customers == 2).sum()), extra)])


def root_probability(customers: np.ndarray, tables: np.ndarray, w: dict) -> np.ndarray:
    return (customers - w["d_root"] * tables + (ROOT_STRENGTH + w["d_root"] * w["root_tables"]) * w["base"]) / (ROOT_STRENGTH + w["root_customers"])


_DOWN = "cell int, origin int, p binary"


def _down(batches: Iterator[pa.RecordBatch], cells: list[int], uri: str, turn: int, whole: dict) -> Iterator[pa.RecordBatch]:
    """The root's probabilities, in the order in which each pairs' cell has the words."""
    for k in (cells[k] for b in batches for k in b.column(0).to_pylist()):
        customers, tables = _load(uri, f"root-{turn}-{k}")
        p = root_probability(unpack(customers).astype(float), unpack(tables).astype(float), whole).astype("<f4")
        for origin, places in _load(uri, f"places-{k}"):
            yield _batch(_DOWN, [(origin, k, p[unpack(places)].tobytes())])


def _received(group: pa.Table) -> tuple[int, np.ndarray]:
    got = sorted(zip(group.column("origin").to_pylist(), group.column("p")), key=lambda x: x[0])
    return group.column("cell")[0].as_py(), np.concatenate([np.frombuffer(p.as_py(), "<f4") for _, p in got]).astype(float)


def _seated(uri: str, cell: int, turn: int, whole: dict) -> Restaurants:
    r = Restaurants(_load(uri, f"cell-{cell}"), whole["hot"])
    r.t[r.several] = unpack(_load(uri, f"state-{turn}-{cell}"))
    return r


def _round(batches: Iterator[pa.RecordBatch], cells: int, uri: str, turn: int, whole: dict, of_hot: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The sweeps of a pairs' cell in one round, from the state of the round before; the tables go up."""
    common.keep_only()
    for group in _runs(batches, ["cell"]):
        cell, p = _received(group)
        r = _seated(uri, cell, turn - 1, whole)
        if turn - 1 > BURN:
            _save(uri, f"sample-{turn - 1}-{cell}", p.astype("<f4"))
        rng = np.random.default_rng([SEED, turn, cell, 0])
        for _ in range(SWEEPS):
            r.sweep(p, of_hot[turn - 1], whole["d"], rng)
        _save(uri, f"state-{turn}-{cell}", pack(r.t[r.several]))
        yield r.up(cell, cells, False)


_ANSWERED = "block string, cell int, logs binary"


def _answer(batches: Iterator[pa.RecordBatch], uri: str, turn: int, whole: dict, of_hot: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """log10 of the pairs' predictive probabilities, averaged over the samples, for each block in its order."""
    common.keep_only()
    for group in _runs(batches, ["cell"]):
        cell, p = _received(group)
        total = 0.0
        for k in range(BURN + 1, turn + 1):
            r = _seated(uri, cell, k, whole)
            total = total + r.predictive(p if k == turn else _load(uri, f"sample-{k}-{cell}").astype(float), of_hot[k], whole["d"])
        logs = np.log10(total / (turn - BURN)).astype("<f4")
        for block, which in _load(uri, f"asked-{cell}"):
            yield _batch(_ANSWERED, [(block, cell, logs[unpack(which)].tobytes())])


def _score(batches: Iterator[pa.RecordBatch], cells: int, uri: str, whole: dict) -> Iterator[pa.RecordBatch]:
    common.keep_only()
    for group in _runs(batches, ["block"]):
        name = group.column("block")[0].as_py()
        b, base = _load(uri, name), _load(uri, f"base-{name}")
        keys, which = np.unique(_keys(unpack(base["ids"]), b), return_inverse=True)
        got = sorted(zip(group.column("cell").to_pylist(), group.column("logs")), key=lambda x: x[0])
        logs = np.empty(len(keys))
        logs[np.argsort(_cell_of(keys, cells, whole["hot"]), kind="stable")] = np.concatenate([np.frombuffer(x.as_py(), "<f4") for _, x in got])
        at = np.concatenate([[0], np.cumsum(b["sizes"])[:-1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(b["docs"], pa.int64()), pa.array([not t for t in b["trains"]]), pa.array(b["sizes"].astype(np.int64)), pa.array(base["known"]), pa.array([whole["tokens"]] * len(at), pa.int64()), pa.array(base["base"]), pa.array(np.add.reduceat(logs[which], at))],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )


@lru_cache(maxsize=4)
def log_seatings(d: float) -> np.ndarray:
    """log S(c, t) for c, t up to EXACT: the weight of all ways to seat c customers at t tables, generalised Stirling numbers."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, EXACT):
        stay = np.log(c - d * np.arange(1, c + 1)) + out[c, 1 : c + 1]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], np.append(stay, -np.inf))
    return out


def _ahead(seats: np.ndarray, a: np.ndarray, left: np.ndarray, d: float) -> np.ndarray:
    """log y, where the customers to come, ``left``, balance (seats / y + a y ** (d - 1)) (1 - y): each new table weighs a y ** d then."""
    low, high = -np.log1p(left / seats), np.zeros(len(a))
    for _ in range(18):
        y = (low + high) / 2
        more = (seats * np.exp(-y) + a * np.exp((d - 1) * y)) * -np.expm1(y) > left
        low, high = np.where(more, y, low), np.where(more, high, y)
    return (low + high) / 2


def _exact(c: np.ndarray, log_a: np.ndarray, grow: np.ndarray | None, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with 1 to EXACT customers by the law a ** t * S(c, t) * (1 + grow) ... (1 + (t - 1) grow)."""
    t, weights = np.ones(len(c), np.int64), log_seatings(d)
    two = np.flatnonzero(c == 2)
    a = np.exp(log_a[two]) * (1 if grow is None else 1 + grow[two])
    t[two] += rng.random(len(two)) * (1 - d + a) < a
    limit = np.exp(np.minimum(log_a, 50)) / d  # with ever more customers, t - 1 tends to a Poisson law of this mean, or to a wider one
    if grow is not None:
        limit = limit / np.maximum(1 - grow * limit, 1e-9)
    width = np.minimum(c, limit + 8 * np.sqrt(limit) + 12).astype(np.int64)  # all but e ** -25 of the law
    order = np.argsort(width, kind="stable")
    order = order[c[order] > 2]
    widths = width[order]
    at = 0
    while at < len(order):
        most = widths[at] * 5 // 4 + 1
        some = order[at : min(np.searchsorted(widths, most, "right"), at + max(1, (1 << 19) // most))]
        most = width[some].max()
        w = weights[c[some], 1 : most + 1] + np.arange(1, most + 1) * log_a[some, None]
        if grow is not None:
            w += np.log1p(np.arange(most) * grow[some, None]).cumsum(1)
        cum = np.exp(w - w.max(1, keepdims=True)).cumsum(1)
        t[some] = 1 + (cum <= (rng.random(len(some)) * cum[:, -1])[:, None]).sum(1)
        at += len(some)
    return np.minimum(t, c)


def drawn(c: np.ndarray, seats: np.ndarray, p: np.ndarray, d: float, rng: np.random.Generator, step: float | None = None) -> np.ndarray:
    """Tables of dishes given that all their customers eat that dish: the law p ** t * S(c, t) * seats (seats + step) ... (seats + (t - 1) step).

    ``step`` is d, as new tables add to their own restaurant's weight, unless it is given. Beyond EXACT customers, the first ones are seated
    by the law with a fixed weight and the others in runs, both with new tables weighted by what the customers to come make of them (a saddle
    point of the generating function of the ways to seat these). The step comes in through an auxiliary gamma variable y of shape
    seats / step + t: given y, the law has the fixed weight step * y * p.
    """
    t = np.zeros(len(c), np.int64)
    step = d if step is None else step
    log_a = np.log(np.maximum(seats * p, 1e-300))
    at = np.flatnonzero((c > 0) & (c <= EXACT))
    t[at] = _exact(c[at], log_a[at], step / seats[at] if step else None, d, rng)
    at = np.flatnonzero(c > EXACT)
    for turn in range(8 if step else 1):
        if not len(at):
            break
        n, b, first = c[at], (seats[at] if turn == 0 else step * rng.gamma(seats[at] / step + t[at])) * p[at], np.full(len(at), EXACT)
        mean = np.ones(len(at))
        for _ in range(3):  # the tables there are of the first customers decide on what is ahead
            y = _ahead(EXACT - d * mean, b, n - EXACT, d)
            mean = _exact(first, np.log(np.maximum(b, 1e-300)) + d * y, None, d, rng).astype(float)
        now = mean.astype(np.int64)
        low = EXACT
        while (live := np.flatnonzero(n > low)).size:
            high = low + low // 8
            some = np.minimum(n[live], high) - low
            middle = low + (some - 1) / 2
            new = b[live] * np.exp(d * _ahead(middle - d * now[live], b[live], n[live] - middle, d))
            now[live] += rng.binomial(some, new / (middle - d * now[live] + new))
            low = high
        t[at] = now
    return t


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    Tokens are words in lower case (A-Z) and one end for each document; a null or empty text has the end alone. Rows whose crc32(doc_id)
    modulo 7 is 2 are held out; a row without id is learned from. Rows that share an id are counted and scored each for itself. Without
    training rows every token is unknown. Other columns are not read.
    """
    spark = docs.sparkSession
    uri, parts = common.scratch(spark, "hpylm"), common.shuffle_partitions(spark)
    filesystem(uri)[0].create_dir(filesystem(uri)[1], recursive=True)
    n_bytes, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    cells = max(1, -(-(n_bytes or 0) // CELL_BYTES))
    dealt = lambda df, *by: df.repartition(parts, by[0]).sortWithinPartitions(*by)

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (sampling.fold(F.col("doc_id"), FOLDS) != HELD_OUT).alias("train"))
    spoken = ready.mapInArrow(lambda it: _blocks(it, cells, uri), _SPOKEN)
    numbered = dealt(spoken, "cell", "block").mapInArrow(lambda it: _words(it, cells, uri), _NUMBERED).collect()
    present = sorted(r.cell for r in numbered)
    hot = np.concatenate([np.frombuffer(r.hot, np.int64).reshape(2, -1) for r in numbered], axis=1)
    hot = hot[:, np.argsort(hot[0])]
    whole = {"tokens": sum(r.tokens for r in numbered), "words": sum(r.words for r in numbered), "hot": {"ids": hot[0], "n": hot[1], "parts": np.minimum(-(-hot[1] // HOT), cells)}}
    whole["base"] = 1 / (whole["words"] + 1)
    common.forget_shuffles(spark)
    each = spark.range(0, len(present), 1, min(len(present), 4 * parts))
    told = each.mapInArrow(lambda it: _tell(it, present, uri), _TOLD)
    counted = dealt(told, "block", "cell").mapInArrow(lambda it: _pairs(it, cells, uri, whole), _COUNTED)
    up = dealt(counted, "cell", "block").mapInArrow(lambda it: _gather(it, cells, uri, whole), _UP)

    of_hot: list[np.ndarray] = []
    last = BURN + SAMPLES
    discount = lambda a, b: min(max(a / max(a + 2 * b, 1), 0.05), 0.95)
    for turn in range(last + 1):
        sums = dealt(up, "cell", "origin").mapInArrow(lambda it, turn=turn, whole=whole: _root(it, uri, turn, whole), _SUMS).collect()
        common.forget_shuffles(spark)
        extra = [np.frombuffer(r.extra, "<i8") for r in sums if r.extra is not None]
        whole = whole | {"root_customers": float(sum(r.customers for r in sums)), "root_tables": float(sum(r.tables for r in sums))}
        if turn == 0:
            whole |= {"d": discount(sum(int(x[0]) for x in extra), sum(int(x[1]) for x in extra)), "d_root": discount(sum(r.ones for r in sums), sum(r.twos for r in sums))}
        tables = np.zeros(len(hot[0]), np.int64)
        for x in extra:
            at, part = x[2:].reshape(2, -1)
            tables[at] += part
        of_hot.append(tables)
        down = dealt(each.mapInArrow(lambda it, turn=turn, whole=whole: _down(it, present, uri, turn, whole), _DOWN), "cell", "origin")
        if turn < last:
            up = down.mapInArrow(lambda it, turn=turn, whole=whole, of_hot=list(of_hot): _round(it, cells, uri, turn + 1, whole, of_hot), _UP)
    answers = down.mapInArrow(lambda it: _answer(it, uri, last, whole, of_hot), _ANSWERED)
    return dealt(answers, "block", "cell").mapInArrow(lambda it: _score(it, cells, uri, whole), SCHEMA)

