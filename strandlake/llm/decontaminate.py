"""Benchmark decontamination: an FM-index for each training shard, searched for the benchmark's word windows.

A partition of documents is cut into shards of about ``SHARD_BYTES`` of text (whole documents; a longer document is its own shard).
The words of a shard become symbols of the benchmark's alphabet. Runs of benchmark words as long as the shortest window at least
are indexed, with a separator after each: no window can occur anywhere else, as it would hold a word outside the alphabet or the end
of a document. All windows of one length are searched together, occurrences are located through sampled suffix positions, and the
words that they cover are merged to removal spans.

The benchmark is the fixed side. It is cut into blocks of at most ``BLOCK_BYTES`` of text, so that no worker holds more than one
block's windows; the documents of a shard are searched for each block in turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common
from strandlake.llm.fm_index import FmIndex

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
#: A word is a run of digits, letters and bytes of characters beyond ASCII, with A-Z in lower case; other bytes part words.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SPANS = "array<struct<first:long,after:long>>"
SCHEMA = f"doc_id long, n_words long, n_hit long, items array<string>, spans {SPANS}"


def split(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Windows:
    """The windows of one block of benchmark items: an alphabet, a matrix of windows for each length, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.alphabet: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            symbols = [self.alphabet.setdefault(w, len(self.alphabet) + 2) for w in split(text)]
            size = min(window, len(symbols))
            for k in range(len(symbols) - size + 1 if size else 0):
                found.setdefault(tuple(symbols[k : k + size]), set()).add(item)
        self.top = len(self.alphabet) + 1
        by: dict[int, list[tuple[int, ...]]] = {}
        for key in found:
            by.setdefault(len(key), []).append(key)
        self.by_length = [(n, np.array(keys, np.int64), [sorted(found[k]) for k in keys]) for n, keys in sorted(by.items())]
        self.shortest = min(by, default=0)


def find(words: np.ndarray, windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[list[str]]]]:
    """(length, places in ``words``, number of the window, items of each window) of all occurrences. ``words``: symbols, 0 = other."""
    if not windows.shortest or not len(words):
        return
    inside = np.concatenate([[False], words > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, after = edge[::2], edge[1::2]
    keep = after - first >= windows.shortest
    first, size = first[keep], (after - first)[keep]
    if not len(first):
        return
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    symbols = np.ones(starts[-1], np.int64)
    inner = np.arange(starts[-1]) - np.repeat(starts[:-1], size + 1)
    place = np.repeat(first, size + 1) + inner
    real = inner < np.repeat(size, size + 1)
    symbols[real] = words[place[real]]
    index = FmIndex(symbols, windows.top)
    for length, keys, items in windows.by_length:
        low, high = index.search(keys)
        count = high - low
        which = np.repeat(np.arange(len(keys)), count)
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield length, place[index.locate(rows)], which, items


def occurrences(texts: list[bytes], blocks: list) -> tuple[np.ndarray, list[set[str]], list[list[tuple[int, int]]]]:
    """For each text of one shard: its number of words, the items met, the merged spans of covered words."""
    sizes = np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        sizes[d] = len(split(text))
    start = np.concatenate([[0], np.cumsum(sizes + 1)])  # a place that belongs to no word parts two documents
    total = int(start[-1])
    cover = np.zeros(total + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        windows = block()
        words = np.zeros(total, np.int64)
        for a, n, text in zip(start.tolist(), sizes.tolist(), texts):
            words[a : a + n] = np.fromiter(map(windows.alphabet.get, split(text), repeat(0)), np.int64, n)
        for length, place, which, of in find(words, windows):
            np.add.at(cover, place, 1)
            np.add.at(cover, place + length, -1)
            doc = np.searchsorted(start, place, "right") - 1
            pairs = np.unique(doc * len(of) + which)
            for d, w in zip((pairs // len(of)).tolist(), (pairs % len(of)).tolist()):
                items[d].update(of[w])
    hit = np.cumsum(cover[:total]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(start, edge[::2], "right") - 1
    for d, a, b in zip(owner.tolist(), edge[::2].tolist(), edge[1::2].tolist()):
        spans[d].append((a - int(start[d]), b - int(start[d])))
    return sizes, items, spans


def shards(batches: Iterator[pa.RecordBatch], blocks: list, window: int) -> Iterator[tuple]:
    """Cuts batches into shards: (rows, texts, words, items, spans) of each. One block's windows are in memory at a time."""
    common.keep_only()
    made: dict[int, Windows] = {}

    def load(k: int) -> Windows:
        if k not in made:
            made.clear()
            made[k] = Windows(blocks[k].value, window)
        return made[k]

    loads = [lambda k=k: load(k) for k in range(len(blocks))]
    for batch in batches:
        column, first, held, size = batch.column("text"), 0, [], 0
        for k in range(batch.num_rows):
            text = column[k].as_py()
            text = b"" if text is None else text.encode() if isinstance(text, str) else text
            if held and size + len(text) > SHARD_BYTES:
                yield batch.slice(first, len(held)), held, *occurrences(held, loads)
                first, held, size = k, [], 0
            held.append(text)
            size += len(text)
        if held:
            yield batch.slice(first, len(held)), held, *occurrences(held, loads)


def benchmark_blocks(benchmark: DataFrame) -> list:
    """Broadcasts of the items, none with more than about BLOCK_BYTES of text unless one item alone is longer."""
    sc = benchmark.sparkSession.sparkContext
    blocks, held, size = [], [], 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    for r in items.toLocalIterator():
        if held and size + len(r.text) > BLOCK_BYTES:
            blocks.append(sc.broadcast(held))
            held, size = [], 0
        held.append((r.item, bytes(r.text)))
        size += len(r.text)
    return [*blocks, *([sc.broadcast(held)] if held else [])]


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document: words, words inside an occurrence of a window, the items met (as strings), the merged spans of words.

    A null or empty text has no words and no hit; items without words have no window; a null item_id is listed as ''. Rows that share
    an id are searched each for itself. An empty benchmark hits nothing. Other columns are not read.
    """
    blocks = benchmark_blocks(benchmark)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, sizes, items, spans in shards(batches, blocks, window):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array([[{"first": a, "after": b} for a, b in x] for x in spans], kind),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, SCHEMA)


def without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; the rest is joined by line ends."""
    words = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    kept, at = [], 0
    for first, after in spans:
        kept.append(raw[at : words[first][0]])
        at = words[after - 1][1]
    kept.append(raw[at:])
    return "\n".join(x for x in (k.decode(errors="ignore").strip() for k in kept) if x)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with benchmark spans cut from their texts; one that has no word left goes. All columns stay.

    ``n_chars`` is brought up to date where the table has it. Documents without a hit are returned as they are.
    """
    blocks = benchmark_blocks(benchmark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, _, _, spans in shards(batches, blocks, window):
            column, keep = batch.column("text").to_pylist(), [True] * len(texts)
            for k in (k for k, x in enumerate(spans) if x):
                column[k] = without(texts[k], spans[k])
                keep[k] = bool(split(column[k].encode()))
            out = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(column, batch.schema.field("text").type)}
            if "n_chars" in out:
                old = out["n_chars"].to_pylist()
                out["n_chars"] = pa.array([len(t) if x else n for t, x, n in zip(column, spans, old)], out["n_chars"].type)
            yield pa.RecordBatch.from_pydict(out).filter(pa.array(keep))

    return docs.mapInArrow(rows, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's: number of items, sha256 of their ids in string order, whether any word is hit."""
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
