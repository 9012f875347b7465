"""Near-duplicate documents: the exact Jaccard join of word 5-gram sets, by signature trees.

1. Documents with one set form a class; a class is represented by its least document.
2. Candidates: two sets that link share one of the first members of either, in any order common to all sets. The order puts members of
   overfull counters of a fixed-size sketch last, so that passages which very many documents share are hardly ever looked up. Classes
   that share a first member form a list; equal lists are one.
3. Each list is joined by a signature tree on bitmaps, whose bound loses no link. The pairs it cannot exclude give coarse components.
4. Each coarse component is joined by signature trees on the sets themselves, in blocks of at most ``BLOCK`` classes. A component of
   several blocks is completed: first representatives of what the blocks connected, then whatever lies outside the largest part
   against all blocks, so that no pair across blocks is left out, while pairs that are connected already are never looked at.

Lists with more than ``LIST`` members are joined in parts first and completed in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import common, connected, shingles, signature_tree

SKETCH_BITS, SEGMENTS = 21, 32
LIST, BLOCK = 1024, 256
CHUNK_MEMBERS = 1_500_000
_DOC = "doc_id long, n_shingles long, cid long, bitmap binary, segment int, counts binary"


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end rows with this task's part of the sketch."""
    common.keep_only("shingles")
    size = 1 << SKETCH_BITS
    counts, held, n_held = np.zeros(size, np.int64), [], 0
    empty = lambda n, t: pa.nulls(n, t)
    names = [x.split()[0] for x in _DOC.split(", ")]
    for batch in batches:
        n, cid, maps = [], [], []
        for text in batch.column("text"):
            s = shingles.shingles(text.as_py())
            n.append(len(s))
            cid.append(shingles.set_id(s) if len(s) else None)
            maps.append(shingles.bitmap(s).tobytes() if len(s) else None)
            held.append(s)
            n_held += len(s)
            if n_held > CHUNK_MEMBERS:
                counts += np.bincount((np.concatenate(held) & np.uint64(size - 1)).astype(np.int64), minlength=size)
                held, n_held = [], 0
        k = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(maps, pa.binary()), empty(k, pa.int32()), empty(k, pa.binary())], names=names)
    if held:
        counts += np.bincount((np.concatenate(held) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    if counts.any():
        parts = np.minimum(counts, 65535).astype("<u2").reshape(SEGMENTS, -1)
        k = SEGMENTS
        yield pa.RecordBatch.from_arrays([empty(k, pa.int64()), empty(k, pa.int64()), empty(k, pa.int64()), empty(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)


def _overfull(described: DataFrame) -> np.ndarray:
    """Counters of the sketch with over twice their mean and 256: at most half of them, as bits."""
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    limit = 2 * total / (1 << SKETCH_BITS) + 256

    def add(batches: Iterator[pa.RecordBatch], kind: str) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("segment").to_pylist(), batch.column("counts")):
                part = np.frombuffer(c.as_py(), kind).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        return sums

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c in add(batches, "<u2").items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c.astype("<u4").tobytes()], pa.binary())], names=["segment", "counts"])

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c in add(batches, "<u4").items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(c > limit).tobytes()], pa.binary())], names=["segment", "bits"])

    bits = np.zeros((SEGMENTS, (1 << SKETCH_BITS) // SEGMENTS // 8), np.uint8)
    parts = described.where("segment is not null").select("segment", "counts", F.pmod(F.xxhash64("counts"), F.lit(SEGMENTS)).alias("_k"))
    # in two steps, so that no task reads a segment of every task of a large corpus
    first = parts.repartition(SEGMENTS * SEGMENTS // 8, "segment", "_k").select("segment", "counts").mapInArrow(some, "segment int, counts binary")
    for r in first.repartition(SEGMENTS, "segment").mapInArrow(all_, "segment int, bits binary").collect():  # a fixed number of bytes
        bits[r.segment] = np.frombuffer(r.bits, np.uint8)
    return np.unpackbits(bits.ravel()).astype(bool)


def _first_members(docs: DataFrame, overfull: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, members, classes): first members of each set with its class, gathered by bucket of the member."""
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(overfull))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only("shingles")
        full, mask = np.unpackbits(held.value).astype(bool), np.uint64((1 << SKETCH_BITS) - 1)
        seen: set[int] = set()
        members, classes, n = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not members:
                return
            m, c = np.concatenate(members), np.concatenate(classes)
            b = ((m >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            m, c, b = m[order], c[order], b[order]
            which, at = np.unique(b, return_index=True)
            edge = [*at.tolist(), len(b)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(which, pa.int32()), *(pa.array([x[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary()) for x in (m, c))], names=["bucket", "members", "classes"]
            )

        for batch in batches:
            for text in batch.column("text"):
                s = shingles.shingles(text.as_py())
                if not len(s) or (cid := shingles.set_id(s)) in seen:
                    continue
                seen.add(cid)
                late = full[(s & mask).astype(np.int64)]
                first = np.concatenate([s[~late], s[late]])[: len(s) - -(-signature_tree.PART * len(s) // signature_tree.WHOLE) + 1]
                members.append(first)
                classes.append(np.full(len(first), cid, np.int64))
                n += len(first)
                if n > CHUNK_MEMBERS:
                    yield from flush()
                    members, classes, n = [], [], 0
        yield from flush()

    return docs.mapInArrow(rows, "bucket int, members binary, classes binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    return shingles._final(x.astype(np.int64).view(np.uint64))


def _lists(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(list, part, parts, cid) of the classes that share a first member; equal lists of a partition are one."""
    members, classes = [], []
    for batch in batches:
        for m, c in zip(batch.column("members"), batch.column("classes")):
            members.append(np.frombuffer(m.as_py(), np.uint64))
            classes.append(np.frombuffer(c.as_py(), np.int64))
    if not members:
        return
    m, c = np.concatenate(members), np.concatenate(classes)
    order = np.lexsort((c, m))
    m, c = m[order], c[order]
    new = np.r_[True, (m[1:] != m[:-1]) | (c[1:] != c[:-1])]
    m, c = m[new], c[new]
    start = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    size = np.diff(np.r_[start, len(m)])
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return
    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    begin = np.cumsum(size) - size
    name = shingles._final(np.add.reduceat(_mixed(c[at]), begin) + size.astype(np.uint64))
    _, one = np.unique(name, return_index=True)
    keep = np.zeros(len(name), bool)
    keep[one] = True
    rows = np.repeat(keep, size)
    cid, lists, n = c[at][rows], np.repeat(name, size)[rows].view(np.int64), np.repeat(size, size)[rows]
    parts = -(-n // most)
    part = (shingles._final(cid.view(np.uint64) ^ lists.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
    for k in range(0, len(cid), 100_000):
        s = slice(k, k + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(lists[s]), pa.array(part[s]), pa.array(parts[s].astype(np.int32)), pa.array(cid[s])], names=["list", "part", "parts", "cid"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, of batches that are sorted by the keys: a group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        edge = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edge, edge[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _possible_pairs(lists: np.ndarray, cid: np.ndarray, sizes: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Pairs of one list that the bound of their bitmaps does not exclude, for many short lists at once. The lists stand together."""
    start = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    size = np.diff(np.r_[start, len(lists)])
    rest = np.repeat(start + size, size) - np.arange(len(lists)) - 1  # members behind each in its list
    i = np.repeat(np.arange(len(lists)), rest)
    j = i + 1 + np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
    fits = 100 * np.minimum(sizes[i], sizes[j]) >= 80 * np.maximum(sizes[i], sizes[j])
    key = np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])], 1)
    _, one = np.unique(key, axis=0, return_index=True) if len(key) else (None, np.empty(0, np.int64))
    distinct = np.zeros(len(i), bool)
    distinct[one] = True
    i, j = i[fits & distinct], j[fits & distinct]
    kind = signature_tree._classes(sizes)
    out = []
    for k, words in enumerate((16, 64, 256)):
        at = np.flatnonzero(np.minimum(kind[i], kind[j]) == k)
        for s in range(0, len(at), 20_000):
            x, y = i[at[s : s + 20_000]], j[at[s : s + 20_000]]
            who, back = np.unique(np.concatenate([x, y]), return_inverse=True)
            bits = np.stack([shingles.fold(np.frombuffer(maps[w], "<u8")[None], words)[0] for w in who])
            u, v = back[: len(x)], back[len(x) :]
            excess = sizes[who] - np.bitwise_count(bits).sum(1, dtype=np.int64)
            most = np.bitwise_count(bits[u] & bits[v]).sum(1, dtype=np.int64) + np.minimum(excess[u], excess[v])
            good = signature_tree.enough(np.minimum(most, np.minimum(sizes[x], sizes[y])), sizes[x], sizes[y])
            out.append(np.stack([cid[x[good]], cid[y[good]]], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _join_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that connect each list (``list``, ``part``, sorted) as far as bitmaps can tell; with ``label``, only what it parts."""
    short: list[tuple[np.ndarray, ...]] = []
    n_short, number = 0, 0

    def flush() -> pa.RecordBatch:
        pairs = _possible_pairs(*(np.concatenate([s[k] for s in short]) for k in range(4)))
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["a", "b"])

    for group in _runs(batches, ["list", "part"]):
        cid = group.column("cid").to_numpy()
        sizes, maps = group.column("n_shingles").to_numpy(), group.column("bitmap").to_numpy()
        labels = group.column("label").to_numpy() if "label" in group.column_names else None
        number += 1
        if len(cid) < 2:
            continue
        if len(cid) <= 12 and labels is None:
            short.append((np.full(len(cid), number), cid, sizes, maps))
            n_short += len(cid)
            if n_short > 20_000:
                yield flush()
                short, n_short = [], 0
            continue
        side = group.column("probe").to_numpy(zero_copy_only=False) if labels is not None else None
        pairs = signature_tree.links(sizes, [np.frombuffer(b, "<u8") for b in maps], signature_tree.Components(len(cid), labels), None, side)
        yield _edges([(int(cid[p]), int(cid[q])) for p, q in pairs])
    if short:
        yield flush()


def _join_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that connect each block (``coarse``, ``block``, ``piece``, sorted) by the sets themselves."""
    common.keep_only("shingles")
    for group in _runs(batches, ["coarse", "block", "piece"]):
        cid = group.column("cid").to_numpy()
        side = group.column("probe").to_numpy(zero_copy_only=False) if "probe" in group.column_names else np.zeros(len(cid), bool)
        labels = group.column("label").to_numpy() if "label" in group.column_names else None
        sets, keep, seen = [], [], set()
        for k, text in enumerate(group.column("text")):
            if (int(cid[k]), bool(side[k])) in seen:
                continue
            s = shingles.shingles(text.as_py())
            if len(s) and shingles.set_id(s) == cid[k]:  # rows that share a document's id may have other texts
                seen.add((int(cid[k]), bool(side[k])))
                sets.append(s)
                keep.append(k)
        if len(sets) < 2:
            continue
        cid, side = cid[keep], side[keep]
        sizes = np.array([len(s) for s in sets])

        def linked(p: int, q: int) -> bool:
            return cid[p] == cid[q] or bool(signature_tree.enough(np.array(signature_tree.common_members(sets[p], sets[q])), sizes[p], sizes[q]))

        parts = signature_tree.Components(len(sets), labels[keep] if labels is not None else None)
        pairs = signature_tree.links(sizes, [shingles.bitmap(s) for s in sets], parts, linked, side if side.any() else None)
        yield _edges([(int(cid[p]), int(cid[q])) for p, q in pairs])


_EDGE = "a long, b long"


def _complete_lists(memberships: DataFrame, signed: DataFrame, labels: DataFrame) -> DataFrame:
    """Joins across the parts of lists that were joined in parts: what is outside a list's largest component against all of its parts."""
    long = memberships.where("parts > 1")
    if long.isEmpty():
        return labels
    known = common.saved(long.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")), "long-lists")
    by = known.groupBy("list", "label").agg(F.count(F.lit(1)).alias("n"))
    main = by.groupBy("list").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    left = common.saved(known.join(main, "list"), "long-lists")
    if left.isEmpty():
        return labels
    strays = left.where("label <> main")
    pieces = strays.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("pieces"))
    left = left.join(pieces, "list")
    piece = F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int")
    members = left.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("probe", F.lit(False))
    probes = left.where("label <> main").withColumn("_piece", piece).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("probe", F.lit(True))
    both = members.unionByName(probes).withColumn("part", (F.col("part") * F.col("pieces") + F.col("_piece")).cast("int")).select("list", "part", "cid", "label", "probe")
    found = both.join(signed, "cid").repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(_join_lists, _EDGE)
    return connected.extended(labels, found)


def _candidates(docs: DataFrame, described: DataFrame, signed: DataFrame) -> DataFrame:
    parts = common.shuffle_partitions(docs.sparkSession)
    gathered = _first_members(_binary(docs), _overfull(described), 2 * parts).repartition(parts, "bucket")
    memberships = common.saved(gathered.mapInArrow(partial(_lists, most=LIST), "list long, part int, parts int, cid long"), "lists").dropDuplicates(["list", "cid"])
    memberships = common.saved(memberships, "lists")
    ready = memberships.select("list", "part", "cid").join(signed, "cid").repartition("list", "part").sortWithinPartitions("list", "part")
    return _complete_lists(memberships, signed, connected.components(ready.mapInArrow(_join_lists, _EDGE)))


def _exact(docs: DataFrame, classes: DataFrame, coarse: DataFrame) -> DataFrame:
    """(node, label): the true components within the coarse ones."""
    blocks = coarse.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    chosen = coarse.join(blocks, "coarse").join(classes.select("cid", F.col("first_doc").alias("doc_id")), "cid").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    texts = _binary(docs).join(chosen.hint("shuffle_hash"), "doc_id").select("cid", "coarse", "block", "blocks", F.lit(0).alias("piece"), "text")
    texts = common.saved(texts, "candidate-texts")

    def joined(df: DataFrame) -> DataFrame:
        return df.repartition("coarse", "block", "piece").sortWithinPartitions("coarse", "block", "piece").mapInArrow(_join_sets, _EDGE)

    labels = connected.components(joined(texts.drop("blocks")))
    several = texts.where("blocks > 1")
    if several.isEmpty():
        return labels
    keys = common.saved(several.select("cid", "coarse", "block").distinct(), "keys")
    labelled = lambda: keys.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))

    first = labelled().groupBy("coarse", "block", "label").agg(F.min("cid").alias("cid"))
    n = first.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    first = first.join(n, "coarse").withColumn("_b", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("n")).cast("int")).select("cid", "_b", "label")
    labels = connected.extended(labels, joined(several.join(first, "cid").withColumn("block", F.col("_b")).drop("_b", "blocks")))

    state = labelled().drop("block")
    by = state.groupBy("coarse", "label").agg(F.count(F.lit(1)).alias("n"))
    main = by.groupBy("coarse").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    open_ = common.saved(state.join(main, "coarse"), "open")
    if open_.isEmpty():
        return labels
    pieces = open_.where("label <> main").groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("pieces"))
    rows = several.join(open_.drop("coarse"), "cid").join(pieces, "coarse")
    members = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("probe", F.lit(False))
    probes = rows.where("label <> main").withColumn("piece", F.pmod(F.xxhash64("cid", F.lit(6)), F.col("pieces")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(True))
    return connected.extended(labels, joined(members.unionByName(probes).drop("blocks", "pieces", "main")))


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cid (the class of its set; null: empty), label (of its component; null: no id or no set), least (id there)."""
    docs = docs.select("doc_id", "text")
    described = common.saved(_binary(docs).mapInArrow(_describe, _DOC), "described")
    table = described.where("segment is null").select("doc_id", "n_shingles", "cid")
    usable = described.where("segment is null and cid is not null and doc_id is not null")
    classes = common.saved(usable.groupBy("cid").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"), F.first("bitmap").alias("bitmap")), "classes")
    signed = classes.select("cid", "n_shingles", "bitmap")
    coarse = _candidates(docs.where("doc_id is not null"), described, signed).select(F.col("node").alias("cid"), F.col("label").alias("coarse"))
    labels = _exact(docs, classes, coarse).withColumnRenamed("node", "cid")
    joined = classes.select("cid", "first_doc").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = joined.groupBy("label").agg(F.min("first_doc").alias("least"))
    of = common.saved(joined.join(least, "label").select("cid", "label", "least"), "components")
    return table.join(of, "cid", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of every document.

    Two documents link if 100 * intersection >= 80 * union of their sets of distinct word 5-grams (A-Z in lower case; a text of fewer
    words has all of them as its one member). A text without words has an empty set and links with nothing: its component is its own id.
    Rows that share an id each link by their own text. A row without id has no links and no component. Other columns are not read.
    """
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return _classified(docs).select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: that with the least id; all columns stay, whatever their names.

    Rows without id stay. Of rows that share an id each goes or stays by its own text: it goes if its component has a lesser id; of rows
    with one id in one component, that with the least text stays, and of those without words, one.
    """
    found = common.saved(_classified(docs).where("doc_id is not null"), "classified")
    again = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    gone = found.where("least < doc_id").select(F.col("doc_id").alias("id"))
    rows = docs.where("doc_id is not null").select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    nameless = docs.where("doc_id is null")  # apart, as a join would deal them to one task
    if again.isEmpty():
        return rows.join(gone.hint("shuffle_hash"), "id", "left_anti").select("row.*").union(nameless)
    again = common.saved(again, "repeated-ids")
    gone = gone.join(again, "id", "left_anti")
    once = rows.join(gone.union(again).hint("shuffle_hash"), "id", "left_anti").select("row.*")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only("shingles")
        for batch in batches:
            sets = [shingles.shingles(t.as_py()) for t in batch.column("text")]
            cid = pa.array([shingles.set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), cid], names=["row", "id", "cid"])

    several = rows.join(again, "id").select("row", "id", F.col("row.text").cast("binary").alias("text"))
    shape = T.StructType([several.schema["row"], T.StructField("id", T.LongType()), T.StructField("cid", T.LongType())])
    own = several.mapInArrow(classes, shape)
    of = found.join(again.withColumnRenamed("id", "doc_id"), "doc_id").select(F.col("doc_id").alias("_id"), F.col("cid").alias("_cid"), "label", "least").distinct()
    kept = own.join(of, (F.col("id") == F.col("_id")) & F.col("cid").eqNullSafe(F.col("_cid"))).where("least is null or least >= id")
    order = Window.partitionBy("id", "label").orderBy("row.text", F.xxhash64(F.col("row").cast("string")))  # rows of one id
    return once.union(kept.withColumn("_place", F.row_number().over(order)).where("_place = 1").select("row.*")).union(nameless)
