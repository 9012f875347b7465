"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source is dealt into shards, and each shard is one stream of its documents' words in the order of a seeded hash, cut into blocks of
equal length. The blocks of the whole mix are apportioned to the sources by the highest quotients target / (2 k + 1), those of a source
to its shards in the same way, at most three per block. A quota beyond the number of a shard's blocks takes all of them as often as it
goes; the rest is a selection of blocks at even steps from a seeded phase, which in a stream ordered by a hash is a random sample.

Blocks are never made as rows: what a document gives follows from its place in the stream. Places are sums over the documents before it,
taken in bounded groups (a range of hash values of a shard) and then over the groups.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm import common

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
#: A shard has about 2**20 words at least, and 2**34 at most; a source has 16 shards unless that would make them too small or large.
SHARDS, SHARD_BITS, MOST_SHARD_BITS = 16, 20, 34
GROUP_ROWS = 1024


def targets(sizes: list[int]) -> list[float]:
    """Targets of sources in their order: 100 % of all sizes by weight, none above MOST times its size, the excess shared anew."""
    weight = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sizes))]
    rest, free, out = sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while free:
        each = Fraction(rest, sum(weight[k] for k in free))
        over = {k for k in free if each * weight[k] > MOST * sizes[k]}
        for k in over or free:
            out[k] = Fraction(MOST * sizes[k]) if over else each * weight[k]
        rest -= sum(MOST * sizes[k] for k in over)
        free = free - over if over else set()
    return [float(x) for x in out]


def sainte_lague(weights: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients weight / (2 k + 1), lower places first among equals, none above its bound in ``most``.

    Begins near the proportional share instead of at 0; exchanges at the end make sure that the highest quotients hold.
    """
    seats = min(seats, sum(m for m, w in zip(most, weights) if w > 0))
    total = sum(weights)
    if not seats or not total:
        return [0] * len(weights)
    got = [min(m, max(0, int(w * seats / total) - 1)) for w, m in zip(weights, most)]
    upper = [(-Fraction(w) / (2 * g + 1), k) for k, (w, g, m) in enumerate(zip(weights, got, most)) if w > 0 and g < m]
    heapq.heapify(upper)
    left = seats - sum(got)

    def give() -> None:
        _, k = heapq.heappop(upper)
        got[k] += 1
        if got[k] < most[k]:
            heapq.heappush(upper, (-Fraction(weights[k]) / (2 * got[k] + 1), k))

    for _ in range(left):
        give()
    for _ in range(max(0, -left)):
        k = min((k for k in range(len(got)) if got[k]), key=lambda k: (Fraction(weights[k]) / (2 * got[k] - 1), -k))
        got[k] -= 1
    while True:
        given = [((-Fraction(weights[k]) / (2 * got[k] - 1), k)) for k in range(len(got)) if got[k]]
        wanted = [((-Fraction(weights[k]) / (2 * got[k] + 1), k)) for k in range(len(got)) if weights[k] > 0 and got[k] < most[k]]
        if not given or not wanted or max(given) < min(wanted):
            return got
        got[max(given)[1]] -= 1
        got[min(wanted)[1]] += 1


def block_words(sizes: list[int]) -> int:
    """Words of a block: 2048, or less if that is over 1/256 of the smallest source that has words; 16 at least."""
    return max(16, min(2048, min((s for s in sizes if s), default=0) // 256))


def _place(size: Column) -> Column:
    return F.xxhash64(F.col("doc_id"), size, F.lit(SEED))


def _sources(sized: DataFrame) -> DataFrame:
    """A row for each source, in code point order with null last: its number, size, target, shards, and groups of a shard."""
    got = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()  # one row a source
    got.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in got]
    rows = []
    for k, (r, target) in enumerate(zip(got, targets(sizes))):
        shards = max(1, min(SHARDS, r["size"] >> SHARD_BITS), -(-r["size"] >> MOST_SHARD_BITS) if r["size"] >> MOST_SHARD_BITS > SHARDS else 1)
        rows.append((r.source, k, r["size"], target, shards, max(1, -(-r["rows"] // (shards * GROUP_ROWS)))))
    schema = "_source string, _src int, source_size long, target double, _shards int, _groups int"
    return sized.sparkSession.createDataFrame(rows, schema)


def placed(docs: DataFrame, sized: DataFrame, block: int | None = None) -> tuple[DataFrame, int]:
    """``docs`` (with doc_id, source, size) with the columns of the plan, and the words of a block.

    The plan: source_size, target, _at (first place in the stream), _n (blocks of the shard), _full (times that all of them are
    taken), _more (how many once more), _phase.
    """
    spark = docs.sparkSession
    sources = _sources(sized)
    listed = sources.collect()
    block = block or block_words([r.source_size for r in listed])

    def dealt(df: DataFrame) -> DataFrame:
        h = _place(F.col("size"))
        df = df.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return df.withColumn("_h", h).withColumn("_shard", F.pmod("_h", "_shards").cast("int")).withColumn("_group", F.pmod(F.shiftrightunsigned("_h", 20), "_groups").cast("int"))

    groups = dealt(sized).groupBy("_src", "_shard", "_group").agg(F.sum("size").alias("_words"))
    groups = common.saved(groups, "mix-groups")
    streams = groups.groupBy("_src", "_shard").agg(F.sum("_words").alias("words")).collect()  # sources x shards
    streams.sort(key=lambda r: (r._src, r._shard))
    of: dict[int, list] = {k: [r for r in streams if r._src == k] for k in range(len(listed))}
    n = {(r._src, r._shard): -(-r.words // block) for r in streams}
    most = [MOST * sum(n[k, r._shard] for r in of[k]) for k in of]
    goal = [r.target for r in listed]
    quotas = []
    for k, seats in enumerate(sainte_lague(goal, round(sum(goal) / block), most)):
        shards = of[k]
        for r, q in zip(shards, sainte_lague([float(r.words) for r in shards], seats, [MOST * n[k, r._shard] for r in shards])):
            m = n[k, r._shard]
            full, more = divmod(q, m) if m else (0, 0)
            quotas.append((k, r._shard, m, full, more, (k * 7919 + r._shard * 104729 + SEED * 1299709) % max(m, 1)))
    quotas = spark.createDataFrame(quotas, "_src int, _shard int, _n long, _full long, _more long, _phase long")
    before = W.partitionBy("_src", "_shard").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    bases = groups.withColumn("_base", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words").join(F.broadcast(quotas), ["_src", "_shard"])
    inner = W.partitionBy("_src", "_shard", "_group").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    out = dealt(docs).withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(bases, ["_src", "_shard", "_group"])
    return out.withColumn("_at", F.col("_base") + F.col("_in")).drop("_in", "_base", "_h", "_src", "_shard", "_group", "_shards", "_groups"), block


def taken(block: int) -> Column:
    """Words that the mix takes from a document, by the plan's columns: its whole blocks by a difference, the two at its ends alone."""
    first, last = f"(_at div {block})", f"((_at + size - 1) div {block})"
    before = lambda j: f"((({j}) * _more + _phase) div greatest(_n, 1))"  # noqa: E731  chosen ones before block j, up to a constant
    chosen = lambda j: f"({before(f'{j} + 1')} - {before(j)})"
    one = f"{chosen(first)} * size"
    inside = f"({before(last)} - {before(f'{first} + 1')}) * {block}"
    many = f"{chosen(first)} * (({first} + 1) * {block} - _at) + {inside} + {chosen(last)} * (_at + size - {last} * {block})"
    return F.expr(f"CASE WHEN size = 0 THEN 0L WHEN {first} = {last} THEN _full * size + {one} ELSE _full * size + {many} END").cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", common.n_words(F.col("text")).alias("size"))


def mix(docs: DataFrame, block: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document.

    A null text has size 0 and gives nothing; a null source is a source of its own, after the others. Rows that share an id are placed
    each for itself. Reruns take the same words, however the rows are dealt out. Other columns are not read. ``block``: words of a block;
    if it is not given, ``block_words`` of the sources' sizes.
    """
    sized = common.saved(_sized(docs), "mix-sizes")
    if sized.isEmpty():
        return sized.select("doc_id", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    plan, block = placed(sized, sized, block)
    return plan.select("doc_id", "size", "source_size", "target", taken(block).alias("taken"))


def chosen_ranges(at: int, size: int, n: int, more: int, phase: int, block: int) -> list[tuple[int, int]]:
    """Ranges of a document's words that lie in blocks taken once more."""
    out: list[tuple[int, int]] = []
    for j in range(at // block, (at + size - 1) // block + 1) if size and more else ():
        if ((j + 1) * more + phase) // n > (j * more + phase) // n:
            a, b = max(0, j * block - at), min(size, (j + 1) * block - at)
            out = [*out[:-1], (out[-1][0], b)] if out and out[-1][1] == a else [*out, (a, b)]
    return out


def mixed(docs: DataFrame, block: int | None = None) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies of a document as often as all its blocks are taken, and one row with
    the words of the blocks that are taken once more (stretches that don't touch are parted by a line end). What gives no word goes."""
    sized = common.saved(_sized(docs), "mix-sizes")
    if sized.isEmpty():
        return docs.limit(0)
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "source", common.n_words(F.col("text")).alias("size"))
    plan, block = placed(keyed, sized, block)
    schema = docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only()
        for batch in batches:
            row = batch.column("_row")
            names = [f.name for f in row.type]
            columns = dict(zip(names, row.flatten()))
            take: list[int] = []
            texts: list[str] = []
            text = columns["text"]
            for k, (size, at, n, full, more, phase) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("size", "_at", "_n", "_full", "_more", "_phase")))):
                ranges = chosen_ranges(at, size, n, more, phase, block)
                copies = (full + (ranges == [(0, size)])) if size else 0
                take += [k] * copies
                texts += [text[k].as_py()] * copies
                if ranges and ranges != [(0, size)]:
                    take.append(k)
                    texts.append(_stretches(text[k].as_py(), ranges))
            at_rows = pa.array(take, pa.int64())
            out = {c: v.take(at_rows) for c, v in columns.items()} | {"text": pa.array(texts, columns["text"].type)}
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(out["n_chars"].type)
            yield pa.RecordBatch.from_pydict(out)

    return plan.select("_row", "size", "_at", "_n", "_full", "_more", "_phase").mapInArrow(rows, schema)


def _stretches(text: str, ranges: list[tuple[int, int]]) -> str:
    raw = text.encode()
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    return "\n".join(raw[words[a][0] : words[b - 1][1]].decode() for a, b in ranges)
