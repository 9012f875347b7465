"""Interval operators: as-of joins, overlap anti joins, range joins, length limits, lookups in sequences.

Intervals are closed and belong to a contig (``seqid``), the key of every join here. Overlap joins bin the axis, so that a contig with many
intervals is dealt out by (contig, bin) and compared within a bin only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.segments import cut as slice_of
from strandlake.operators.lineage import cut

START_CODON = "ATG"
STOP_CODONS = ("TAA", "TAG", "TGA")


def is_start(seq: Column, start: Column) -> Column:
    """Whether the three letters from ``start`` (1-based) on are the start codon."""
    return F.substring(seq, start.cast("int"), F.lit(3)) == START_CODON


def is_stop(seq: Column, end: Column) -> Column:
    """Whether the three letters up to ``end`` (1-based, included) are a stop codon."""
    return (end >= 3) & F.substring(seq, F.greatest(end - 2, F.lit(1)).cast("int"), F.lit(3)).isin(*STOP_CODONS)


def distinct_positions(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def _nearest(probe: DataFrame, ref: DataFrame, by: str, at: str, found: str, forward: bool, width: int) -> DataFrame:
    """Both sides sorted together within a bin of the axis; what a bin doesn't settle comes from the nearest bin with a reference.

    No task holds a whole contig: the bins of one, a row for each, are what its window reads.
    """
    both = probe.select(by, F.col(at).alias("_p"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("_r")).unionByName(
        ref.select(by, F.col(found).alias("_p"), F.lit(0).alias("_k"), F.col(found).cast("long").alias("_r"))
    )
    both = cut(both.withColumn("_bin", F.floor(F.col("_p") / width)))  # read twice
    way = (lambda c: F.col(c).desc()) if forward else F.col
    best = F.min if forward else F.max
    seen = best("_r").over(W.partitionBy(by, "_bin").orderBy(way("_p"), way("_k")).rowsBetween(W.unboundedPreceding, W.currentRow))
    bins = both.groupBy(by, "_bin").agg(best("_r").alias("_end"))
    carried = bins.select(by, "_bin", best("_end").over(W.partitionBy(by).orderBy(way("_bin")).rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    near = both.withColumn("_f", seen).where("_k = 1").join(carried, [by, "_bin"]).withColumn("_f", F.coalesce("_f", "_carried"))
    return near.where("_f IS NOT NULL").select(by, F.col("_p").alias(at), F.col("_f").alias(found))


def asof_backward(probe: DataFrame, ref: DataFrame, by: str, at: str, found: str, width: int = 1 << 14) -> DataFrame:
    """For each row of ``probe`` (by, at) the greatest ``found`` of ``ref`` (by, found) that is <= at. Rows without one go.

    No pairs are made. Rows without a key or a place match nothing. ``width``: length of a bin.
    """
    return _nearest(probe, ref, by, at, found, False, width)


def asof_forward(probe: DataFrame, ref: DataFrame, by: str, at: str, found: str, width: int = 1 << 14) -> DataFrame:
    """For each row of ``probe`` the least ``found`` of ``ref`` that is > at (not equal). Rows without one go."""
    return _nearest(probe, ref, by, at, found, True, width)


def limited(df: DataFrame, least: int, most: int, start: str = "s", end: str = "e", shift: int = 1) -> DataFrame:
    """Rows with least < end - start < most (both strict), both bounds moved down by ``shift``."""
    size = F.col(end) - F.col(start)
    return df.where((size > least) & (size < most)).withColumn(start, F.col(start) - shift).withColumn(end, F.col(end) - shift)


def overlap(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """Closed intervals: touching ones overlap."""
    return F.greatest(s, s2) <= F.least(e, e2)


def _binned(df: DataFrame, s: str, e: str, width: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))


def without_overlap(df: DataFrame, others: DataFrame, id: str = "id", by: str = "seqid", s: str = "s", e: str = "e", width: int | None = 1 << 14) -> DataFrame:
    """Rows of ``df`` that overlap no interval of ``others`` on their contig. ``width``: length of a bin, or None to join by contig alone."""
    o = others.select(F.col(by).alias("_by"), F.col(s).alias("_s"), F.col(e).alias("_e")).where("_s <= _e").distinct()
    if width is None:
        return df.join(o, (F.col(by) == F.col("_by")) & overlap(F.col(s), F.col(e), F.col("_s"), F.col("_e")), "left_anti")
    o = _binned(o, "_s", "_e", width).withColumnRenamed("_bin", "_obin")
    mine = _binned(df.where(F.col(s) <= F.col(e)).select(id, by, s, e), s, e, width)
    hit = mine.join(o, (F.col(by) == F.col("_by")) & (F.col("_bin") == F.col("_obin")) & overlap(F.col(s), F.col(e), F.col("_s"), F.col("_e")), "left_semi")
    return df.join(hit.select(id).distinct(), id, "left_anti")


def without_later_overlap(df: DataFrame, id: str = "id", by: str = "seqid", s: str = "s", e: str = "e", width: int | None = 1 << 14) -> DataFrame:
    """Rows that no later row (greater id) of their contig overlaps, whether or not that one is kept."""
    o = df.select(F.col(id).alias("_id"), F.col(by).alias("_by"), F.col(s).alias("_s"), F.col(e).alias("_e"))
    meets = (F.col(by) == F.col("_by")) & (F.col("_id") > F.col(id)) & overlap(F.col(s), F.col(e), F.col("_s"), F.col("_e"))
    if width is None:
        return df.join(o, meets, "left_anti")
    o = _binned(o.where("_s <= _e"), "_s", "_e", width).withColumnRenamed("_bin", "_obin")
    mine = _binned(df.where(F.col(s) <= F.col(e)).select(id, by, s, e), s, e, width)
    hit = mine.join(o, meets & (F.col("_bin") == F.col("_obin")), "left_semi")
    return df.join(hit.select(id).distinct(), id, "left_anti")


def positions_near(positions: DataFrame, regions: DataFrame, by: str = "seqid", at: str = "pos", id: str = "id", s: str = "s", e: str = "e", pad: int = 2, width: int = 1 << 14) -> DataFrame:
    """(id, at) of the positions in the closed range of a region widened by ``pad`` times its length on both sides."""
    size = F.col(e) - F.col(s)
    r = regions.select(F.col(by).alias("_by"), id, (F.col(s) - pad * size).alias("_a"), (F.col(e) + pad * size).alias("_b")).where("_a <= _b")
    r = _binned(r, "_a", "_b", width)
    p = positions.select(by, at).withColumn("_pbin", F.floor(F.col(at) / width))
    return p.join(r, (F.col(by) == F.col("_by")) & (F.col("_pbin") == F.col("_bin")) & F.col(at).between(F.col("_a"), F.col("_b"))).select(id, at)


def looked_up(df: DataFrame, sequences: DataFrame, by: str = "seqid", s: str = "s", e: str = "e", seq: str = "seq", out: str = "segment") -> DataFrame:
    """Adds the half-open slice [s, e) (0-based) of the contig's sequence; the join strategy is Catalyst's choice by size."""
    return df.join(sequences.select(by, seq), by).withColumn(out, slice_of(F.col(seq), F.col(s), F.col(e))).drop(seq)


def chunked(sequences: DataFrame, by: str = "seqid", seq: str = "seq", size: int = 1 << 20, overlap_by: int = 1 << 10) -> DataFrame:
    """(by, chunk_start, seq): long contigs in pieces that overlap, so that slices up to ``overlap_by`` lie in one piece."""
    pieces = sequences.withColumn("chunk_start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.length(seq) - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))))
    return pieces.select(by, "chunk_start", slice_of(F.col(seq), F.col("chunk_start"), F.col("chunk_start") + size + overlap_by).alias(seq))


def looked_up_in_chunks(df: DataFrame, chunks: DataFrame, by: str = "seqid", s: str = "s", e: str = "e", seq: str = "seq", out: str = "segment", size: int = 1 << 20) -> DataFrame:
    """As ``looked_up``, from pieces: each interval meets the one piece that it begins in."""
    keyed = df.withColumn("chunk_start", F.floor(F.greatest(F.col(s), F.lit(0)) / size) * size)
    return keyed.join(chunks, [by, "chunk_start"]).withColumn(out, slice_of(F.col(seq), F.col(s) - F.col("chunk_start"), F.col(e) - F.col("chunk_start"))).drop(seq, "chunk_start")


def zipped(a: DataFrame, b: DataFrame, by: str, left: str, right: str, width: int = 1 << 14) -> DataFrame:
    """Pairs of the k-th least of two lists of positions for each key; the longer list is cut to the shorter.

    Ranks are those in a bin of the axis plus the sizes of the bins before. Rows without a key or a position have no rank.
    """

    def rank(df: DataFrame, c: str) -> DataFrame:
        rows = cut(df.select(by, c, F.floor(F.col(c) / width).alias("_bin")))  # read twice
        size = rows.groupBy(by, "_bin").agg(F.count(F.lit(1)).alias("_size"))
        before = F.coalesce(F.sum("_size").over(W.partitionBy(by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        own = F.row_number().over(W.partitionBy(by, "_bin").orderBy(c))
        return rows.withColumn("_n", own).join(size.select(by, "_bin", before.alias("_before")), [by, "_bin"]).select(by, c, (F.col("_before") + F.col("_n")).alias("_n"))

    return rank(a.where(F.col(left).isNotNull()), left).join(rank(b.where(F.col(right).isNotNull()), right), [by, "_n"]).select(by, left, right)


def codons(sequences: DataFrame, signs: tuple[str, ...], by: str = "seqid", seq: str = "seq", size: int = 1 << 14) -> DataFrame:
    """(by, pos, codon): the 0-based places of the given codons in each sequence, found in pieces of ``size`` letters and the two after them."""
    if size < 2:
        raise ValueError("a piece has two letters at least")
    parts = sequences.where(F.length(seq) >= 3).select(by, F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_parts"))
    after = lambda k: F.coalesce(F.substring(F.get(F.col("_parts"), k + 1), 1, 2), F.lit(""))
    pieces = parts.select(by, F.posexplode(F.transform("_parts", lambda x, k: F.concat(x, after(k)))).alias("_k", "_piece")).where(F.length("_piece") >= 3)
    first = F.col("_k").cast("long") * size
    at = F.sequence(F.lit(0), F.length("_piece") - 3)
    found = F.filter(F.transform(at, lambda i: F.struct((first + i).alias("pos"), F.substring(F.col("_piece"), i + 1, F.lit(3)).alias("codon"))), lambda x: x["codon"].isin(*signs))
    return pieces.select(by, F.inline(found))
