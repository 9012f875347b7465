"""Scanning sequences: grids of positions, centred windows, scores by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.segments import cut


def positions(df: DataFrame, step: int, s: str = "s", e: str = "e", out: str = "pos") -> DataFrame:
    """A row for each place from s - 2 L to e + 2 L (not included), L = e - s, every ``step`` places."""
    size = F.col(e) - F.col(s)
    first, last = F.col(s) - 2 * size, F.col(e) + 2 * size - 1
    return df.where(size > 0).withColumn(out, F.explode(F.sequence(first, last, F.lit(step).cast("long"))))


def windows(df: DataFrame, widths: list[int], out: str = "window") -> DataFrame:
    return df.withColumn(out, F.explode(F.array(*[F.lit(w) for w in widths])))


def centred(seq: Column, pos: Column, width: Column) -> Column:
    """The letters of [pos - width // 2, pos + width // 2): an odd width reads one less."""
    half = F.floor(width / 2)
    return cut(seq, pos - half, pos + half)


def scan(regions: DataFrame, sequences: DataFrame, widths: list[int], step: int, by: str = "seqid") -> DataFrame:
    """(id, by, pos, window, sub): every window at every place around every region.

    What a region's windows can read is cut from the sequence once; places and windows are then made on that short stretch.
    """
    size, reach = F.col("e") - F.col("s"), max(widths, default=0) // 2
    first = F.greatest(F.col("s") - 2 * size - reach, F.lit(0))
    near = regions.where(size > 0).join(sequences.select(by, "seq"), by)
    near = near.select("id", by, "s", "e", first.cast("long").alias("_first"), cut(F.col("seq"), first, F.col("e") + 2 * size + reach).alias("_near"))
    grid = windows(positions(near, step), widths)
    return grid.select("id", by, "pos", "window", centred(F.col("_near"), F.col("pos") - F.col("_first"), F.col("window")).alias("sub"))


def by_position(scored: DataFrame, score: str = "score", id: str = "id") -> DataFrame:
    """Mean score over the windows at each place."""
    return scored.groupBy(id, "pos").agg(F.avg(score).alias("mean_score"))
