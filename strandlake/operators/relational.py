"""Row-wise operators on annotation and segment tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators.lineage import cut


def annotations(df: DataFrame, types: tuple[str, ...] = ("exon", "CDS"), source: str | None = None, seqid=None, strand: str | None = None) -> DataFrame:
    """Rows of some types, and of one source, contig and strand where given."""
    tests = [F.col("type").isin(*types)]
    tests += [F.col(c) == v for c, v in (("source", source), ("seqid", seqid), ("strand", strand)) if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests))


def as_numbers(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns as longs; null where that can't be done."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS bigint)") for c in columns})


def without_letters(df: DataFrame, column: str, letters: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [~F.contains(F.col(column), F.lit(x)) for x in letters]))


def fixed(value: Column, digits: int = 3) -> Column:
    """A double with ``digits`` (4 at most) decimals as C's printf writes it: the nearest to its exact binary value, the even one of a tie.

    ``format_string`` rounds the shortest decimal form of a double, so 0.2975, which is a little less in binary, becomes 0.298. That can
    only happen beside a tie, or among more than 15 digits; there the steps are exact: the fraction is taken in two parts that ``10 ** digits`` multiplies without
    rounding. From 2 ** 63 on Spark's own form is used, whose digits after the 17th are zeros.
    """
    if not 0 <= digits <= 4:
        raise ValueError("0 to 4 digits")
    x, unit = value.cast("double"), float(10**digits)
    size = F.abs(x)
    scaled = size * unit
    tie = (size < 2.0**63) & ((scaled >= 1e15) | (F.abs(scaled - F.floor(F.least(scaled, F.lit(2.0**62))) - 0.5) <= scaled * 2.0**-50))
    whole = F.floor(size)
    part = size - whole
    upper = F.floor(part * 2.0**26) / 2.0**26
    high, under = upper * unit, (upper - part) * unit
    down = F.floor(high)
    over = high - down - 0.5
    units = down + ((over > under) | ((over == under) & (F.pmod(down if digits else whole, F.lit(2)) == 1))).cast("long")
    carry = (units >= 10**digits).cast("long")
    point = [F.lit("."), F.lpad((units - carry * 10**digits).cast("string"), digits, "0")] if digits else []
    exact = F.concat(F.when(x < 0, "-").otherwise(""), (whole + carry).cast("string"), *point)
    odd = F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x < 0, "-inf").otherwise("inf"))
    return F.when(x.isNotNull(), odd.when(tie, exact).otherwise(F.format_string(f"%.{digits}f", x)))


def labelled(tables: dict[int, DataFrame], column: str = "target") -> DataFrame:
    """The tables one above the other by column name, each with its label."""
    return reduce(DataFrame.unionByName, [t.withColumn(column, F.lit(k)) for k, t in tables.items()])


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Numbers rows from 0 in an order of columns, with sums of counts by range instead of one global sort task.

    Ranges are cut on the first column; a value of it that very many rows share stays in one range.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    first = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    counted = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(counted.withColumn("_before", before)), "_part").withColumn(name, (F.col("_before") + first).cast("long")).drop("_part", "_n", "_before")


def threshold(score: Column, at: float = 0.5, closed: bool = False) -> Column:
    return F.when(score >= at if closed else score > at, 1).otherwise(0)


def encoded(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Labels as numbers from 0 in their sorted order, however many there are."""
    return df.join(numbered(df.select(column).distinct(), [column], out).withColumn(out, F.col(out).cast("int")), column)


def grid(spark, axes: dict[str, tuple[float, float, float]]) -> DataFrame:
    """All points of a mesh: for each axis (first, last, step), last excluded."""
    out = None
    for name, (low, high, step) in axes.items():
        n = max(0, int(-(-(high - low) // step)))
        axis = F.explode(F.array(*[F.lit(float(low + k * step)) for k in range(n)]))
        out = spark.range(1).select(axis.alias(name)) if out is None else out.withColumn(name, axis)
    return out
