"""Bounded samples of labelled and unlabelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 31


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids are of fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def place(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 2**31 - 1 that depends on the id and the seed alone."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(_RANGE))


def share(rows: int, most: int) -> int:
    """The bound for ``place`` under which about ``most`` of ``rows`` rows lie."""
    return _RANGE if rows <= most else int(_RANGE * most / rows)


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with one row for each labelled id: rows without id or label don't count, and among several the least holds."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(F.col(column).cast("int")).alias("label"))
