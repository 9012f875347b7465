"""Readers and writers: sequences, annotations, tables, arrays, configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import schemas


def read_fasta(spark: SparkSession, path: str, last_only: bool = False) -> DataFrame:
    """(seqid, seq): a row for each record; the id is the header's first word. Records are split by the reader, not in one task.

    ``last_only``: only the last record of the file, by its place.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    header = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.expr("substring(_t, length(_h) + 1)"), r"\s", "")
    rows = raw.where(F.length(F.trim("value")) > 0).select(text.alias("_t"), header.alias("_h"), F.monotonically_increasing_id().alias("_n"))
    out = rows.select(F.split("_h", r"\s+")[0].alias("seqid"), body.alias("seq"), "_n")
    return out.orderBy(F.col("_n").desc()).limit(1).drop("_n") if last_only else out.drop("_n")


def write_fasta(df: DataFrame, path: str, line: int = 60) -> None:
    """Records with lines of a fixed length."""
    body = F.regexp_replace("seq", f"(.{{{line}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), "seqid", F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=schemas.ANNOTATION, quote="", nullValue=".")


def write_annotations(df: DataFrame, path: str) -> None:
    df.select([x.split()[0] for x in schemas.ANNOTATION.split(", ")]).write.mode("overwrite").csv(path, sep="\t", quote="", nullValue=".", emptyValue="")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of files with headers; one file only if asked."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_arrays(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def values(df: DataFrame, most: int = 100_000) -> list[tuple]:
    """The rows of a small table as tuples; raises beyond ``most`` rows instead of filling the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return [tuple(r) for r in rows]
