"""Sequences, annotations and intervals derived from general tables, for queries and tests; each view in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import intervals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out only where a scan has fewer tasks than there are cores (a small file of one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq): texts in upper case with the four bases alone."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]+", "").alias("seq"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select(F.col("doc_id").alias("seqid"), "seq")


def features(spark: SparkSession, sf_dir: str, seqs: DataFrame | None = None) -> DataFrame:
    """(seqid, source, type, strand, start_pos, end_pos): annotations derived from events.

    Here and below: ``seqs`` are the contigs and ``found`` the features where a caller has them saved, as both are read many times.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    seqs = contigs(spark, sf_dir) if seqs is None else seqs
    sized = seqs.select(F.col("seqid").alias("doc_id"), F.length("seq").cast("long").alias("n")).where("n > 2")
    j = e.join(sized, e.user_id == sized.doc_id)
    start = F.lit(1) + F.col("event_id") % F.col("n")
    return j.select(
        F.col("doc_id").alias("seqid"),
        F.when(F.col("event_id") % 3 == 0, "RefSeq").otherwise("BestRefSeq").alias("source"),
        F.when(F.col("event_type").isin("click", "view", "error"), "exon").otherwise("CDS").alias("type"),
        F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"),
        start.alias("start_pos"),
        F.least(F.col("n"), start + F.floor("value").cast("long")).alias("end_pos"),
    )


def cds_starts(spark: SparkSession, sf_dir: str, seqs: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    f = (features(spark, sf_dir, seqs) if found is None else found).where("type = 'CDS'").select("seqid", "start_pos").distinct()
    return f.join(contigs(spark, sf_dir) if seqs is None else seqs, "seqid").where(intervals.is_start(F.col("seq"), F.col("start_pos"))).select("seqid", "start_pos")


def cds_ends(spark: SparkSession, sf_dir: str, seqs: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    f = (features(spark, sf_dir, seqs) if found is None else found).where("type = 'CDS' AND end_pos >= 3").select("seqid", "end_pos").distinct()
    return f.join(contigs(spark, sf_dir) if seqs is None else seqs, "seqid").where(intervals.is_stop(F.col("seq"), F.col("end_pos"))).select("seqid", "end_pos")


def exon_starts(spark: SparkSession, sf_dir: str, seqs: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    return (features(spark, sf_dir, seqs) if found is None else found).where("type = 'exon'").select("seqid", F.col("start_pos").alias("exon_start")).distinct()


def exon_ends(spark: SparkSession, sf_dir: str, seqs: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    return (features(spark, sf_dir, seqs) if found is None else found).where("type = 'exon'").select("seqid", F.col("end_pos").alias("exon_end")).distinct()


def utr5(spark: SparkSession, sf_dir: str, seqs: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    near = intervals.asof_backward(cds_starts(spark, sf_dir, seqs, found), exon_starts(spark, sf_dir, seqs, found), "seqid", "start_pos", "exon_start")
    return intervals.limited(near.select("seqid", F.col("exon_start").alias("s"), F.col("start_pos").alias("e")), 3, 1600)


def utr3(spark: SparkSession, sf_dir: str, seqs: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    near = intervals.asof_forward(cds_ends(spark, sf_dir, seqs, found), exon_ends(spark, sf_dir, seqs, found), "seqid", "end_pos", "exon_end")
    return intervals.limited(near.select("seqid", F.col("end_pos").alias("s"), F.col("exon_end").alias("e")), 3, 16000)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seqid, s, e): candidate background intervals derived from orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    n = table(spark, sf_dir, "documents").count()
    s = F.lit(1) + (F.col("o_custkey") * 31 + F.col("o_orderkey") * 17) % 400
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % n).alias("seqid"), s.alias("s"), (s + 4 + F.floor("o_totalprice").cast("long") % 12).alias("e"))


SQL = {
    "sequences": "SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents",
    "contigs": "SELECT doc_id AS seqid, seq FROM sequences",
    "features": """SELECT d.doc_id AS seqid, CASE WHEN event_id % 3 = 0 THEN 'RefSeq' ELSE 'BestRefSeq' END AS source,
        CASE WHEN event_type IN ('click', 'view', 'error') THEN 'exon' ELSE 'CDS' END AS type, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
        1 + event_id % length(seq) AS start_pos, least(length(seq), 1 + event_id % length(seq) + CAST(floor(value) AS BIGINT)) AS end_pos
        FROM events e JOIN sequences d ON e.user_id = d.doc_id WHERE length(seq) > 2""",
    "cds_starts": "SELECT DISTINCT f.seqid, start_pos FROM features f JOIN contigs c USING (seqid) WHERE type = 'CDS' AND substring(seq, start_pos, 3) = 'ATG'",
    "cds_ends": "SELECT DISTINCT f.seqid, end_pos FROM features f JOIN contigs c USING (seqid) WHERE type = 'CDS' AND end_pos >= 3 AND substring(seq, end_pos - 2, 3) IN ('TAA', 'TAG', 'TGA')",
    "exon_starts": "SELECT DISTINCT seqid, start_pos AS exon_start FROM features WHERE type = 'exon'",
    "exon_ends": "SELECT DISTINCT seqid, end_pos AS exon_end FROM features WHERE type = 'exon'",
    "utr5": "SELECT c.seqid, x.exon_start - 1 AS s, c.start_pos - 1 AS e FROM cds_starts c ASOF JOIN exon_starts x ON c.seqid = x.seqid AND c.start_pos >= x.exon_start WHERE c.start_pos - x.exon_start > 3 AND c.start_pos - x.exon_start < 1600",
    "utr3": "SELECT c.seqid, c.end_pos - 1 AS s, x.exon_end - 1 AS e FROM cds_ends c ASOF JOIN exon_ends x ON c.seqid = x.seqid AND c.end_pos < x.exon_end WHERE x.exon_end - c.end_pos > 3 AND x.exon_end - c.end_pos < 16000",
    "candidates": "SELECT o_orderkey AS id, o_orderkey % (SELECT count(*) FROM documents) AS seqid, 1 + (o_custkey * 31 + o_orderkey * 17) % 400 AS s, 1 + (o_custkey * 31 + o_orderkey * 17) % 400 + 4 + CAST(floor(o_totalprice) AS BIGINT) % 12 AS e FROM orders",
}


def sql(query: str) -> str:
    """The query with the views it needs, in order of their definition."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in SQL.items()) + " " + query
