"""One query for each operator on the driver's tables, with the SQL that must return the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import fixtures as fx
from strandlake.functions import kmers, segments
from strandlake.operators import intervals, relational, sampling, stats, windows
from strandlake.operators.lineage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name; ``sql`` may use the derived views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = fx.sql(sql)
        return f

    return add


SIGNS = kmers.vocabulary()
_VALUES = ", ".join(f"('{k}')" for k in SIGNS)
_COUNT = "(length(seq) - length(replace(seq, kmer, ''))) // length(kmer)"
_KMERS = f"""SELECT doc_id, kmer, cnt, CASE WHEN cnt > 0 THEN cnt / n ELSE 0.0 END AS p FROM (
    SELECT *, sum(cnt) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, kmer, CAST({_COUNT} AS BIGINT) AS cnt FROM sequences, (VALUES {_VALUES}) v(kmer)))"""


@query(f"SELECT doc_id, kmer, cnt, round(p, 6) AS frequency, round(CASE WHEN p > 0 THEN -p * ln(p) / ln(4) ELSE 0.0 END, 6) AS entropy FROM ({_KMERS})")
def kmer_entropy(spark, d):  # F1, F2, F3, F4, J8, A4
    t = kmers.long_form(fx.sequences(spark, d), "doc_id")
    return t.select("doc_id", "kmer", "cnt", F.round("frequency", 6).alias("frequency"), F.round("entropy", 6).alias("entropy"))


@query("SELECT doc_id, " + ", ".join(f"round(max(CASE WHEN kmer = '{k}' THEN CASE WHEN p > 0 THEN -p * ln(p) / ln(4) ELSE 0.0 END END), 6) AS \"{k}\"" for k in SIGNS) + f" FROM ({_KMERS}) GROUP BY doc_id")
def kmer_features_wide(spark, d):  # F5
    return kmers.wide(fx.sequences(spark, d), ["doc_id"], digits=6)


@query(f"SELECT kmer, CAST(sum({_COUNT}) AS BIGINT) AS cnt FROM sequences, (VALUES {_VALUES}) v(kmer) GROUP BY kmer")
def kmer_totals(spark, d):  # F2
    c = fx.sequences(spark, d).select(F.array(*[kmers.count_of(F.col("seq"), k) for k in SIGNS]).alias("c")).agg(*[F.sum(F.col("c")[k]).alias(s) for k, s in enumerate(SIGNS)])
    return c.select(F.inline(F.array(*[F.struct(F.lit(s).alias("kmer"), F.coalesce(F.col(s), F.lit(0)).alias("cnt")) for s in SIGNS])))


@query("SELECT lower(substring(seq, i, 3)) AS token, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM sequences WHERE length(seq) >= 3) GROUP BY 1")
def trigram_counts(spark, d):  # A7
    return kmers.trigrams(fx.sequences(spark, d))


@query("SELECT DISTINCT lower(substring(seq, i, 3)) AS token FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM sequences WHERE length(seq) >= 3)")
def token_set(spark, d):  # U3, F9
    return kmers.trigrams(fx.sequences(spark, d)).select("token")


@query("SELECT seqid, type, start_pos, end_pos FROM features WHERE type IN ('exon', 'CDS') AND source = 'BestRefSeq' AND strand = '+'")
def annotation_filter(spark, d):  # P1
    return relational.annotations(fx.features(spark, d), source="BestRefSeq", strand="+").select("seqid", "type", "start_pos", "end_pos")


@query("SELECT seqid, type, strand, start_pos, end_pos FROM features WHERE type IN ('exon', 'CDS') AND source = 'BestRefSeq'")
def annotation_filter_both_strands(spark, d):  # P2
    return relational.annotations(fx.features(spark, d), source="BestRefSeq").select("seqid", "type", "strand", "start_pos", "end_pos")


@query("SELECT seqid, type, CAST(count(*) AS BIGINT) AS n FROM features GROUP BY ALL")
def annotation_counts(spark, d):  # A3
    return fx.features(spark, d).groupBy("seqid", "type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END || CAST(user_id AS VARCHAR) AS BIGINT) AS start FROM events")
def cast_positions(spark, d):  # P3
    text = F.concat(F.when(F.col("event_id") % 7 == 0, "x").otherwise(""), F.col("user_id").cast("string"))
    return relational.as_numbers(fx.table(spark, d, "events").select("event_id", text.alias("start")), "start")


@query("SELECT seqid, start_pos FROM cds_starts")
def start_codons(spark, d):  # P4, F6
    return fx.cds_starts(spark, d)


@query("SELECT seqid, end_pos FROM cds_ends")
def stop_codons(spark, d):  # P5
    return fx.cds_ends(spark, d)


@query("SELECT id, s - 1 AS s, e - 1 AS e FROM candidates WHERE e - s > 6 AND e - s < 12")
def length_limit(spark, d):  # P6
    return intervals.limited(fx.candidates(spark, d), 6, 12).select("id", "s", "e")


@query("SELECT doc_id, CAST(length(seq) AS BIGINT) AS n FROM sequences WHERE length(seq) BETWEEN 9 AND 300")
def length_range(spark, d):  # P7, F7
    return fx.sequences(spark, d).select("doc_id", F.length("seq").cast("long").alias("n")).where(F.col("n").between(9, 300))


@query("SELECT doc_id FROM documents WHERE text NOT LIKE '%N%' AND text NOT LIKE '%R%'")
def contains_filter(spark, d):  # P8, F8
    return relational.without_letters(fx.table(spark, d, "documents").select("doc_id", "text"), "text", "NR").select("doc_id")


@query("SELECT doc_id, lang, source FROM documents")
def drop_columns(spark, d):  # P9
    return fx.table(spark, d, "documents").drop("text", "n_chars")


@query("SELECT seqid, s, e, 1 AS target FROM utr5 UNION ALL SELECT seqid, s, e, 2 FROM utr3 UNION ALL SELECT seqid, s, e, 0 FROM candidates")
def labelled_union(spark, d):  # P10, U1
    return relational.labelled({1: fx.utr5(spark, d), 2: fx.utr3(spark, d), 0: fx.candidates(spark, d).select("e", "s", "seqid")})


_CODONS = "SELECT seqid, CAST(i AS BIGINT) AS pos, substring(seq, i + 1, 3) AS codon FROM (SELECT seqid, seq, unnest(range(0, length(seq) - 2)) AS i FROM contigs WHERE length(seq) >= 3) WHERE substring(seq, i + 1, 3)"


@query(f"SELECT seqid, pos, codon FROM ({_CODONS} IN ('ATG', 'TAA', 'TAG', 'TGA'))")
def codon_scan(spark, d):  # Q12
    return intervals.codons(fx.contigs(spark, d), (intervals.START_CODON, *intervals.STOP_CODONS))


@query(f"SELECT c.id, p.pos FROM candidates c JOIN ({_CODONS} = 'ATG') p ON c.seqid = p.seqid AND p.pos BETWEEN c.s - 2 * (c.e - c.s) AND c.e + 2 * (c.e - c.s)")
def range_join(spark, d):  # J5, P11
    return intervals.positions_near(intervals.codons(fx.contigs(spark, d), ("ATG",)), fx.candidates(spark, d))


@query("SELECT CAST(x AS DOUBLE) AS x, CAST(y * 0.5 AS DOUBLE) AS y FROM range(0, 10) a(x), range(0, 8) b(y)")
def mesh_grid(spark, d):  # P12
    return relational.grid(spark, {"x": (0, 10, 1), "y": (0, 4, 0.5)})


@query("SELECT event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS open, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS closed FROM events")
def threshold(spark, d):  # P13
    v = F.col("value")
    return fx.table(spark, d, "events").select("event_id", relational.threshold(v, 50.0).alias("open"), relational.threshold(v, 50.0, closed=True).alias("closed"))


@query("SELECT doc_id, CAST(((1000 - n) - (1000 - n) % 2) // 2 AS BIGINT) AS pre, CAST(((1000 - n) + (1000 - n) % 2) // 2 AS BIGINT) AS after FROM (SELECT doc_id, length(seq) AS n FROM sequences) WHERE n <= 1000")
def parity_halves(spark, d):  # P14
    pre, after = segments.halves(F.length("seq"))
    return fx.sequences(spark, d).where(F.length("seq") <= 1000).select("doc_id", pre.alias("pre"), after.alias("after"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, row_number() OVER (ORDER BY doc_id) - 1 < 0.5 * count(*) OVER () AS is_region FROM documents")
def row_index_filter(spark, d):  # P15
    t = relational.numbered(fx.table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return t.join(F.broadcast(t.agg(F.count(F.lit(1)).alias("n")))).select("row_id", "doc_id", (F.col("row_id") < 0.5 * F.col("n")).alias("is_region"))


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM events")
def label_encode(spark, d):  # P16
    return relational.encoded(fx.table(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", "code")


@query("SELECT c.seqid, c.start_pos, x.exon_start FROM cds_starts c ASOF JOIN exon_starts x ON c.seqid = x.seqid AND c.start_pos >= x.exon_start")
def asof_backward(spark, d):  # J1, O4, W5
    return intervals.asof_backward(fx.cds_starts(spark, d), fx.exon_starts(spark, d), "seqid", "start_pos", "exon_start")


@query("SELECT c.seqid, c.end_pos, x.exon_end FROM cds_ends c ASOF JOIN exon_ends x ON c.seqid = x.seqid AND c.end_pos < x.exon_end")
def asof_forward(spark, d):  # J2, O4, W5
    return intervals.asof_forward(fx.cds_ends(spark, d), fx.exon_ends(spark, d), "seqid", "end_pos", "exon_end")


@query("SELECT seqid, s, e FROM utr5")
def utr5_regions(spark, d):  # J1, P6
    return fx.utr5(spark, d)


@query("SELECT seqid, s, e FROM utr3")
def utr3_regions(spark, d):  # J2, P6
    return fx.utr3(spark, d)


_FREE = "SELECT c.* FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM {} u WHERE u.seqid = c.seqid AND greatest(u.s, c.s) <= least(u.e, c.e))"


@query(f"SELECT id, seqid, s, e FROM ({_FREE.format('utr5')}) c WHERE NOT EXISTS (SELECT 1 FROM utr3 u WHERE u.seqid = c.seqid AND greatest(u.s, c.s) <= least(u.e, c.e))")
def overlap_anti_join(spark, d):  # J3
    return intervals.without_overlap(intervals.without_overlap(fx.candidates(spark, d), fx.utr5(spark, d)), fx.utr3(spark, d))


@query(f"SELECT id, seqid, s, e FROM ({_FREE.format('utr5')}) c")
def overlap_anti_join_by_contig(spark, d):  # J3 without bins
    return intervals.without_overlap(fx.candidates(spark, d), fx.utr5(spark, d), width=None)


@query("SELECT id, seqid, s, e FROM candidates a WHERE NOT EXISTS (SELECT 1 FROM candidates b WHERE b.seqid = a.seqid AND b.id > a.id AND greatest(a.s, b.s) <= least(a.e, b.e))")
def later_row_anti_join(spark, d):  # J4
    return intervals.without_later_overlap(fx.candidates(spark, d))


_SLICE = "CASE WHEN least({e}, length(seq)) > greatest({s}, 0) THEN substring(seq, CAST(greatest({s}, 0) + 1 AS BIGINT), CAST(least({e}, length(seq)) - greatest({s}, 0) AS BIGINT)) ELSE '' END"


@query(f"SELECT id, seqid, {_SLICE.format(s='s', e='e')} AS segment FROM candidates JOIN contigs USING (seqid)")
def sequence_lookup(spark, d):  # J6, F6
    return intervals.looked_up(fx.candidates(spark, d), fx.contigs(spark, d)).select("id", "seqid", "segment")


@query(f"SELECT id, seqid, {_SLICE.format(s='s', e='e')} AS segment FROM candidates JOIN contigs USING (seqid) WHERE s < length(seq)")
def sequence_lookup_in_chunks(spark, d):  # J6 for long contigs
    chunks = intervals.chunked(fx.contigs(spark, d), size=128, overlap_by=64)
    return intervals.looked_up_in_chunks(fx.candidates(spark, d), chunks, size=128).where("segment <> ''").select("id", "seqid", "segment")


@query("SELECT a.seqid, a.start_pos, b.end_pos FROM (SELECT *, row_number() OVER (PARTITION BY seqid ORDER BY start_pos) AS n FROM cds_starts) a JOIN (SELECT *, row_number() OVER (PARTITION BY seqid ORDER BY end_pos) AS n FROM cds_ends) b USING (seqid, n)")
def positional_zip(spark, d):  # J7
    return intervals.zipped(fx.cds_starts(spark, d), fx.cds_ends(spark, d), "seqid", "start_pos", "end_pos")


_GRID = "SELECT id, seqid, pos, w FROM (SELECT id, seqid, unnest(range(s - 2 * (e - s), e + 2 * (e - s), 5)) AS pos FROM candidates WHERE e > s), (VALUES (5), (10), (25)) v(w)"
_SCAN = f"SELECT id, pos, w, {_SLICE.format(s='(pos - w // 2)', e='(pos + w // 2)')} AS sub FROM ({_GRID}) JOIN contigs USING (seqid)"


def _scan(spark, d):
    return windows.scan(fx.candidates(spark, d), fx.contigs(spark, d), [5, 10, 25], 5)


@query(f"SELECT id, CAST(pos AS BIGINT) AS pos, CAST(w AS INTEGER) AS window, sub FROM ({_SCAN})")
def scan_windows(spark, d):  # J9, W2, W3
    return _scan(spark, d).select("id", "pos", "window", "sub")


_GC = "(length(sub) - length(replace(replace(sub, 'G', ''), 'C', ''))) / greatest(length(sub), 1)"


@query(f"SELECT id, CAST(pos AS BIGINT) AS pos, round(avg({_GC}), 6) AS mean_score FROM ({_SCAN}) GROUP BY ALL")
def mean_over_windows(spark, d):  # A5, W4
    gc = (F.length("sub") - F.length(F.translate("sub", "GC", ""))) / F.greatest(F.length("sub"), F.lit(1))
    return windows.by_position(_scan(spark, d).withColumn("score", gc)).select("id", "pos", F.round("mean_score", 6).alias("mean_score"))


@query("SELECT DISTINCT seqid, start_pos FROM features")
def distinct_positions(spark, d):  # A1, U3
    return intervals.distinct_positions(fx.features(spark, d), "seqid", "start_pos")


@query("SELECT CAST(max(length(seq)) AS BIGINT) AS longest, CAST(min(length(seq)) AS BIGINT) AS shortest, round(avg(length(seq)), 6) AS mean FROM sequences")
def length_summary(spark, d):  # A2, A13
    s = stats.summary(fx.sequences(spark, d), F.length("seq"))
    return s.select(F.col("longest").cast("long").alias("longest"), F.col("shortest").cast("long").alias("shortest"), F.round("mean", 6).alias("mean"))


@query("SELECT (SELECT count(*) FROM features WHERE type = 'CDS') AS before, (SELECT count(*) FROM cds_starts) AS starts, (SELECT count(*) FROM cds_ends) AS ends")
def excluded_counts(spark, d):  # A3
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = n(fx.features(spark, d).where("type = 'CDS'"), "before"), n(fx.cds_starts(spark, d), "starts"), n(fx.cds_ends(spark, d), "ends")
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))


@query("SELECT CAST(least(floor(value / 10), 9) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS cnt, round(count(*) / (sum(count(*)) OVER () * 10.0), 9) AS density FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def histogram(spark, d):  # A6
    h = stats.histogram(fx.table(spark, d, "events").select("value"), "value", 10, 0.0, 100.0, density=True)
    return h.select("bin", "cnt", F.round("density", 9).alias("density"))


@query("SELECT quality AS truth, toxic AS predicted, CAST(count(*) AS BIGINT) AS cnt FROM labels GROUP BY ALL")
def confusion_matrix(spark, d):  # A8
    return stats.confusion(fx.table(spark, d, "labels"), "quality", "toxic")


_RATES = "SELECT sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality <> 1 AND toxic = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN quality = 1 AND toxic <> 1 THEN 1 ELSE 0 END) AS fn FROM labels"


@query(f"SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM ({_RATES})")
def binary_f1(spark, d):  # A9, F17
    r = stats.f1(fx.table(spark, d, "labels"), "quality", "toxic")
    return r.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels")
def accuracy(spark, d):  # A10
    return stats.accuracy(fx.table(spark, d, "labels"), "quality", "toxic").select(F.round("accuracy", 6).alias("accuracy"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round((embedding[i] - avg(embedding[i]) OVER (PARTITION BY i)) / CASE WHEN stddev_pop(embedding[i]) OVER (PARTITION BY i) > 0 THEN stddev_pop(embedding[i]) OVER (PARTITION BY i) ELSE 1 END, 4) AS z FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def standard_scaler(spark, d):  # A11, M1
    e = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    return stats.Scaler(e).transform(e).select("vec_id", F.posexplode("features").alias("pos", "z")).withColumn("z", F.round("z", 4))


@query("SELECT round(avg(length(seq)), 6) AS mean, round(stddev_pop(length(seq)), 6) AS std FROM sequences")
def length_moments(spark, d):  # A11
    return stats.moments(fx.sequences(spark, d).select(F.length("seq").alias("n")), "n").select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT min(l_quantity) AS q_min, max(l_quantity) AS q_max, min(l_extendedprice) AS p_min, max(l_extendedprice) AS p_max FROM lineitem")
def column_bounds(spark, d):  # A12
    t = fx.table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    return t.agg(F.min("l_quantity").alias("q_min"), F.max("l_quantity").alias("q_max"), F.min("l_extendedprice").alias("p_min"), F.max("l_extendedprice").alias("p_max"))


_SCORES = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE)) AS scores FROM embeddings"


def _scores(spark, d):
    return fx.table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("scores"))


@query(f"SELECT vec_id, round(CASE WHEN 10 + list_sum(scores) > 0 THEN 2 * list_sum(scores[21:30]) / (10 + list_sum(scores)) ELSE 0 END, 6) AS dice FROM ({_SCORES})")
def dice_score(spark, d):  # A14, M5
    return _scores(spark, d).select("vec_id", F.round(stats.dice(F.col("scores"), F.lit(10)), 6).alias("dice"))


@query("SELECT CAST(event_id // 128 AS BIGINT) AS batch, round(sum(value), 4) AS loss FROM events GROUP BY 1")
def batch_sums(spark, d):  # A15
    return fx.table(spark, d, "events").groupBy(F.expr("event_id div 128").alias("batch")).agg(F.round(F.sum("value"), 4).alias("loss"))


@query("SELECT o_orderstatus AS state, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def state_counts(spark, d):  # A16
    return fx.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, e - s AS size FROM candidates")
def interval_lengths(spark, d):  # W1
    return fx.candidates(spark, d).select("id", (F.col("e") - F.col("s")).alias("size"))


@query("SELECT seqid, exon_start FROM exon_starts ORDER BY seqid, exon_start")
def sorted_positions(spark, d):  # O1
    return fx.exon_starts(spark, d).orderBy("seqid", "exon_start")


@query("SELECT seqid, start_pos, end_pos FROM (SELECT DISTINCT seqid, start_pos, end_pos FROM features WHERE type = 'CDS') ORDER BY seqid, start_pos, end_pos LIMIT 1000")
def first_rows(spark, d):  # O2, O3, S9: the limit is the operator
    return fx.features(spark, d).where("type = 'CDS'").select("seqid", "start_pos", "end_pos").distinct().orderBy("seqid", "start_pos", "end_pos").limit(1000)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def best_of(spark, d):  # O5
    return stats.best(fx.table(spark, d, "orders"), "o_totalprice", "o_orderkey")


@query("SELECT id, segment, '1' AS label FROM (SELECT id, substring(seq, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS segment FROM candidates JOIN contigs USING (seqid)) UNION ALL SELECT doc_id, seq, '0' FROM sequences")
def union_segments(spark, d):  # U2, P10
    a = fx.candidates(spark, d).join(fx.contigs(spark, d), "seqid").select("id", segments.cut(F.col("seq"), F.col("s"), F.col("e")).alias("segment"), F.lit("1").alias("label"))
    b = fx.sequences(spark, d).select(F.col("doc_id").alias("id"), F.col("seq").alias("segment"), F.lit("0").alias("label"))
    return a.unionByName(b)


@query("SELECT a.id, greatest(a.s, b.s) <= least(a.e, b.e) AS meets FROM candidates a JOIN candidates b ON b.id = a.id + 1")
def interval_intersection(spark, d):  # U4
    a = fx.candidates(spark, d).select("id", "s", "e")
    b = a.select((F.col("id") - 1).alias("id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return a.join(b, "id").select("id", intervals.overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")).alias("meets"))


_CONTEXT = "SELECT id, seq, s, e, (id * 7) % (41 - (e - s)) AS off FROM candidates JOIN contigs USING (seqid)"


def _context(spark, d):
    t = fx.candidates(spark, d).join(fx.contigs(spark, d), "seqid")
    offset = (F.col("id") * 7) % (F.lit(41) - (F.col("e") - F.col("s")))
    return segments.with_context(t, 40, offset, start="s", stop="e")


@query(f"SELECT id, {_SLICE.format(s='(s - off - 1)', e='(s - off + 39)')} AS segment FROM ({_CONTEXT})")
def segment_context(spark, d):  # F10
    return _context(spark, d).select("id", "segment")


@query(f"SELECT id, CAST(i AS INTEGER) AS i, CASE WHEN i >= off - 1 AND i < off + e - s THEN 1 ELSE 0 END AS bit FROM (SELECT *, unnest(range(0, 40)) AS i FROM ({_CONTEXT}))")
def segment_mask(spark, d):  # F11
    return _context(spark, d).select("id", F.posexplode("mask").alias("i", "bit"))


@query("SELECT doc_id, CASE WHEN n >= 8 THEN substring(seq, 1, 2) || '[' || substring(seq, 3, 4) || ']' || substring(seq, 7) ELSE seq END AS shown FROM (SELECT doc_id, seq, length(seq) AS n FROM sequences)")
def bracketed_mask(spark, d):  # F12
    t = fx.sequences(spark, d)
    n = F.length("seq")
    ones = F.transform(F.slice(F.sequence(F.lit(0), n), 1, n), lambda i: ((n >= 8) & (i >= 2) & (i < 6)).cast("int"))
    return t.select("doc_id", segments.bracketed(F.col("seq"), ones).alias("shown"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS i, 0 AS bit FROM (SELECT doc_id, unnest(range(0, 12)) AS i FROM documents)")
def zero_masks(spark, d):  # F13
    return fx.table(spark, d, "documents").select("doc_id", F.posexplode(segments.zero_mask(12)).alias("i", "bit"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, CAST(c = 'A' AS FLOAT) AS a, CAST(c = 'C' AS FLOAT) AS c, CAST(c = 'G' AS FLOAT) AS g, CAST(c = 'T' AS FLOAT) AS t FROM (SELECT doc_id, i, substring(seq, i, 1) AS c FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM sequences))")
def one_hot(spark, d):  # F14
    t = fx.sequences(spark, d).select("doc_id", F.posexplode(segments.one_hot(F.col("seq"))).alias("i", "v"))
    return t.select("doc_id", "i", *[F.col("v")[k].alias(c) for k, c in enumerate("acgt")])


@query("SELECT doc_id, lpad(translate(seq, 'ACGT', '1234'), CAST((SELECT max(length(seq)) FROM sequences) AS INTEGER), '0') AS codes FROM sequences")
def padded_codes(spark, d):  # padded to the longest sequence; the codes as digits
    t = fx.sequences(spark, d)
    width = t.agg(F.max(F.length("seq"))).first()[0] or 0
    return t.select("doc_id", F.array_join(segments.padded_codes(F.col("seq"), width).cast("array<string>"), "").alias("codes"))


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS i, round(scores[CAST(i // 4 AS BIGINT) + 1] * (1 - (i % 4) / 4.0) + scores[CAST(least(i // 4 + 1, len(scores) - 1) AS BIGINT) + 1] * (i % 4) / 4.0, 6) AS v FROM (SELECT vec_id, scores, unnest(range(0, 4 * (len(scores) - 1) + 1)) AS i FROM ({_SCORES}))")
def resampled_scores(spark, d):  # F16
    return _scores(spark, d).select("vec_id", F.posexplode(segments.resampled(F.col("scores"), 4)).alias("i", "v")).withColumn("v", F.round("v", 6))


@query("SELECT o_orderkey, printf('%.3f', o_totalprice / 1000000) AS shown FROM orders")
def formatted_numbers(spark, d):  # F17
    return fx.table(spark, d, "orders").select("o_orderkey", relational.fixed(F.col("o_totalprice") / 1000000).alias("shown"))


@query('SELECT s_suppkey AS "id", s_name AS "label" FROM supplier')
def renamed_columns(spark, d):  # F18
    return fx.table(spark, d, "supplier").select("s_suppkey", "s_name").toDF("id", "label")


@query(f"SELECT vec_id, CAST(coalesce(list_position(list_transform(scores, lambda x: x > 0.2), true), 0) AS BIGINT) AS first_at FROM ({_SCORES})")
def first_index(spark, d):  # F19
    return _scores(spark, d).select("vec_id", F.array_position(F.transform("scores", lambda x: x > 0.2), F.lit(True)).cast("long").alias("first_at"))


@query("SELECT doc_id FROM labels WHERE quality = 0")
def rows_of_class(spark, d):  # F20
    return fx.table(spark, d, "labels").where("quality = 0").select("doc_id")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(CASE WHEN hi > lo THEN (c[i] - lo) / (hi - lo) ELSE 0 END, 6) AS v FROM (SELECT vec_id, c, list_min(c) AS lo, list_max(c) AS hi, unnest(range(1, len(c) + 1)) AS i FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: greatest(x, 0.0)) AS c FROM embeddings))")
def min_max_scores(spark, d):  # F21
    t = fx.table(spark, d, "embeddings").select("vec_id", F.posexplode(segments.min_max(F.col("embedding").cast("array<double>"))).alias("i", "v"))
    return t.withColumn("v", F.round("v", 6))


_HASH = "(({id} % 2147483647) * 742938285 + {add}) % 2147483647"


@query(f"SELECT i AS id, 10000 + ({_HASH.format(id='i', add=17 * 69621 + 11)}) % 199990000 AS s, 10000 + ({_HASH.format(id='i', add=17 * 69621 + 11)}) % 199990000 + 16 + ({_HASH.format(id='i', add=18 * 69621 + 11)}) % 1585 AS e FROM range(0, 2000) r(i)")
def random_intervals(spark, d):  # R1 by arithmetic
    return sampling.arithmetic_intervals(spark, 2000)


@query()
def random_intervals_exponential(spark, d):  # R1 by rand
    return sampling.random_intervals(spark, 2000)


@query(f"SELECT doc_id, CAST(a AS BIGINT) AS start, substring(seq, CAST(a + 1 AS BIGINT), 50) AS segment FROM (SELECT doc_id, seq, ({_HASH.format(id='doc_id', add=5 * 69621 + 11)}) % (length(seq) - 49) AS a FROM sequences WHERE length(seq) >= 50)")
def random_segments(spark, d):  # R2
    return sampling.segments(fx.sequences(spark, d), 50, sampling.arithmetic(F.col("doc_id"), 5)).select("doc_id", "start", "segment")


@query(f"SELECT i AS draw, doc_id FROM range(0, 500) r(i) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents) ON row_id = ({_HASH.format(id='i', add=3 * 69621 + 11)}) % (SELECT count(*) FROM documents)")
def choice_with_replacement(spark, d):  # R3
    rows = cut(relational.numbered(fx.table(spark, d, "documents").select("doc_id"), ["doc_id"]))
    return sampling.with_replacement(rows, 500, 3).select("draw", "doc_id")


_SPLIT = "SELECT {key}, CASE WHEN row_number() OVER ({part} ORDER BY h, {id}) <= round(count(*) OVER ({part}) * {share}) THEN 'train' ELSE 'test' END AS fold FROM (SELECT *, {hash} AS h FROM {table})"


@query(_SPLIT.format(key="doc_id, quality", part="PARTITION BY quality", id="doc_id", share=0.7, hash=_HASH.format(id="doc_id", add=42 * 69621 + 11), table="labels"))
def stratified_split(spark, d):  # R4
    return sampling.split(fx.table(spark, d, "labels").select("doc_id", "quality"), 0.7, ["quality"], 42, "doc_id")


@query(_SPLIT.format(key="event_id", part="PARTITION BY 1", id="event_id", share=0.8, hash=_HASH.format(id="event_id", add=42 * 69621 + 11), table="events"))
def plain_split(spark, d):  # R5
    return sampling.split(fx.table(spark, d, "events").select("event_id"), 0.8, [], 42, "event_id")


@query(f"SELECT event_id, CAST((row_number() OVER (ORDER BY h, event_id) - 1) // 128 AS BIGINT) AS batch FROM (SELECT event_id, {_HASH.format(id='event_id', add=9 * 69621 + 11)} AS h FROM events)")
def mini_batches(spark, d):  # R6
    return sampling.batches(fx.table(spark, d, "events").select("event_id"), 128, 9, "event_id")


@query()
def gaussian_jitter(spark, d):  # R7
    return sampling.jittered(fx.table(spark, d, "events").select("event_id"), 1)


def _vectors(spark, d):
    return fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("int").alias("target"), F.col("embedding").cast("array<double>").alias("features"))


@query()
def principal_components(spark, d):  # M2
    e = _vectors(spark, d)
    return stats.Pca(scaled := stats.Scaler(e).transform(e)).transform(scaled).select("id", "features")


@query()
def linear_discriminant(spark, d):  # M3
    e = _vectors(spark, d)
    return stats.Lda(scaled := stats.Scaler(e).transform(e)).transform(scaled).select("id", "target", F.col("features")[0].alias("discriminant"))


def _model(spark, d, kernel):
    from strandlake.plans.models import SvmModel
    from strandlake.sources.config import Svm

    e = _vectors(spark, d)
    ready = cut(stats.Lda(scaled := stats.Scaler(e).transform(e)).transform(scaled))
    return SvmModel(Svm(kernel=kernel)).fit(ready).transform(ready).select("id", "target", "prediction")


@query()
def svm_linear(spark, d):  # M4, M8
    return _model(spark, d, "linear")


@query()
def svm_gaussian(spark, d):  # M4, M8
    return _model(spark, d, "rbf")


@query()
def randomized_search(spark, d):  # M6
    from strandlake.plans.models import search

    e = _vectors(spark, d)
    ready = cut(stats.Lda(scaled := stats.Scaler(e).transform(e)).transform(scaled))
    _, tried = search(ready)
    return spark.createDataFrame([(k, t["C"], t["tol"], t["kernel"], t["f1"]) for k, t in enumerate(tried)], "trial int, C double, tol double, kernel string, f1 double")


@query()
def alternative_classifiers(spark, d):  # M9
    from pyspark.ml.functions import array_to_vector

    from strandlake.plans.models import other_classifier

    e = cut(_vectors(spark, d).withColumn("_x", array_to_vector("features")))
    parts = [other_classifier(n).fit(e).transform(e).select(F.lit(n).alias("kind"), "id", "target", F.col("prediction").cast("int").alias("prediction")) for n in ("gaussian_nb", "logistic", "forest", "boosting")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT l_returnflag AS setting, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std FROM lineitem GROUP BY 1")
def metric_summary(spark, d):  # M10
    m = stats.metric_summary(fx.table(spark, d, "lineitem"), "l_returnflag", "l_discount")
    return m.select(F.col("l_returnflag").alias("setting"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _path(spark: SparkSession, name: str) -> str:
    """A new folder that executors share, for the round trips of files."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="strandlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(doc_id AS VARCHAR) AS seqid, seq FROM sequences")
def fasta_round_trip(spark, d):  # S1
    from strandlake.sources import files

    path = _path(spark, "fasta")
    files.write_fasta(fx.sequences(spark, d).select(F.col("doc_id").cast("string").alias("seqid"), "seq"), path)
    return files.read_fasta(spark, path)


@query("SELECT CAST(seqid AS VARCHAR) AS seqid, type, strand, start_pos, end_pos FROM features")
def annotation_round_trip(spark, d):  # S2, P3
    from strandlake.sources import files

    f = fx.features(spark, d)
    blank = [F.lit(None).cast("string").alias(c) for c in ("score", "phase", "attributes")]
    path = _path(spark, "annotations")
    files.write_annotations(f.select(F.col("seqid").cast("string").alias("seqid"), "source", "type", F.col("start_pos").cast("string").alias("start"), F.col("end_pos").cast("string").alias("end"), "strand", *blank), path)
    back = relational.as_numbers(files.read_annotations(spark, path), "start", "end")
    return back.select("seqid", "type", "strand", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query("SELECT s AS start, e AS \"end\" FROM candidates")
def table_round_trip(spark, d):  # S3, S4
    from strandlake import schemas
    from strandlake.sources import files

    path = _path(spark, "table")
    files.write_table(fx.candidates(spark, d).select(F.col("s").alias("start"), F.col("e").alias("end")), path)
    return files.read_table(spark, path, schemas.INTERVAL)


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def array_round_trip(spark, d):  # S5
    from strandlake.sources import files

    path = _path(spark, "arrays")
    files.write_arrays(fx.table(spark, d, "embeddings").select("vec_id", "embedding"), path)
    return files.read_arrays(spark, path).select("vec_id", F.posexplode("embedding").alias("i", "v"))


@query(
    """SELECT preset, CAST(c AS DOUBLE) AS c, gamma, kernel, CAST(weight AS DOUBLE) AS weight, shape, windows, most_5, most_3 FROM (VALUES ('end', 165.644051, 'auto', 'rbf', 2.0, 'ovo', '250,500,1000,2000', 1600, 16000), ('pipeline_end', 196.932498, 'auto', 'linear', 1.0, 'ovo', '250,500', 1600, 16000),
    ('pipeline_start', 85.730960, 'scale', 'rbf', 2.0, 'ovo', '10,25', 1500, 15000), ('preprocessing', 9.5, 'scale', 'linear', 3.0, 'ovr', '10,25,50', 1600, 16000), ('start', 196.723668, 'auto', 'rbf', 1.0, 'ovr', '100', 1600, 16000))
    AS t(preset, c, gamma, kernel, weight, shape, windows, most_5, most_3)"""
)
def configurations(spark, d):  # S6, S7, M7: presets through their files, one with the parameters of a search written back
    import os
    import tempfile

    from strandlake.sources import config

    rows = []
    with tempfile.TemporaryDirectory() as folder:  # read again by the driver alone
        for name, preset in config.PRESETS.items():
            path = os.path.join(folder, f"{name}.yaml")
            config.save(preset, path)
            if name == "preprocessing":
                config.update_params(path, {"C": 9.5, "gamma": "scale", "kernel": "linear", "tol": 0.01, "class_weight": {0: 1.0, 1: 3.0}, "decision_function_shape": "ovr"})
            c = config.load(path)
            rows.append((name, round(c.svm.C, 6), c.svm.gamma, c.svm.kernel, float(c.svm.class_weight[1]), c.svm.decision_function_shape, ",".join(map(str, c.windows)), c.preprocess.most_5, c.preprocess.most_3))
    return spark.createDataFrame(rows, "preset string, c double, gamma string, kernel string, weight double, shape string, windows string, most_5 int, most_3 int")


@query()
def network_scores(spark, d):  # D1: the forward pass with given weights
    import numpy as np

    from strandlake.plans import network

    rng = np.random.default_rng(7)
    convolutions = [(rng.normal(size=(w, 4, 64)), rng.normal(size=64), p) for w, p in ((5, 2), (9, 4))]
    dense = [(rng.normal(size=(128, 32)) / 8, rng.normal(size=32)), (rng.normal(size=(32, 1)), rng.normal(size=1))]
    found = fx.candidates(spark, d).join(fx.contigs(spark, d), "seqid").select("id", segments.cut(F.col("seq"), F.col("s"), F.col("e")).alias("segment")).where("length(segment) > 0")
    return network.scored(found, convolutions, dense).select("id", F.round("probability", 6).alias("probability"))


@query()
def boundary_scan(spark, d):  # 3.1 - 3.3 end to end
    from strandlake.plans import pipeline
    from strandlake.sources.config import Config

    config = Config(step=5, windows=[10, 25])
    contigs = cut(fx.contigs(spark, d))
    found = cut(fx.features(spark, d, contigs))
    five = cut(fx.utr3(spark, d, contigs, found))
    negative = pipeline.background(fx.candidates(spark, d), five, fx.utr5(spark, d, contigs, found))
    table = cut(pipeline.feature_table(five, negative, contigs, config))
    model = pipeline.Boundary(config).fit(table)
    found = sampling.with_replacement(cut(relational.numbered(five, ["seqid", "s", "e"])), 3, 1).select(F.col("draw").alias("id"), "seqid", "s", "e")
    return model.scan(found, contigs)


@query("SELECT doc_id, CAST(length(seq) AS BIGINT) AS n, round(max(CASE WHEN p > 0 THEN -p * ln(p) / ln(4) ELSE 0.0 END), 6) AS largest FROM (" + _KMERS + ") JOIN sequences USING (doc_id) GROUP BY doc_id, seq")
def streamed_features(spark, d):  # 2.12: a file stream through F5
    from strandlake.streaming import features as streams

    folder, out = _path(spark, "stream-in"), _path(spark, "stream-out")
    fx.sequences(spark, d).write.parquet(folder)
    stream = streams.feature_stream(streams.read_stream(spark, folder, "doc_id long, seq string"), ["doc_id", "seq"])
    ready = stream.select("doc_id", F.length("seq").cast("long").alias("n"), F.round(F.array_max("features"), 6).alias("largest"))
    ready.writeStream.format("parquet").option("checkpointLocation", _path(spark, "stream-state")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("doc_id long, n long, largest double").parquet(out)
