"""Interval operators against plain loops, the micro cases of the fixtures, and the golden interval tables where they are at hand."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import intervals

#: A folder of interval tables (start, end) with known counts, told apart by their numbers of rows; not part of this repository.
GOLD = os.environ.get("GOLDEN_INTERVALS", "")


def rows(df):
    return sorted(map(tuple, df.collect()))


def meets(a, b):
    return max(a[0], b[0]) <= min(a[1], b[1])


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_micro_cases(spark):
    ref = frame(spark, [(1, 10), (1, 20), (1, 30)], "k long, x long")
    probe = frame(spark, [(1, 20), (1, 5), (1, 30), (2, 20)], "k long, p long")
    assert rows(intervals.asof_backward(probe, ref, "k", "p", "x")) == [(1, 20, 20), (1, 30, 30)]
    assert rows(intervals.asof_forward(probe, ref, "k", "p", "x")) == [(1, 5, 10), (1, 20, 30)]
    limit = frame(spark, [(100, 116), (100, 117)], "s long, e long")
    assert rows(intervals.limited(limit, 16, 1600)) == [(99, 116)]
    later = frame(spark, [(1, 1, 1, 5), (2, 1, 4, 8), (3, 1, 7, 9)], "id long, seqid long, s long, e long")
    assert rows(intervals.without_later_overlap(later)) == [(3, 1, 7, 9)]
    one = frame(spark, [(1, 1, 1, 5)], "id long, seqid long, s long, e long")
    assert rows(intervals.without_overlap(one, frame(spark, [(1, 5, 9)], "seqid long, s long, e long"))) == []
    assert rows(intervals.without_overlap(one, frame(spark, [(1, 6, 9), (2, 1, 9)], "seqid long, s long, e long"))) == [(1, 1, 1, 5)]


@pytest.mark.parametrize("width", [None, 3, 1 << 14])
def test_random_overlaps(spark, width):
    rng = random.Random(5)
    new = lambda n: [(k, rng.randrange(3), s := rng.randrange(60), s + rng.randrange(6)) for k in range(n)]
    a, b = new(80), new(25)
    fa = frame(spark, a, "id long, seqid long, s long, e long")
    fb = frame(spark, [x[1:] for x in b], "seqid long, s long, e long")
    assert rows(intervals.without_overlap(fa, fb, width=width)) == sorted(x for x in a if not any(x[1] == y[1] and meets(x[2:], y[2:]) for y in b))
    assert rows(intervals.without_later_overlap(fa, width=width)) == sorted(x for x in a if not any(y[0] > x[0] and x[1] == y[1] and meets(x[2:], y[2:]) for y in a))


def test_random_asof(spark):
    rng = random.Random(6)
    ref = sorted({(rng.randrange(3), rng.randrange(50)) for _ in range(30)})
    probe = sorted({(rng.randrange(4), rng.randrange(50)) for _ in range(60)})
    fr, fp = frame(spark, ref, "k long, x long"), frame(spark, probe, "k long, p long")
    back = [(k, p, max(c)) for k, p in probe if (c := [x for j, x in ref if j == k and x <= p])]
    ahead = [(k, p, min(c)) for k, p in probe if (c := [x for j, x in ref if j == k and x > p])]
    assert rows(intervals.asof_backward(fp, fr, "k", "p", "x")) == sorted(back)
    assert rows(intervals.asof_forward(fp, fr, "k", "p", "x")) == sorted(ahead)


def test_positions_and_chunks(spark):
    rng = random.Random(7)
    regions = [(k, 1, s := rng.randrange(200), s + rng.randrange(1, 9)) for k in range(20)]
    places = [(1, p) for p in range(0, 220, 3)]
    want = sorted((i, p) for i, _, s, e in regions for _, p in places if s - 2 * (e - s) <= p <= e + 2 * (e - s))
    fr = frame(spark, regions, "id long, seqid long, s long, e long")
    assert rows(intervals.positions_near(frame(spark, places, "seqid long, pos long"), fr, width=7)) == want
    seq = "".join(rng.choice("ACGT") for _ in range(300))
    contig = frame(spark, [(1, seq)], "seqid long, seq string")
    chunks = intervals.chunked(contig, size=50, overlap_by=10)
    got = rows(intervals.looked_up_in_chunks(fr, chunks, size=50).select("id", "segment"))
    assert got == sorted((i, seq[s:e]) for i, _, s, e in regions) == rows(intervals.looked_up(fr, contig).select("id", "segment"))


def test_codons(spark):
    contig = frame(spark, [(1, "ATGTAACATG"), (2, "AT"), (3, "")], "seqid long, seq string")
    assert rows(intervals.codons(contig, ("ATG", "TAA"))) == [(1, 0, "ATG"), (1, 3, "TAA"), (1, 7, "ATG")]
    at = frame(spark, [("CATGTAA", 2, 7), ("TG", 1, 2)], "seq string, start long, stop long")
    assert rows(at.select(intervals.is_start(F.col("seq"), F.col("start")), intervals.is_stop(F.col("seq"), F.col("stop")))) == [(False, False), (True, True)]


@pytest.mark.skipif(not os.path.isdir(GOLD), reason="no golden tables")
def test_golden_tables(spark):
    tables = [spark.read.csv(os.path.join(GOLD, f), header=True, schema="start long, end long").toDF("s", "e") for f in os.listdir(GOLD) if f.endswith(".csv")]
    by = {t.count(): t for t in tables}
    first, start, last, end = (by[n] for n in (789, 1195, 1408, 1558))
    assert rows(intervals.limited(start, 50, 1500, shift=0)) == rows(first)
    assert rows(intervals.limited(end, 100, 15000, shift=0)) == rows(last)
    keyed = lambda df: df.selectExpr("row_number() OVER (ORDER BY s, e) AS id", "1L AS seqid", "s", "e")
    for a, b, ka, kb in ((first, last, 780, 1399), (start, end, 1182, 1545)):
        assert intervals.without_overlap(keyed(a), keyed(b)).count() == ka
        assert intervals.without_overlap(keyed(b), keyed(a)).count() == kb
    assert [intervals.without_later_overlap(keyed(x)).count() for x in (first, start, last, end)] == [770, 1171, 1249, 1387]


@pytest.mark.parametrize("width", [1, 7, 50, 1 << 14])
def test_one_contig_in_bins(spark, width):
    """As-of joins and ranks don't depend on the bins: matches lie in the same bin, bins away, or nowhere; keys and places may be null."""
    rng = random.Random(width)
    ref = [(1, rng.randrange(60, 400)) for _ in range(25)] + [(2, 5), (None, 3), (1, None)]
    probe = [(1, rng.randrange(500)) for _ in range(60)] + [(2, 4), (2, 900), (3, 7), (None, 4), (1, None)]
    r, p = frame(spark, ref, "k long, x long"), frame(spark, probe, "k long, p long")
    xs = lambda k: [x for j, x in ref if j == k and x is not None]
    known = [(k, at) for k, at in probe if k is not None and at is not None]
    back = [(k, at, max(x for x in xs(k) if x <= at)) for k, at in known if any(x <= at for x in xs(k))]
    ahead = [(k, at, min(x for x in xs(k) if x > at)) for k, at in known if any(x > at for x in xs(k))]
    assert rows(intervals.asof_backward(p, r, "k", "p", "x", width)) == sorted(back)
    assert rows(intervals.asof_forward(p, r, "k", "p", "x", width)) == sorted(ahead)
    pairs = [(k, x, at) for k in (1, 2) for x, at in zip(sorted(xs(k)), sorted(at for j, at in known if j == k))]
    assert rows(intervals.zipped(r, p, "k", "x", "p", width)) == sorted(pairs)


@pytest.mark.parametrize("size", [2, 3, 5, 64])
def test_codons_across_pieces(spark, size):
    rng = random.Random(size)
    seqs = [(k, "".join(rng.choice("ACGT") for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 4, 63, 64, 65, 66, 130])] + [(99, None)]
    want = [(k, i, s[i : i + 3]) for k, s in seqs if s for i in range(len(s) - 2) if s[i : i + 3] in ("ATG", "TAA", "TGA")]
    assert rows(intervals.codons(frame(spark, seqs, "seqid long, seq string"), ("ATG", "TAA", "TGA"), size=size)) == sorted(want)
