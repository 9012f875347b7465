"""Segments of sequences: context, masks, one-hot codes, character codes, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.kmers import ALPHABET


def cut(seq: Column, start: Column, end: Column) -> Column:
    """The half-open slice [start, end) by 0-based places, clamped to the sequence."""
    a, b = F.greatest(start, F.lit(0)).cast("int"), F.least(end, F.length(seq)).cast("int")
    return F.when(b > a, F.substring(seq, a + 1, b - a)).otherwise(F.lit(""))


def halves(length: Column, total: int = 1000) -> tuple[Column, Column]:
    """(before, after): the rest total - length in two, half of it rounded down to even before and half of it rounded up after."""
    rest = F.lit(total) - length
    odd = F.pmod(rest, F.lit(2))
    return ((rest - odd) / 2).cast("long"), ((rest + odd) / 2).cast("long")


def with_context(df: DataFrame, length: int, offset: Column, seq: str = "seq", start: str = "start", stop: str = "stop") -> DataFrame:
    """Adds ``segment`` of ``length`` letters that begins ``offset`` before ``start`` (1-based), and its ``mask``.

    The mask has ones from offset - 1 on for stop - start + 1 places, clamped to the segment; the segment is clamped to the sequence.
    """
    first = F.col(start) - offset - 1
    ones = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: ((i >= offset - 1) & (i < offset + F.col(stop) - F.col(start))).cast("int"))
    return df.withColumn("segment", cut(F.col(seq), first, first + length)).withColumn("mask", ones)


def mask(length: int, offset: Column, size: Column) -> Column:
    """``length`` places, ones on [offset - 1, offset - 1 + size), clamped."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: ((i >= offset - 1) & (i < offset - 1 + size)).cast("int"))


def zero_mask(length: Column | int) -> Column:
    return F.array_repeat(F.lit(0), length)


def bracketed(segment: Column, ones: Column) -> Column:
    """The segment with brackets around the runs of ones. Raises where lengths differ."""
    letters = F.filter(F.split(segment, ""), lambda c: c != "")

    def marked(m: Column) -> Column:
        bit = lambda i: F.coalesce(F.get(m, i), F.lit(0))
        opens = lambda i: F.when((bit(i) == 1) & (bit(i - 1) == 0), "[").otherwise("")
        closes = lambda i: F.when((bit(i) == 1) & (bit(i + 1) == 0), "]").otherwise("")
        shown = F.array_join(F.transform(letters, lambda c, i: F.concat(opens(i), c, closes(i))), "")
        return F.when(F.length(segment) == F.size(m), shown).otherwise(F.raise_error(F.lit("segment and mask differ in length")))

    return F.transform(F.array(ones), marked)[0]  # the mask is a variable of a lambda: made once, not once for each letter


def one_hot(segment: Column, alphabet: str = ALPHABET) -> Column:
    """An array of one float vector for each letter; a letter outside the alphabet raises."""
    letters = F.filter(F.split(segment, ""), lambda c: c != "")
    known = ~segment.rlike(f"[^{alphabet}]")
    return F.when(known, F.transform(letters, lambda c: F.array(*[(c == a).cast("float") for a in alphabet]))).otherwise(F.raise_error(F.lit("letter outside the alphabet")))


def padded_codes(seq: Column, width: Column | int, alphabet: str = ALPHABET) -> Column:
    """Letters as numbers from 1 in alphabet order, zeros on the left up to ``width``; longer ones keep their end."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: _code(c, alphabet))
    w = F.lit(width) if isinstance(width, int) else width
    return F.when(F.size(codes) >= w, F.slice(codes, F.greatest(F.size(codes) - w + 1, F.lit(1)), F.greatest(w, F.lit(0)))).otherwise(F.concat(F.array_repeat(F.lit(0), F.greatest(w - F.size(codes), F.lit(0))), codes))


def _code(c: Column, alphabet: str) -> Column:
    out = F.lit(0)
    for k, a in enumerate(alphabet, 1):
        out = F.when(c == a, k).otherwise(out)
    return out


def resampled(scores: Column, step: Column | int) -> Column:
    """Linear interpolation of an array with values at 0, step, 2 step, ... at every whole place from 0 to the last."""
    s = F.lit(step) if isinstance(step, int) else step
    last = F.size(scores) - 1

    def at(i: Column) -> Column:
        low = F.least((i / s).cast("int"), last)
        high = F.least(low + 1, last)
        share = (i - low * s) / s
        return F.get(scores, low) * (1 - share) + F.get(scores, high) * share

    return F.transform(F.sequence(F.lit(0), last * s), at)


def min_max(values: Column) -> Column:
    """An array clipped at 0, shifted to begin at 0 and divided by its largest value; all zeros if that is 0."""
    clipped = F.transform(values, lambda x: F.greatest(x, F.lit(0.0)))
    low, high = F.array_min(clipped), F.array_max(clipped)
    return F.transform(clipped, lambda x: F.when(high > low, (x - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.0)))
