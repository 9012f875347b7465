"""k-mer statistics of sequences as column expressions."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ACGT"


def vocabulary(longest: int = 3, alphabet: str = ALPHABET) -> list[str]:
    """All words of 1 to ``longest`` letters, by length and then by letter: 84 for the defaults."""
    return ["".join(w) for n in range(1, longest + 1) for w in product(alphabet, repeat=n)]


def count_of(seq: Column, sign: str) -> Column:
    """Non-overlapping occurrences from left to right; case counts."""
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(sign), F.lit("")))) / len(sign)).cast("long")


def counts(seq: Column, signs: list[str] | None = None) -> Column:
    """An array of (kmer, cnt). Each sign is an expression of its own on ``seq``, which is thus computed once before."""
    return F.array(*[F.struct(F.lit(k).alias("kmer"), count_of(seq, k).alias("cnt")) for k in signs or vocabulary()])


def entropy_term(p: Column) -> Column:
    """-p * log4(p), 0 for 0."""
    return F.when(p > 0, -p * F.log(p) / math.log(4)).otherwise(F.lit(0.0))


def long_form(df: DataFrame, key: str, seq: str = "seq", upper: bool = False) -> DataFrame:
    """(key, kmer, cnt, frequency, entropy): frequency over all signs of all lengths together, 0 where nothing is counted."""
    s = F.upper(seq) if upper else F.col(seq)
    c = df.select(key, s.alias("_s")).select(key, counts(F.col("_s")).alias("_c"))
    total = F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x["cnt"])
    rows = c.select(key, total.alias("_n"), F.inline("_c"))
    p = F.when(F.col("cnt") > 0, F.col("cnt") / F.greatest("_n", F.lit(1))).otherwise(F.lit(0.0))
    return rows.withColumn("frequency", p).withColumn("entropy", entropy_term(F.col("frequency"))).drop("_n")


def feature_table(df: DataFrame, keep: list[str], seq: str = "seq") -> DataFrame:
    """``keep`` and ``features``: the 84 entropies of each row's sequence as one array; the sequence is counted once."""
    c = df.select(*keep, F.col(seq).alias("_s")).select(*keep, F.array(*[count_of(F.col("_s"), k) for k in vocabulary()]).alias("_c"))
    c = c.withColumn("_n", F.greatest(F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1)))
    return c.select(*keep, F.transform("_c", lambda x: entropy_term(x / F.col("_n"))).alias("features"))


def wide(df: DataFrame, keep: list[str], seq: str = "seq", digits: int | None = None) -> DataFrame:
    """One column for each sign, named by it."""
    t = feature_table(df, keep, seq)
    cell = lambda k: F.round(F.col("features")[k], digits) if digits is not None else F.col("features")[k]
    return t.select(*keep, *[cell(k).alias(s) for k, s in enumerate(vocabulary())])


def vectorised_features():
    """The same entropies as a pandas UDF, for callers that need them beside other Python code."""
    import numpy as np
    import pandas as pd

    signs = vocabulary()

    def of(s: str) -> list[float]:
        n = np.array([s.count(k) for k in signs], float)
        p = n / max(n.sum(), 1)
        return [float(x) for x in np.where(p > 0, -p * np.log(np.where(p > 0, p, 1)) / math.log(4), 0)]

    def features_of(seq):
        return seq.fillna("").map(of)

    features_of.__annotations__ = {"seq": pd.Series, "return": pd.Series}  # names of this module are not resolved in workers
    return F.pandas_udf(features_of, "array<double>")


def trigrams(df: DataFrame, seq: str = "seq", n: int = 3) -> DataFrame:
    """(token, cnt): overlapping words of n letters in lower case, over all rows; counted in the map tasks before they are shuffled."""
    s = F.lower(seq)
    starts = F.sequence(F.lit(1), F.length(s) - (n - 1))
    tokens = df.where(F.length(seq) >= n).select(s.alias("_s"), F.explode(starts).alias("_i")).select(F.expr(f"substring(_s, _i, {n})").alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
