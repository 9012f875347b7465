"""Quality rules as weak supervision, in DataFrame operations alone.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). Expectation-maximisation over the counts of vote patterns (at most
3 ** rules rows, whatever the size of the corpus) estimates how often each rule votes each way on good and on bad documents; the
posterior probability of good then replaces a filter that every rule must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
ROUNDS, CLOSE = 20, 1e-4
#: Distinct repeated windows up to which a document's windows are compared with each of them; beyond, they are sorted with their places.
FEW = 24

_per_word = lambda c: F.col(c) / F.col("n_words")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Votes by the columns of ``measures``; only documents with words are voted on."""
    lines, letters = F.greatest(F.col("n_lines"), F.lit(1)), F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    mean, varied = _per_word("word_chars"), _per_word("n_distinct")
    return {
        "symbols": _vote(_per_word("n_symbols") > 0.2, _per_word("n_symbols") < 0.02),
        "repeated_lines": _vote(F.col("n_dup_lines") / lines > 0.3, (F.col("n_dup_lines") == 0) & (lines > 3)),
        "repeated_words": _vote(_per_word("n_repeat_words") > 0.3, _per_word("n_repeat_words") < 0.05),
        "word_length": _vote((mean < 3) | (mean > 10), (mean > 4) & (mean < 8)),
        "capitals": _vote(F.col("n_upper") / letters > 0.4, F.col("n_upper") / letters < 0.1),
        "calls": _vote(_per_word("n_calls") > 0.3, _per_word("n_calls") < 0.02),
        "bars": _vote(_per_word("n_bars") > 0.2, _per_word("n_bars") < 0.01),
        "stutter": _vote(_per_word("n_stutter") > 0.2, _per_word("n_stutter") < 0.05),
        "variety": _vote((varied < 0.2) & (F.col("n_words") < 5000), varied > 0.4),
        "stops": _vote(_per_word("n_stops") > 0.6, (_per_word("n_stops") > 0.02) & (_per_word("n_stops") < 0.4)),
    }


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each text (long); see the contract of op5 for n_words to n_repeat_words."""
    lower, upper = common.UPPER.lower(), common.UPPER
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t"))
    t = F.col("_t")
    base = base.withColumn("_w", common.words(t)).withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0))
    w, n = F.col("_w"), F.size("_w")
    hashed = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))
    counts = {
        "n_words": n,
        "word_chars": F.length(t) - _count(t, WHITE),
        "n_symbols": _count(t, SYMBOLS),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_lines": F.size("_l"),
        "n_upper": _count(t, upper),
        "n_lower": _count(t, lower),
        "n_calls": _count(t, "!"),
        "n_bars": _count(t, "|"),
        "n_stops": _count(t, ".,;:?"),
        "n_distinct": F.size(F.array_distinct("_w")),
        "n_stutter": F.size(F.filter(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: x == w[i + 1])),
    }
    step = base.select("doc_id", *[v.cast("long").alias(k) for k, v in counts.items()], hashed.alias("_h"))
    h = F.col("_h")
    step = step.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)).otherwise(F.array().cast("array<bigint>")))
    s = F.col("_s")
    step = step.withColumn("_d", F.array_distinct(F.filter(F.slice(s, 2, F.size(s)), lambda x, i: x == s[i])))
    # first places of windows found twice or more, in order: each covers up to three words, to the next place at most
    by_value = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains("_d", x), i)), lambda i: i.isNotNull())
    step = step.withColumn("_p", F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.size("_d") <= FEW, by_value))
    pairs = F.when(F.col("_p").isNull(), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    step = step.withColumn("_q", pairs)
    q = F.col("_q")
    twice = lambda x, k: ((k > 0) & (F.get(q, k - 1)["h"] == x["h"])) | ((k < F.size(q) - 1) & (F.get(q, k + 1)["h"] == x["h"]))
    step = step.withColumn("_p", F.coalesce("_p", F.sort_array(F.transform(F.filter(q, twice), lambda x: x["i"]))))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(F.get(p, k + 1) - x, F.lit(3))).otherwise(3)), F.lit(0).cast("long"), lambda a, x: a + x)
    return step.select("doc_id", *counts, covered.alias("n_repeat_words"))


def _posterior(model: dict) -> Column:
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for rule, (good, bad) in model["rules"].items():
        ratio = [math.log(g / b) for g, b in zip(good, bad)]
        odds = odds + F.when(F.col(rule) == -1, ratio[0]).when(F.col(rule) == 0, ratio[1]).otherwise(ratio[2])
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, names: list[str]) -> dict | None:
    """The prior of good, and for each rule its shares of bad votes, abstentions and good votes on good and on bad documents.

    Begins with documents that any rule votes bad as mostly bad. Each round is one aggregate over the table of patterns. None without rows.
    """
    patterns = common.saved(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    model, last = None, None
    for _ in range(ROUNDS):
        good = _posterior(model) if model else F.when(F.least(*names) == -1, 0.1).otherwise(0.9)
        n, g = F.col("n"), F.col("n") * F.col("_g")
        sums = [F.sum(n).alias("n"), F.sum(g).alias("g")]
        for k, r in enumerate(names):
            sums += [F.sum(F.when(F.col(r) == v, x).otherwise(0)).alias(f"{s}{k}_{v + 1}") for v in (-1, 0, 1) for s, x in (("a", n), ("g", g))]
        row = patterns.withColumn("_g", good).agg(*sums).first()
        if not row.n:
            return None
        share = lambda x, all_: (x + 0.5) / (all_ + 1.5)
        table = {r: ([share(row[f"g{k}_{v}"], row.g) for v in range(3)], [share(row[f"a{k}_{v}"] - row[f"g{k}_{v}"], row.n - row.g) for v in range(3)]) for k, r in enumerate(names)}
        model = {"prior": min(max((row.g + 0.5) / (row.n + 1), 1e-6), 1 - 1e-6), "rules": table}
        now = [model["prior"], *(x for pair in table.values() for side in pair for x in side)]
        if last and max(abs(a - b) for a, b in zip(now, last)) < CLOSE:
            break
        last = now
    return model


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the five base measures, base_failed, kept, and the posterior ``p_good`` of every document.

    A null or empty text has no words and fails. Rows that share an id are judged each for itself. Documents that fail the base rules have
    no part in the estimate. Other columns are not read.
    """
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    named = rules()
    measured = measures(docs).withColumn("base_failed", (n < 50) | (100 * repeats > 50 * n))
    voted = measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *[F.when(F.col("base_failed"), 0).otherwise(v).cast("int").alias(k) for k, v in named.items()])
    voted = common.saved(voted, "rule-votes")
    model = estimate(voted.where("not base_failed"), list(named))
    good = _posterior(model) if model else F.lit(0.5)
    return voted.withColumn("p_good", good).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
