"""The queries of the training-data operators on the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import table
from strandlake.llm.oracles import ORACLES  # noqa: F401

#: Folder of the public vocabularies' package; the files stay where they are.
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm import toxicity

    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm import token_counts

    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op3_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm import hpylm

    return hpylm.score(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm import near_duplicates

    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm import quality_rules

    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).drop("part")


def op7_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm import quality_pu

    return quality_pu.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm import line_dedup

    return line_dedup.line_counts(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm import decontaminate

    return decontaminate.digest(decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_hpylm": op3_hpylm,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_quality_pu": op7_quality_pu,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_decontaminate": op10_decontaminate,
}
