"""From sequences and annotations to labelled features, a trained classifier and scanned regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import kmers
from strandlake.operators import intervals, relational, sampling, stats, windows
from strandlake.operators.lineage import cut
from strandlake.plans.models import SvmModel, search
from strandlake.sources.config import Config


def regions(features: DataFrame, sequences: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(5' regions, 3' regions) as (seqid, s, e): coding starts with the exon start before them, coding ends with the exon end behind."""
    p = config.preprocess
    both = features.join(sequences, "seqid")
    exons, cds = features.where("type = 'exon'"), both.where("type = 'CDS'")
    starts = intervals.distinct_positions(cds.where(intervals.is_start(F.col("seq"), F.col("start_pos"))), "seqid", "start_pos")
    ends = intervals.distinct_positions(cds.where(intervals.is_stop(F.col("seq"), F.col("end_pos"))), "seqid", "end_pos")
    exon_starts = exons.select("seqid", F.col("start_pos").alias("exon_start")).distinct()
    exon_ends = exons.select("seqid", F.col("end_pos").alias("exon_end")).distinct()
    five = intervals.asof_backward(starts, exon_starts, "seqid", "start_pos", "exon_start").select("seqid", F.col("exon_start").alias("s"), F.col("start_pos").alias("e"))
    three = intervals.asof_forward(ends, exon_ends, "seqid", "end_pos", "exon_end").select("seqid", F.col("end_pos").alias("s"), F.col("exon_end").alias("e"))
    return intervals.limited(five, p.least_5, p.most_5), intervals.limited(three, p.least_3, p.most_3)


def background(candidates: DataFrame, five: DataFrame, three: DataFrame) -> DataFrame:
    """Candidate intervals (id, seqid, s, e) that meet no region and no later candidate that is left."""
    free = intervals.without_overlap(intervals.without_overlap(candidates, five), three)
    return intervals.without_later_overlap(free)


def feature_table(positive: DataFrame, negative: DataFrame, sequences: DataFrame, config: Config) -> DataFrame:
    """(seqid, s, e, features, target) of regions (1) and background (0)."""
    rows = relational.labelled({1: positive.select("seqid", "s", "e"), 0: negative.select("seqid", "s", "e")})
    cut_out = intervals.looked_up(rows, sequences)
    if config.preprocess.upper:
        cut_out = cut_out.withColumn("segment", F.upper("segment"))
    if config.preprocess.drop_n:
        cut_out = relational.without_letters(cut_out, "segment", "N")
    return kmers.feature_table(cut_out, ["seqid", "s", "e", "target"], "segment")


class Boundary:
    """Scaler, discriminant and support vector machine, with the parameters that the search found passed on directly."""

    def __init__(self, config: Config, n_search: int = 10, folds: int = 5):
        self.config, self.n_search, self.folds = config, n_search, folds

    def fit(self, table: DataFrame) -> Boundary:
        table = relational.numbered(table, ["seqid", "s", "e", "target"], "id")
        both = cut(sampling.split(table, 0.7, ["target"], self.config.seed))
        train, test = both.where("fold = 'train'"), both.where("fold = 'test'")
        self.scaler = stats.Scaler(train)
        self.lda = stats.Lda(self.scaler.transform(train))
        ready = cut(self._ready(train))
        self.params, self.results = search(ready, self.n_search, self.folds) if self.n_search else (self.config.svm, [])
        self.model = SvmModel(self.params).fit(ready)
        self.f1 = stats.f1(self.model.transform(self._ready(test)), "target", "prediction").first().f1
        return self

    def _ready(self, df: DataFrame) -> DataFrame:
        return self.lda.transform(self.scaler.transform(df))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._ready(df))

    def scan(self, found: DataFrame, sequences: DataFrame) -> DataFrame:
        """(id, pos, mean_score) around regions (id, seqid, s, e), all windows of all places scored in one plan."""
        grid = windows.scan(found, sequences, self.config.windows, self.config.step)
        scored = self.predict(kmers.feature_table(grid, ["id", "pos", "window"], "sub"))
        return windows.by_position(scored.withColumn("score", F.col("prediction").cast("double")))

    def dice(self, found: DataFrame, scanned: DataFrame) -> DataFrame:
        """(id, dice) of scanned regions."""
        scores = scanned.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean_score"))), lambda x: x["mean_score"]).alias("scores"))
        from strandlake.functions.segments import resampled

        size = F.col("e") - F.col("s")
        return scores.join(found.select("id", "s", "e"), "id").select("id", stats.dice(resampled(F.col("scores"), self.config.step), size).alias("dice"))
