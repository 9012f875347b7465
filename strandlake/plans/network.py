"""Inference of a small convolutional network on segments, in batches on the executors; its weights come from elsewhere as plain arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.kmers import ALPHABET


def one_hot(segments: list[str]) -> np.ndarray:
    """[n, length, 4]; the segments of a batch have one length. A letter outside the alphabet raises."""
    codes = np.array([[ALPHABET.index(c) for c in s] for s in segments], int).reshape(len(segments), -1)
    return np.eye(len(ALPHABET), dtype=np.float32)[codes]


def forward(x: np.ndarray, convolutions: list[tuple[np.ndarray, np.ndarray, int]], dense: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Parallel 1-D convolutions (weights [width, 4, channels], bias, padding by zeros at either end), ReLU, maximum over places, and dense
    layers with a sigmoid after each."""
    pooled = []
    for w, b, padding in convolutions:
        padded = np.pad(x, ((0, 0), (padding, padding), (0, 0)))
        views = np.lib.stride_tricks.sliding_window_view(padded, w.shape[0], axis=1)  # [n, places, 4, width]
        pooled.append(np.maximum(np.einsum("npcw,wck->npk", views, w) + b, 0).max(1))
    h = np.concatenate(pooled, 1)
    for w, b in dense:
        h = 1 / (1 + np.exp(-(h @ w + b)))
    return h[:, 0]


def scored(df: DataFrame, convolutions: list, dense: list, segment: str = "segment") -> DataFrame:
    """Adds ``probability`` to each row; batches are scored by the length of their segments."""
    held = df.sparkSession.sparkContext.broadcast((convolutions, dense))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.full(len(f), np.nan)
            for _, at in f.reset_index(drop=True).groupby(f[segment].str.len().to_numpy()).indices.items():
                out[at] = forward(one_hot(f[segment].iloc[at].tolist()), *held.value)
            yield f.assign(probability=out)

    return df.mapInPandas(score, df.withColumn("probability", F.lit(0.0)).schema)
