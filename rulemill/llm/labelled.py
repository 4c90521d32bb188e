"""Labelled rows for the classifiers: a documented, bounded sample of those that may be learned from."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a classifier is fitted on, at most: those whose hashed ids are least.
SAMPLE_ROWS = 12_000
FOLDS = 5


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def training_labels(labels: DataFrame, column: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label), one row an id (the largest of several labels), never an id of the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    ok = F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold != 0)
    one = labels.filter(ok).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def with_labels(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the sampled ids; the sample is bounded, so it can be sent to all.

    One row an id, however many rows of the documents have it: the text with the least hash.
    """
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return own.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which held-back rows are likeliest (a one-dimensional search)."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 8, 61):
        p = np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9)
        best = min(best, (float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))), float(t)))
    return best[1]
