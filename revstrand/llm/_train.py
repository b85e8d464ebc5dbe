"""Bounded training samples and small model fits shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import crc_mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, bound: int) -> DataFrame:
    """doc_id, text, y of at most `bound` labelled documents of each class, none of them held out; equal texts count once.

    The ids are the first `bound` of a hash order, so the sample is repeatable and its size is proven before it is broadcast.
    """
    known = labels.where(crc_mod("doc_id", mod) != held).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))
    found = docs.select("doc_id", "text").join(ids, "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    return found.groupBy("text", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", F.col("y").cast("int").alias("y"))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with a bias in front, by Newton steps; classes as they are."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], l2)
    keep[0] = 1e-3
    if len(x) == 0:
        return w
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
