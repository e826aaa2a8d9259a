"""String fingerprints and forward scoring of a stored encoder."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triskel.functions.hashing import hash32
from triskel.functions.text import identifier_ok, strip_annotation
from triskel.functions.vectors import NORM_FLOOR
from triskel.operators.augment import map_vectors

FINGERPRINT_BITS = 2048
FINGERPRINT_RADIUS = 2
TASKS_PER_CORE = 4


def fingerprint(identifier: Column, n_bits: int = FINGERPRINT_BITS, radius: int = FINGERPRINT_RADIUS) -> Column:
    """Sorted set bits of hashed character n-grams, n = 1..radius+1. Not a chemical
    fingerprint: one of those plugs into ``fingerprint_table`` as ``bits``."""
    text = strip_annotation(identifier)

    def grams(n: int) -> Column:
        starts = F.when(
            F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts, lambda i: F.pmod(hash32(F.substring(text, i, F.lit(n))), F.lit(n_bits)).cast("int")
        )

    parts = [grams(n) for n in range(1, radius + 2)]
    return F.sort_array(F.array_distinct(F.concat(*parts)))


def fingerprint_table(df: DataFrame, key: str, bits: Column | None = None, **kw) -> DataFrame:
    """(key, bits), once per distinct usable identifier.

    Identifiers are small in bytes and heavy in arithmetic: the task count is fixed, or AQE would
    merge them into a task or two by their bytes.
    """
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    distinct = df.select(key).where(identifier_ok(F.col(key))).distinct().repartition(tasks, key)
    return distinct.select(key, (bits if bits is not None else fingerprint(F.col(key), **kw)).alias("bits"))


def dense_bits(bits: Column, n_bits: int) -> Column:
    """Sparse set bits as a 0/1 vector."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bits - 1)),
        lambda i: F.when(F.array_contains(bits, i), 1.0).otherwise(0.0),
    )


@dataclass
class Layer:
    """Dense layer, optionally followed by running-statistics normalisation and ReLU."""

    weight: np.ndarray
    bias: np.ndarray
    mean: np.ndarray | None = None
    var: np.ndarray | None = None
    gamma: np.ndarray | None = None
    beta: np.ndarray | None = None
    relu: bool = False
    eps: float = 1e-5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weight + self.bias
        if self.mean is not None:
            y = (y - self.mean) / np.sqrt(self.var + self.eps) * self.gamma + self.beta
        return np.maximum(y, 0.0) if self.relu else y


@dataclass
class Encoder:
    """A chain of layers and a projection; dropout is the identity in scoring."""

    layers: Sequence[Layer] = field(default_factory=list)
    projection: Sequence[Layer] = field(default_factory=list)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer(x)
        return x

    def embed(self, x: np.ndarray) -> np.ndarray:
        h = self.hidden(x)
        for layer in self.projection:
            h = layer(h)
        norm = np.sqrt((h * h).sum(axis=1, keepdims=True))
        return h / np.maximum(norm, NORM_FLOOR)


def score(df: DataFrame, vec: str, encoder: Encoder, hidden: bool = False) -> DataFrame:
    """Replaces ``vec`` by its embedding (or the encoder output before projection).
    The weights travel with the task; their size is the model's."""
    return map_vectors(df, vec, encoder.hidden if hidden else encoder.embed)
