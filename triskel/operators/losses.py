"""Values of the contrastive and variance/covariance losses, batch by batch."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triskel.functions.vectors import ordered_modalities
from triskel.operators.retrieval import pairs
from triskel.operators.tiles import complete, matrix

LOG_TEMPERATURE = 2.0
BIAS = 0.0
VARIANCE_EPS = 1e-4
PENALTY_WEIGHT = 0.1


def temperature(log_t: float) -> float:
    return min(max(math.exp(log_t), 1.0), 30.0)


def _pair_loss(za, zb, same, tau: float, bias: float) -> float:
    """Mean softplus(-t (tau sim + b)) over all pairs, t = +1 for positives."""
    logits = np.where(same, 1.0, -1.0) * (tau * (za @ zb.T) + bias)
    return float(np.mean(np.maximum(-logits, 0.0) + np.log1p(np.exp(-np.abs(logits)))))


def _penalty(h) -> float | None:
    """Hinge on the deviation per dimension plus squared off-diagonal covariances.

    Σ cov² over all dimension pairs equals Σ (row dot)² / (n-1)² over the centred
    rows, so the smaller of the two Gram matrices is the one computed.
    """
    n, d = h.shape
    if n < 2:
        return None
    centred = h - h.mean(axis=0)
    var = (centred**2).sum(axis=0) / (n - 1)
    gram = centred @ centred.T if n < d else centred.T @ centred
    off_diagonal = ((gram / (n - 1)) ** 2).sum() - (var**2).sum()
    hinge = np.maximum(1.0 - np.sqrt(var + VARIANCE_EPS), 0.0).mean()
    return float(hinge + off_diagonal / d)


def batch_losses(
    df: DataFrame,
    batch: str,
    modalities: Sequence[str],
    group: str | None = None,
    encoder: Mapping[str, str] | None = None,
    log_temperature: Mapping[str, float] | float = LOG_TEMPERATURE,
    bias: Mapping[str, float] | float = BIAS,
    penalty_weight: float = PENALTY_WEIGHT,
    pair_weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row per batch: ``n``, ``loss_a_b`` per pair, scaled ``vicreg_m`` per
    modality, ``loss_total``.

    Pairs are formed inside a batch only, so a group is one batch (256 rows by
    default) and never grows with the data. With ``group``, rows of one group are
    positives of each other; without it only a row and itself. ``encoder`` names the
    columns that carry pre-normalised vectors for the penalty.
    """
    mods = ordered_modalities(modalities)
    pair_list = pairs(mods)
    enc = {m: (encoder or {}).get(m, m) for m in mods}

    def per_pair(value, key, default):
        return value.get(key, default) if isinstance(value, Mapping) else value

    settings = {
        f"{a}_{b}": (
            temperature(per_pair(log_temperature, f"{a}_{b}", LOG_TEMPERATURE)),
            per_pair(bias, f"{a}_{b}", BIAS),
        )
        for a, b in pair_list
    }

    def run(key, table):
        n = table.num_rows
        z = {m: matrix(table, m) for m in mods}
        if group is None:
            same = np.eye(n, dtype=bool)
        else:
            ids = table.column(group).to_numpy()
            same = ids[:, None] == ids[None, :]
        out = {batch: pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64())}
        for a, b in pair_list:
            tau, bias_ab = settings[f"{a}_{b}"]
            out[f"loss_{a}_{b}"] = pa.array([_pair_loss(z[a], z[b], same, tau, bias_ab)], pa.float64())
        for m in mods:
            value = _penalty(z[m] if enc[m] == m else matrix(table, enc[m]))
            scaled = None if value is None else penalty_weight * value
            out[f"vicreg_{m}"] = pa.array([scaled], pa.float64())
        return pa.table(out)

    schema = ", ".join(
        [f"{batch} bigint", "n bigint"]
        + [f"loss_{a}_{b} double" for a, b in pair_list]
        + [f"vicreg_{m} double" for m in mods]
    )
    needed = dict.fromkeys([batch, *([group] if group else []), *mods, *enc.values()])
    losses = complete(df.select(*needed), *dict.fromkeys([*mods, *enc.values()])).groupBy(batch).applyInArrow(run, schema)
    return losses.withColumn("loss_total", total_loss(mods, pair_weights or {}))


def total_loss(modalities: Sequence[str], pair_weights: Mapping[str, float]):
    total = F.lit(0.0)
    for a, b in pairs(modalities):
        total = total + F.lit(float(pair_weights.get(f"{a}_{b}", 1.0))) * F.col(f"loss_{a}_{b}")
    for m in ordered_modalities(modalities):
        total = total + F.col(f"vicreg_{m}")
    return total


def mean_over_batches(losses: DataFrame, batch: str = "batch") -> DataFrame:
    """Unweighted mean of every component: a short last batch counts as much."""
    cols = [c for c in losses.columns if c not in (batch, "n")]
    return losses.agg(F.count(F.lit(1)).alias("batches"), *[F.avg(c).alias(c) for c in cols])


def nan_batches(losses: DataFrame, column: str = "loss_total") -> DataFrame:
    """(batches, nan_batches)."""
    return losses.agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.isnan(column)).alias("nan_batches"))


def mean_without_nan(losses: DataFrame, batch: str = "batch", column: str = "loss_total") -> DataFrame:
    """``mean_over_batches``, or an error that names the number of NaN batches. The count is
    part of the same aggregate, so losses are computed once."""
    cols = [c for c in losses.columns if c not in (batch, "n")]
    means = losses.agg(
        F.count(F.lit(1)).alias("batches"), F.count_if(F.isnan(column)).alias("_nan"), *[F.avg(c).alias(c) for c in cols]
    )
    message = F.concat(F.lit("NaN loss in "), F.col("_nan").cast("string"), F.lit(" batches; check the preprocessing"))
    checked = F.when(F.col("_nan") > 0, F.raise_error(message).cast("bigint")).otherwise(F.col("batches"))
    return means.withColumn("batches", checked).drop("_nan")
