"""Epoch history: averages, early stopping and alerts.

The windows here run over one row per (run, epoch), after batch rows have been
averaged map-side; their length is the number of epochs, not of batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triskel.functions.numeric import finite

PATIENCE = 15
HIGH_VALUE = 0.5
HIGH_EPOCHS = 20
COLLAPSE_LEVEL = -0.5
EXPLOSION_FACTOR = 10.0


def epoch_averages(batches: DataFrame, run: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of batch losses and gradient norm per (run, epoch)."""
    return batches.groupBy(*run, "epoch").agg(*[F.avg(v).alias(v) for v in values])


def patience_counter(
    history: DataFrame, run: Sequence[str], metric: str, epoch: str = "epoch"
) -> DataFrame:
    """Adds ``improved`` and ``counter`` (epochs since the last improvement). Only a
    strictly greater value improves; a missing one never does."""
    order = Window.partitionBy(*run).orderBy(epoch)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = finite(F.col(metric).cast("double"))
    best = F.max(value).over(before)
    df = history.withColumn("_pos", F.row_number().over(order))
    df = df.withColumn("improved", F.coalesce(value.isNotNull() & (best.isNull() | (value > best)), F.lit(False)))
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("_pos"))).over(upto), F.lit(0))
    return df.withColumn("counter", F.col("_pos") - last).drop("_pos")


def early_stopping(
    history: DataFrame, run: Sequence[str], metric: str, patience: int = PATIENCE, epoch: str = "epoch"
) -> DataFrame:
    """(run, stop_epoch, best_epoch, best_metric). ``stop_epoch`` is NULL when the run
    reached its end; later epochs do not count towards the best."""
    tracked = patience_counter(history, run, metric, epoch)
    whole = Window.partitionBy(*run)
    stop = F.min(F.when(F.col("counter") >= patience, F.col(epoch))).over(whole)
    tracked = tracked.withColumn("stop_epoch", stop)
    seen = tracked.where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    hit = F.when(F.col("improved"), F.col(epoch))
    return seen.groupBy(*run).agg(
        F.first("stop_epoch").alias("stop_epoch"),
        F.max(hit).alias("best_epoch"),
        F.max_by(F.col(metric).cast("double"), hit).alias("best_metric"),
    )


def persistent_high(
    history: DataFrame,
    run: Sequence[str],
    value: str,
    threshold: float = HIGH_VALUE,
    epochs: int = HIGH_EPOCHS,
    stops: DataFrame | None = None,
    epoch: str = "epoch",
) -> DataFrame:
    """(run, epoch, streak) where the value has stayed above the threshold for at
    least ``epochs`` epochs. With ``stops``, the stopping epoch is not judged."""
    order = Window.partitionBy(*run).orderBy(epoch).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    high = F.coalesce(finite(F.col(value).cast("double")) > threshold, F.lit(False))
    islands = history.withColumn("_high", high).withColumn(
        "_reset", F.sum((~high).cast("int")).over(order)
    )
    within = Window.partitionBy(*run, "_reset").orderBy(epoch).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    streaks = islands.withColumn("streak", F.sum(F.col("_high").cast("bigint")).over(within))
    alerts = streaks.where(F.col("_high") & (F.col("streak") >= epochs))
    if stops is not None:
        keys = [k for k in run if k in stops.columns]
        alerts = alerts.join(stops.select(*keys, "stop_epoch"), keys, "left").where(
            F.col("stop_epoch").isNull() | (F.col(epoch) < F.col("stop_epoch"))
        )
    return alerts.select(*run, epoch, "streak")


def collapse_alerts(
    history: DataFrame, value: str = "uniformity", level: float = COLLAPSE_LEVEL
) -> DataFrame:
    """Rows whose uniformity lies above the collapse level."""
    return history.where(finite(F.col(value).cast("double")) > level)


def explosion_alerts(
    batches: DataFrame, value: str = "grad_norm", clip_norm: float = 1.0, factor: float = EXPLOSION_FACTOR
) -> DataFrame:
    """Batches whose gradient norm exceeds ``factor`` times the clipping norm. Infinity
    does; NaN, which Spark orders above all numbers, exceeds nothing."""
    norm = F.col(value).cast("double")
    return batches.where(~F.isnan(norm) & (norm > factor * clip_norm))
