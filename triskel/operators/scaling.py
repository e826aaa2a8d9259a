"""Scalers fitted on the training split and applied to every split.

Fitting runs jobs and keeps a few numbers per feature, that is per column of the
wide table, on the driver; applying is a plain projection.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import fmean

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triskel.functions.numeric import clip
from triskel.operators.quantiles import Profile, filled_quartiles, profile
from triskel.session import local_table

MEAN_TOLERANCE = 0.1
STD_TOLERANCE = 0.3


FIT_SCHEMA = "feature string, center double, scale double"


def train_rows(df: DataFrame, split: str = "split") -> DataFrame:
    return df.where(F.col(split) == "train")


def _robust_rows(train: DataFrame, profiles: Mapping[str, Profile]) -> list[tuple]:
    quartiles = filled_quartiles(train, list(profiles), profiles)
    return [(f, m, (p75 - p25) or 1.0) for f, (m, p25, p75) in quartiles.items()]


def _settled(train: DataFrame, profiles: Mapping[str, Profile]) -> dict[str, tuple[float, float]]:
    """feature -> (mean, population variance), by a second pass over what the first one left.

    A plain sum of n values is off by some sqrt(n) roundings that hang on the order of rows, enough
    at millions of rows to turn the last printed decimal of a scaled value. Deviations from the
    first mean and variance add up to nearly nothing, so their sums are right to the last bit or two.
    """
    known = {f: p for f, p in profiles.items() if p.present}
    sums = []
    for i, (f, p) in enumerate(known.items()):
        off = F.col(f).cast("double") - F.lit(p.mean)
        sums += [F.avg(off).alias(f"_m{i}"), F.avg(off * off - F.lit(p.variance)).alias(f"_v{i}")]
    rest = train.agg(*sums).first() if sums else {}
    out = {}
    for i, (f, p) in enumerate(known.items()):
        off, spread = rest[f"_m{i}"], rest[f"_v{i}"]
        out[f] = p.mean + off, max(p.variance + (spread - off * off), 0.0)
    return out


def _standard_rows(train: DataFrame, profiles: Mapping[str, Profile]) -> list[tuple]:
    means = [p.mean for p in profiles.values() if p.mean is not None]
    deviations = [p.sd for p in profiles.values() if p.sd is not None]
    off_centre = bool(means) and abs(fmean(means)) > MEAN_TOLERANCE
    off_scale = bool(deviations) and abs(fmean(deviations) - 1.0) > STD_TOLERANCE
    if not (off_centre or off_scale):
        return [(f, 0.0, 1.0, False) for f in profiles]
    # Filling with the mean leaves the mean alone and shrinks the variance.
    return [
        (f, mean, math.sqrt(variance * profiles[f].present / profiles[f].rows) or 1.0, True)
        for f, (mean, variance) in _settled(train, profiles).items()
    ]


def fit_robust(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """(feature, center, scale): median and interquartile range of the
    median-filled training values; a zero range counts as 1."""
    train = train_rows(df, split)
    return local_table(df.sparkSession, _robust_rows(train, profile(train, features)), FIT_SCHEMA)


def fit_standard(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """(feature, center, scale, rescaled): mean and population deviation of the
    mean-filled training values, or (0, 1) for all features when the modality
    already looks z-scored. Two passes over the data, one if nothing is rescaled."""
    train = train_rows(df, split)
    rows = _standard_rows(train, profile(train, features))
    return local_table(df.sparkSession, rows, FIT_SCHEMA + ", rescaled boolean")


def fit_modalities(
    df: DataFrame, morph: Sequence[str], expr: Sequence[str], split: str = "split"
) -> DataFrame:
    """Robust fit for one modality, conditional standard fit for the other."""
    profiles = profile(train_rows(df, split), [*morph, *expr])
    return fit_from(df, profiles, morph, expr, split)


def fit_from(
    df: DataFrame,
    profiles: Mapping[str, Profile],
    morph: Sequence[str],
    expr: Sequence[str],
    split: str = "split",
) -> DataFrame:
    """The same from training profiles that are already at hand."""

    def part(features):
        return {f: profiles[f] for f in features if f in profiles}

    rows = _robust_rows(train_rows(df, split), part(morph)) if morph else []
    rows += [r[:3] for r in _standard_rows(train_rows(df, split), part(expr))]
    return local_table(df.sparkSession, rows, FIT_SCHEMA)


def apply_scaling(
    df: DataFrame, fit: DataFrame, features: Sequence[str], low: float = -5.0, high: float = 5.0
) -> DataFrame:
    """Scale and clip wide columns; missing stays missing.

    The fit has one row per column of the table, so it becomes literals of a plain
    projection: no join, no shuffle.
    """
    values = {r["feature"]: (r["center"], r["scale"]) for r in fit.toLocalIterator()}
    scaled = {}
    for f in features:
        if f in values:
            center, scale = values[f]
            scaled[f] = clip((F.col(f) - F.lit(center)) / F.lit(scale), low, high)
        else:
            scaled[f] = clip(F.col(f), low, high)
    return df.withColumns(scaled)


def split_moments(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """Rows and percent per split, mean of feature means, mean of feature deviations."""
    wide = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)],
        *[F.stddev_samp(f).alias(f"_s{i}") for i, f in enumerate(features)],
    )

    def mean_of(kind: str) -> Column:
        return _mean([F.col(f"_{kind}{i}") for i in range(len(features))])

    total = df.agg(F.count(F.lit(1))).scalar()
    percent = (F.col("rows") * 100.0 / total).alias("percent")
    return wide.select(split, "rows", percent, mean_of("m").alias("mean"), mean_of("s").alias("std"))


def _mean(values: Sequence[Column]) -> Column:
    """Mean of the values of one row that are not NULL."""
    there = F.filter(F.array(*values), lambda v: v.isNotNull())
    return F.aggregate(there, F.lit(0.0), lambda a, v: a + v, lambda a: F.try_divide(a, F.size(there)))
