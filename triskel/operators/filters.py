"""Row and feature filters of the curation flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triskel.functions.numeric import finite
from triskel.functions.text import CONTROL_NAMES, CONTROL_TYPES, fold
from triskel.operators.joins import join_unique

NAME_COLUMNS = ("pert_iname", "Metadata_pert_iname")
TYPE_COLUMN = "pert_type"


def control_flag(columns: Sequence[str]) -> Column:
    """True for vehicle and empty wells; absent columns and NULLs never count."""
    flag = F.lit(False)
    for c in NAME_COLUMNS:
        if c in columns:
            flag = flag | F.coalesce(fold(F.col(c)).isin(*CONTROL_NAMES), F.lit(False))
    if TYPE_COLUMN in columns:
        flag = flag | F.coalesce(fold(F.col(TYPE_COLUMN)).isin(*CONTROL_TYPES), F.lit(False))
    return flag


def remove_controls(df: DataFrame) -> DataFrame:
    return df.where(~control_flag(df.columns))


def clean_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Non-finite feature values to NULL."""
    return df.withColumns({f: finite(F.col(f).cast("double")) for f in features})


def drop_empty_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Drop rows in which every feature is missing."""
    return df.where(F.coalesce(*[F.col(f) for f in features]).isNotNull())


def drop_unresolved(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(ids, feature, value): a narrow step, nothing is shuffled."""
    return df.unpivot(list(ids), list(features), "feature", "value")


def missing_rates(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, missing_rate). Plain counts over the wide columns: for these, one
    global aggregate costs about a tenth of unpivoting every cell first."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f).alias(f) for f in features])
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.try_divide(F.col("_rows") - F.col(f), F.col("_rows")).alias("missing_rate"),
        )
        for f in features
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def kept_features(
    df: DataFrame, features: Sequence[str], threshold: float = 0.05
) -> DataFrame:
    """Features whose missing rate does not exceed the threshold."""
    return missing_rates(df, features).where(F.col("missing_rate") <= threshold)


def constant_features(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """Features with zero deviation on train (one row has none, and is kept)."""
    one = df.where(F.col(split) == "train").agg(*[F.stddev_samp(f).alias(f) for f in features])
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("sd")) for f in features]
    return one.select(F.explode(F.array(*rows)).alias("r")).where("r.sd = 0").select("r.feature")


def names(table: DataFrame, order: Sequence[str]) -> list[str]:
    """Feature names of a one-row-per-column table, in source order.

    Its size is the width of the schema, so bringing it to the driver is safe.
    """
    found = {r["feature"] for r in table.select("feature").toLocalIterator()}
    return [f for f in order if f in found]


def quality_filter(
    df: DataFrame, features: Sequence[str], threshold: float = 0.05
) -> tuple[DataFrame, list[str]]:
    """Clean, drop all-missing rows, drop features missing too often."""
    rows = drop_empty_rows(clean_features(df, features), features)
    kept = names(kept_features(rows, features, threshold), features)
    return rows.drop(*[f for f in features if f not in kept]), kept


def drop_constant(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    flat = set(names(constant_features(df, features), features))
    return df.drop(*flat), [f for f in features if f not in flat]


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows with a label; nothing at all when at most one class remains."""
    rows = df.where(F.col(label).isNotNull())
    several = rows.agg(F.min(label) != F.max(label)).scalar()
    return rows.where(several)


def featurized_only(df: DataFrame, featurized: DataFrame, key: str) -> DataFrame:
    """Rows whose identifier could be featurized."""
    return join_unique(df, featurized.select(key).distinct(), key, "left_semi")
