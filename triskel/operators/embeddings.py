"""The aligned embedding table: one row per entity, one vector column per modality.

Vectors of one entity sit in one row, so the correct candidate of a query is at
hand wherever the row goes and no join by position or key is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triskel.functions.vectors import ordered_modalities, unit


def from_long(
    long: DataFrame, row_id: str, modalities: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """(row_id, modality, vec, ...) to one row per entity; rows lacking a modality drop out."""
    mods = ordered_modalities(modalities)
    picks = [F.first(F.when(F.col("modality") == m, F.col("vec")), True).alias(m) for m in mods]
    kept = [F.first(c, True).alias(c) for c in carry]
    return long.groupBy(row_id).agg(*kept, *picks).dropna(subset=mods)


def build_long(
    parts: dict[str, DataFrame], row_id: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Scored modalities, each (row_id, carry..., vec), as one long table."""
    out = None
    for m in ordered_modalities(list(parts)):
        part = parts[m].select(row_id, *carry, F.lit(m).alias("modality"), "vec")
        out = part if out is None else out.unionByName(part)
    return out


def to_long(wide: DataFrame, row_id: str, modalities: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    return wide.unpivot([row_id, *carry], list(modalities), "modality", "vec")


def normalise(wide: DataFrame, modalities: Sequence[str]) -> DataFrame:
    return wide.withColumns({m: unit(F.col(m)) for m in modalities})


def mean_vector(column: str):
    """Element-wise mean; combined map-side, so a hot group costs one buffer per task."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(column)))).alias(column)


def group_vectors(wide: DataFrame, group: str, modalities: Sequence[str]) -> DataFrame:
    """Mean vector per group and modality, renormalised."""
    means = wide.groupBy(group).agg(*[mean_vector(m) for m in modalities])
    return normalise(means, modalities)


def group_labels(df: DataFrame, group: str, label: str, ordinal: str) -> DataFrame:
    """First non-null label of each group (NULL when it has none)."""
    first = F.min_by(F.col(label), F.when(F.col(label).isNotNull(), F.col(ordinal)))
    return df.groupBy(group).agg(first.alias(label))


def group_table(
    wide: DataFrame, group: str, label: str, ordinal: str, modalities: Sequence[str]
) -> DataFrame:
    """Group mean vectors of every modality and the first non-null label, in one
    aggregation."""
    first = F.min_by(F.col(label), F.when(F.col(label).isNotNull(), F.col(ordinal)))
    means = [mean_vector(m) for m in modalities]
    return normalise(wide.groupBy(group).agg(first.alias(label), *means), modalities)


def clustering_points(groups: DataFrame, group: str, label: str, modalities: Sequence[str]) -> DataFrame:
    """Per group: the vector of the first modality as ``vec``, and its label."""
    first = ordered_modalities(modalities)[0]
    return groups.select(group, label, F.col(first).alias("vec"))


def clustering_input(
    wide: DataFrame, group: str, label: str, ordinal: str, modalities: Sequence[str]
) -> DataFrame:
    """Clustering points straight from the rows."""
    first = ordered_modalities(modalities)[:1]
    return clustering_points(group_table(wide, group, label, ordinal, first), group, label, first)
