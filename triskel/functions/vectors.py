"""Expressions over array<double> columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed order of modalities; pair keys and direction names follow it.
MODALITY_ORDER = ("mol", "morph", "expr")
NORM_FLOOR = 1e-12


def ordered_modalities(names: Sequence[str]) -> list[str]:
    return sorted(names, key=MODALITY_ORDER.index)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def unit(v: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero.

    The norm sits in a one-element array so it is computed once per row rather
    than once per element.
    """
    norms = F.array(F.greatest(F.sqrt(total(F.transform(v, lambda x: x * x))), F.lit(NORM_FLOOR)))
    scaled = F.transform(norms, lambda n: F.transform(v, lambda x: x / n))
    return F.element_at(scaled, 1)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def assemble(columns: Sequence[str], fill: float = 0.0) -> Column:
    """Ordered vector from manifest columns, missing values filled."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(fill)) for c in columns])


def missing_count(columns: Sequence[str]) -> Column:
    """How many of the row's columns are NULL (the fills made by ``assemble``)."""
    parts = [F.col(c).isNull().cast("bigint") for c in columns]
    out = F.lit(0).cast("bigint")
    for p in parts:
        out = out + p
    return out
