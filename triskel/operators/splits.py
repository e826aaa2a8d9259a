"""Leakage-free train/val/test assignment by group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triskel.functions.hashing import hash32, unit_hash
from triskel.functions.text import strip_annotation
from triskel.operators.joins import join_unique
from triskel.operators.ordering import HASH_SLICE, ordered_index
from triskel.session import local_table

FRACTIONS = {"train": 0.70, "val": 0.15, "test": 0.15}


def group_key(identifier: Column, scaffold: Column | None = None) -> Column:
    """A supplied scaffold, else the stripped identifier."""
    stripped = strip_annotation(identifier)
    return stripped if scaffold is None else F.coalesce(scaffold, stripped)


def hashed_split(df: DataFrame, group: str, seed: int = 42, fractions=None) -> DataFrame:
    """Split by a hash of the group: no shuffle, no coordination."""
    f = fractions or FRACTIONS
    h = unit_hash(seed, F.col(group))
    return df.withColumn(
        "split",
        F.when(h < f["train"], "train").when(h < f["train"] + f["val"], "val").otherwise("test"),
    )


def compounds_of(df: DataFrame, compound: str, group: Column, ordinal: str) -> DataFrame:
    """One row per compound: rows, and the group key of its first row."""
    return (
        df.select(compound, group.alias("_group"), ordinal)
        .groupBy(compound)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min_by("_group", ordinal).alias("group_key"))
    )


def share_run(counts: dict, targets: dict, weight: int, items: int) -> dict:
    """How many of ``items`` equal groups each split receives when every group goes
    to the split with the lowest filled share.

    A split takes its t-th group at fill level (count + t*weight) / target, and the
    greedy order is those levels merged. All arrivals strictly below a level are
    therefore settled at once; only the last few are stepped through.
    """
    names = list(counts)

    def arrivals(level: float) -> dict:
        out = {}
        for s in names:
            room = level * max(targets[s], 1e-9) - counts[s]
            out[s] = math.ceil(room / weight) if room > 0 else 0
        return out

    low, high = 0.0, 1.0
    while sum(arrivals(high).values()) < items:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        if sum(arrivals(mid).values()) <= items:
            low = mid
        else:
            high = mid
    given = arrivals(low)

    def level(s: str, t: int) -> tuple[float, int]:
        """Fill level at a split's t-th group; equal levels go in split order."""
        return (counts[s] + t * weight) / max(targets[s], 1e-9), names.index(s)

    while sum(given.values()) < items:
        given[min(names, key=lambda k: level(k, given[k]))] += 1
    # Rounding of the threshold may have settled a group one step early; swap it back.
    while True:
        last = max((n for n in names if given[n]), key=lambda k: level(k, given[k] - 1))
        following = min(names, key=lambda k: level(k, given[k]))
        if level(following, given[following]) >= level(last, given[last] - 1):
            return given
        given[last] -= 1
        given[following] += 1


MOST_SIZES = 2_000_000


def greedy_split(
    df: DataFrame,
    compound: str = "compound_id",
    group: Column | None = None,
    ordinal: str = "ordinal",
    seed: int = 42,
    fractions=None,
) -> DataFrame:
    """Largest groups first, each to the split furthest below its target.

    Groups of equal size (compounds, rows) are interchangeable, so the sequential
    rule runs over the distinct sizes, not over the groups: it settles how many
    groups of a size each split takes, and a seeded order within the size says
    which. Ties between groups of equal size are thereby settled by a seeded hash.
    The driver sees one row a distinct size (compounds, rows), not a row a group: sizes
    of real groups are small numbers that repeat, and more than ``MOST_SIZES`` of them
    raise, with the hashed split as the way that needs no sizes.
    """
    f = fractions or FRACTIONS
    key = group if group is not None else group_key(F.col("smiles"))
    compounds = compounds_of(df, compound, key, ordinal)
    groups = compounds.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("compounds"), F.sum("n_rows").alias("rows")
    )
    sizes = groups.groupBy("compounds", "rows").agg(F.count(F.lit(1)).alias("m"))
    if sizes.limit(MOST_SIZES + 1).count() > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} distinct group sizes; use hashed_split")
    runs = sorted(sizes.toLocalIterator(), key=lambda r: (-r["compounds"], -r["rows"]))

    total = sum(r["rows"] * r["m"] for r in runs)
    targets = {s: f[s] * total for s in ("train", "val", "test")}
    counts = dict.fromkeys(targets, 0)
    plan = []
    for r in runs:
        given = share_run(counts, targets, r["rows"], r["m"])
        plan.append((r["compounds"], r["rows"], given["train"], given["train"] + given["val"]))
        for s in counts:
            counts[s] += given[s] * r["rows"]
    quota = local_table(
        df.sparkSession, plan, "compounds bigint, rows bigint, val_from bigint, test_from bigint"
    )
    hashed = groups.withColumn("_h", hash32(seed, F.col("group_key")))
    placed = ordered_index(
        hashed,
        ["compounds", "rows"],
        ["_h", "group_key"],
        "_i",
        bucket=F.floor(F.col("_h") / F.lit(HASH_SLICE)).cast("bigint"),
    ).join(quota, ["compounds", "rows"])
    assigned = placed.select(
        "group_key",
        F.when(F.col("_i") < F.col("val_from"), "train")
        .when(F.col("_i") < F.col("test_from"), "val")
        .otherwise("test")
        .alias("split"),
    )
    by_compound = compounds.join(assigned, "group_key").select(compound, "split")
    return join_unique(df, by_compound, compound, "inner", ordinal)


def split_sizes(df: DataFrame) -> DataFrame:
    sizes = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return sizes.select("split", "rows", (F.col("rows") * 100.0 / total).alias("percent"))
