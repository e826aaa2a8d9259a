"""Row numbers, batches and first-per-key without one task per key.

A plain ``row_number() over (partition by key)`` sends a whole key to one task.
Here rows are numbered inside (key, bucket) slices, where the bucket keeps the
order, and slice offsets come from pre-aggregated counts. A unique integer
ordinal cut at ``width`` bounds every slice to ``width`` rows, whatever the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triskel.functions.hashing import hash32
from triskel.session import materialise

SLICE_ROWS = 1 << 20
# Width of a slice of 32-bit hashes: 65,536 even slices.
HASH_SLICE = 1 << 16


def ordinal_bucket(ordinal: str, width: int = SLICE_ROWS) -> Column:
    return F.floor(F.col(ordinal) / F.lit(width)).cast("bigint")


def slice_offsets(df: DataFrame, keys: Sequence[str], bucket: str = "_bucket") -> DataFrame:
    """(keys, bucket) -> rows before the slice, and rows of the key."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return counts.select(
        *keys,
        bucket,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_key_rows"),
    )


def ordered_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    bucket: Column | None = None,
    key_rows: str | None = None,
) -> DataFrame:
    """0-based position of each row within its key.

    ``bucket`` must not decrease along ``order``; by default it is the leading
    integer ordinal cut into slices. ``keys`` may be empty for a global index;
    rows with a NULL key are dropped, since a missing key matches nothing.
    """
    keys = list(keys)
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    tagged = df.withColumn("_bucket", bucket if bucket is not None else ordinal_bucket(order[0]))
    offsets = slice_offsets(tagged, keys)
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = tagged.withColumn("_rn", F.row_number().over(within) - 1)
    joined = numbered.join(offsets, [*keys, "_bucket"])
    cols = [*df.columns, (F.col("_before") + F.col("_rn")).cast("bigint").alias(out)]
    if key_rows:
        cols.append(F.col("_key_rows").alias(key_rows))
    return joined.select(*cols)


def first_per_key(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Earliest row of each key, for a unique ordinal.

    The minimum is combined map-side; the join back is on (key, ordinal), so a
    hot key spreads over its ordinals.
    """
    firsts = df.groupBy(*keys).agg(F.min(ordinal).alias(ordinal))
    return df.join(firsts, [*keys, ordinal], "left_semi")


def batches(
    df: DataFrame, ordinal: str, size: int = 256, drop_last: bool = False, out: str = "batch"
) -> DataFrame:
    """Consecutive fixed-size batches; training drops a short last one."""
    indexed = ordered_index(df, [], [ordinal], "_pos", key_rows="_rows")
    if drop_last:
        full = F.floor(F.col("_rows") / size) * size
        indexed = indexed.where(F.col("_pos") < full)
    return indexed.withColumn(out, F.floor(F.col("_pos") / size).cast("bigint")).drop(
        "_pos", "_rows"
    )


def seeded_shuffle(df: DataFrame, row_key: str, seed: int, out: str = "position") -> DataFrame:
    """Shuffled 0-based positions.

    The leading 16 bits of the hash are the bucket, so slices are even at any scale.
    """
    hashed = df.withColumn("_h", hash32(seed, F.col(row_key)))
    bucket = F.floor(F.col("_h") / F.lit(HASH_SLICE)).cast("bigint")
    return ordered_index(hashed, [], ["_h", row_key], out, bucket=bucket).drop("_h")


def label_codes(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Distinct non-null labels in sorted order with codes 0..C-1."""
    labels = df.where(F.col(label).isNotNull()).select(label).distinct().sort(label)
    # Spark's sort cuts the labels into even ranges of their own type. The ranges come
    # from a sample, so they are written before they are counted.
    place = F.monotonically_increasing_id()
    ranged = materialise(labels.select(label, F.shiftright(place, 33).alias("_range"), place.bitwiseAND((1 << 33) - 1).alias("_at")))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(starts, "_range").select(label, (F.col("_before") + F.col("_at")).alias(out))


def encode_labels(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    return df.join(label_codes(df, label, out), label, "left")
