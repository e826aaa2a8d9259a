"""Matching of sources: overlap, round-robin pairing, lookups, resolution."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triskel.functions.text import identifier_ok, strip_annotation
from triskel.operators.ordering import SLICE_ROWS, ordinal_bucket, slice_offsets


SALTS = 16


def join_unique(
    df: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    ordinal: str = "ordinal",
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Joins a table with one row per key to rows of which one key may hold a third.

    The table first meets the distinct (key, ordinal slice) pairs, which are
    pre-aggregated and few, and then the rows on both columns: a join group holds at
    most one slice of rows. AQE alone would not split the key when two joins in a row
    use it. Without an ordinal the table is repeated for ``SALTS`` salts, which a hash of
    the row spreads a hot key over. ``keys_from`` is a cheaper table
    that holds every (key, ordinal) of ``df``, such as the source it was joined from.
    """
    if ordinal not in df.columns:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
        copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return salted.join(copies, [key, "_salt"], how).drop("_salt")
    tagged = df.withColumn("_bucket", ordinal_bucket(ordinal))
    source = df if keys_from is None else keys_from
    pairs = source.select(key, ordinal_bucket(ordinal).alias("_bucket")).distinct()
    slices = pairs.join(table, key, how)
    return tagged.join(slices, [key, "_bucket"], how).drop("_bucket")


def restrict_to_shared(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of either side whose key occurs on both sides."""
    shared = left.select(key).distinct().join(right.select(key).distinct(), key)
    return join_unique(left, shared, key, "left_semi"), join_unique(right, shared, key, "left_semi")


def pair_round_robin(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ordinal: str = "ordinal",
    right_ordinal: str = "ordinal",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Left row i of a key takes right row ``i mod n_right`` of that key.

    One output row per left row with a match; right columns replace left columns
    of the same name; the left ordinal is kept.

    A hot key never meets in one task: both sides are numbered in slices, and the
    join key is (key, right index, chunk). A right row is repeated once per chunk
    of ``slice_rows`` left rows that use it, so a join group holds at most
    ``slice_rows`` left rows and one right row.
    """
    right_cols = [c for c in right.columns if c not in (key, right_ordinal)]
    left_cols = [c for c in left.columns if c not in right_cols and c != key]

    lt = left.where(F.col(key).isNotNull()).withColumn(
        "_bucket", ordinal_bucket(left_ordinal, slice_rows)
    )
    rt = right.where(F.col(key).isNotNull()).withColumn(
        "_bucket", ordinal_bucket(right_ordinal, slice_rows)
    )
    # Rows per key of each side, from the already aggregated slice counts.
    l_off = slice_offsets(lt, [key])
    r_off = slice_offsets(rt, [key])
    l_keys = l_off.groupBy(key).agg(F.first("_key_rows").alias("_n_left"))
    r_keys = r_off.groupBy(key).agg(F.first("_key_rows").alias("_n_right"))
    l_off = l_off.drop("_key_rows").join(r_keys, key)
    r_off = r_off.join(l_keys, key)

    l_num = _number(lt, key, left_ordinal).join(l_off, [key, "_bucket"])
    index = F.col("_before") + F.col("_rn")
    l_num = l_num.select(
        key,
        *left_cols,
        F.pmod(index, F.col("_n_right")).alias("_slot"),
        F.floor(index / (F.col("_n_right") * F.lit(slice_rows))).alias("_chunk"),
    )
    r_num = _number(rt, key, right_ordinal).join(r_off, [key, "_bucket"])
    repeats = F.ceil(F.col("_n_left") / (F.col("_key_rows") * F.lit(slice_rows)))
    r_num = r_num.select(
        key,
        *right_cols,
        (F.col("_before") + F.col("_rn")).alias("_slot"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), repeats - 1)).alias("_chunk"),
    )
    return l_num.join(r_num, [key, "_slot", "_chunk"]).drop("_slot", "_chunk")


def _number(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    within = Window.partitionBy(key, "_bucket").orderBy(ordinal)
    return df.withColumn("_rn", F.row_number().over(within) - 1)


def last_per_key(
    table: DataFrame, key: str, value: str, ordinal: str = "ordinal", keep_null: bool = True
) -> DataFrame:
    """key -> value of its last row. A NULL last value wins unless filtered first."""
    rows = table if keep_null else table.where(F.col(value).isNotNull())
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, ordinal).alias(value))


def lookup(
    df: DataFrame,
    table: DataFrame,
    key: str,
    value: str,
    out: str,
    keep_null: bool = True,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Dictionary lookup with last-wins duplicates. Spark sizes the lookup at run
    time and broadcasts it only below its threshold."""
    last = last_per_key(table, key, value, keep_null=keep_null)
    return join_unique(df, last.withColumnRenamed(value, out), key, keys_from=keys_from)


def resolve_identifier(
    df: DataFrame,
    meta: DataFrame | None,
    key: str = "compound_id",
    own: str = "x_smiles",
    meta_value: str = "smiles",
    fallback: DataFrame | None = None,
    name: str = "pert_iname",
    extra: Callable[[Column], Column] | None = None,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Adds ``smiles`` and ``stage`` (1 lookup, 2 own column, 3 fallback table).

    ``fallback`` is a (name, smiles) table standing in for a web lookup.
    """

    def ok(c: Column) -> Column:
        return identifier_ok(c, extra(c) if extra else None)

    choices: list[tuple[int, Column]] = []
    out = df
    if meta is not None:
        out = lookup(out, meta, key, meta_value, "_s1", keys_from=keys_from)
        choices.append((1, strip_annotation(F.col("_s1"))))
    if own in df.columns:
        choices.append((2, strip_annotation(F.col(own))))
    if fallback is not None:
        third = last_per_key(fallback, name, "smiles").withColumnRenamed("smiles", "_s3")
        out = join_unique(out, third, name, keys_from=keys_from)
        choices.append((3, F.col("_s3")))
    # The row's own value is stripped before the test, the looked-up ones after it.
    tests = {1: F.col("_s1"), 2: strip_annotation(F.col(own)), 3: F.col("_s3")}
    smiles, stage = F.lit(None).cast("string"), F.lit(None).cast("int")
    for number, value in reversed(choices):
        good = ok(tests[number])
        smiles = F.when(good, value).otherwise(smiles)
        stage = F.when(good, F.lit(number)).otherwise(stage)
    out = out.withColumn("smiles", smiles).withColumn("stage", stage)
    return out.drop("_s1", "_s3")


def resolve_label(
    df: DataFrame,
    info: DataFrame | None,
    key: str = "compound_id",
    second: str = "Metadata_moa",
    out: str = "moa",
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Preferred label from ``info``, gaps filled from the row's own column."""
    filled = F.col(second) if second in df.columns else F.lit(None).cast("string")
    if info is None:
        return df.withColumn(out, filled)
    found = lookup(df, info, key, "moa", "_moa1", keep_null=False, keys_from=keys_from)
    return found.withColumn(out, F.coalesce(F.col("_moa1"), filled)).drop("_moa1")


def stage_counts(df: DataFrame) -> DataFrame:
    """Resolved rows per stage, totals and coverage in percent."""
    return df.agg(
        F.count_if(F.col("stage") == 1).alias("stage1"),
        F.count_if(F.col("stage") == 2).alias("stage2"),
        F.count_if(F.col("stage") == 3).alias("stage3"),
        F.count("smiles").alias("resolved"),
        F.count_if(F.col("smiles").isNull()).alias("missing"),
        (F.avg(F.col("smiles").isNotNull().cast("double")) * 100.0).alias("coverage"),
    )


def match_coverage(df: DataFrame, key: str = "compound_id") -> DataFrame:
    """Rows, unique keys, identifier and label coverage of a matched table."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(key).alias("unique_keys"),
        (F.avg(F.col("smiles").isNotNull().cast("double")) * 100.0).alias("smiles_pct"),
        (F.avg(F.col("moa").isNotNull().cast("double")) * 100.0).alias("moa_pct"),
    )


def map_distinct(
    df: DataFrame, key: str, mapper: Callable[[DataFrame], DataFrame], how: str = "left_semi"
) -> DataFrame:
    """Compute once per distinct value, then join the result back.

    ``mapper`` turns the table of distinct keys into (key, results...); keys it
    drops count as failed. ``left_semi`` keeps the rows whose key succeeded,
    ``inner`` also attaches the results.
    """
    mapped = mapper(df.select(key).where(F.col(key).isNotNull()).distinct())
    if how == "left_semi":
        return join_unique(df, mapped.select(key), key, "left_semi")
    return join_unique(df, mapped, key, how)


def not_yet_done(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned runs minus those already logged."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def involved_means(directions: DataFrame, metric: str = "R@10") -> DataFrame:
    """(modality, directions, value): mean over the directions that touch a modality,
    for every modality in one pass over (source, target, metric, value)."""
    touched = directions.where(F.col("metric") == metric).select(
        F.explode(F.array("source", "target")).alias("modality"), "value"
    )
    return touched.groupBy("modality").agg(
        F.count(F.lit(1)).alias("directions"), F.avg("value").alias("value")
    )
