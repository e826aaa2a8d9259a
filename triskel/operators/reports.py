"""Result tables built from long metric tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triskel.functions.vectors import ordered_modalities
from triskel.operators.neighbours import SIM_DECIMALS
from triskel.operators.retrieval import pairs
from triskel.operators.tiles import matrix, products, single_error, strip_scan, tile_count, triangle_tasks

SIMILARITY_BINS = 20
TABLE_METRICS = ("R@1", "R@5", "R@10", "MRR")


def retrieval_table(metrics: DataFrame) -> DataFrame:
    """One row per direction; eight columns {row,compound} x {R@1,R@5,R@10,MRR}, NULL
    where a scope is missing."""
    columns = [f"{s}_{m}" for s in ("row", "compound") for m in TABLE_METRICS]
    cells = metrics.where(F.col("direction").isNotNull()).withColumn(
        "_c", F.concat_ws("_", "scope", "metric")
    )
    return cells.groupBy("direction").pivot("_c", columns).agg(F.first("value"))


def metric_key(scope: Column, direction: Column, metric: Column) -> Column:
    """Flat names such as 'compound/mol->morph/R@10'; prefixes other than 'row' stay."""
    return F.concat_ws("/", F.when(scope != "row", scope), direction, metric)


def flat_metrics(metrics: DataFrame) -> DataFrame:
    """(key, value) with the flat names."""
    key = metric_key(F.col("scope"), F.col("direction"), F.col("metric"))
    return metrics.select(key.alias("key"), "value")


def metric_listing(metrics: DataFrame) -> DataFrame:
    """(section, name, value) of the printed summary, ordered by section and name.

    A few dozen rows: they go to one partition as they are, while a global sort would draw a
    sample first and so compute every metric twice.
    """
    metric, scope = F.col("metric"), F.col("scope")
    section = (
        F.when(scope == "moa", "4 clustering")
        .when(metric.startswith("align_") | metric.startswith("uniform_"), "3 diagnostics")
        .when((metric == "R@10") | (metric == "mean_R@10"), F.when(scope == "compound", "2 compound R@10").otherwise("1 row R@10"))
    )
    name = F.when(metric == "mean_R@10", "mean").otherwise(F.coalesce("direction", "metric"))
    return (
        metrics.select(section.alias("section"), name.alias("name"), "value")
        .where(F.col("section").isNotNull())
        .repartition(1)
        .sortWithinPartitions("section", "name")
    )


def _bin_counts(left: np.ndarray, right: np.ndarray, bins: int) -> np.ndarray:
    """How many products of rows of ``left`` and ``right`` fall into each of ``bins``.

    The rule is floor((round(sim) + 1) * bins / 2), kept within the bins. A truncated product in single precision
    gives the same wherever it is farther from a border than its error; the rest follow the rule itself, in double.
    """
    half, kind = bins / 2.0, np.uint8 if bins < 256 else np.int32
    pairs_of = np.zeros(1 << 16, np.int64)  # of neighbouring cells, counted two at a time
    longest = [np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=1.0)) for x in (left, right)]
    doubt_at = half * single_error(left.shape[1] + 1, longest[0] * longest[1] + 1.0)
    a = np.column_stack([half * left, np.full(len(left), half - doubt_at)]).astype(np.float32)
    b = np.column_stack([right, np.ones(len(right))]).astype(np.float32)
    total = np.zeros(bins, np.int64)
    for s, c, at in products(a, b):
        if longest[0] * longest[1] > 1.0 + 1e-9:  # else only border values leave the bins
            np.clip(at, 0.0, bins - 0.5, out=at)
        low = at.astype(kind)
        at += np.float32(2.0 * doubt_at)
        doubt = low != at.astype(kind)
        if doubt.any():
            lines = np.flatnonzero(doubt.any(axis=1))
            i, j = np.nonzero(doubt[lines])
            i = lines[i]
            sim = np.round(np.einsum("ij,ij->i", left[s][i], right[c][j]), SIM_DECIMALS)
            low[i, j] = np.clip(np.floor((sim + 1.0) * half), 0, bins - 1).astype(kind)
        flat = low.ravel()
        if kind is np.uint8:
            found = np.bincount(flat[: len(flat) // 2 * 2].view(np.uint16))
            pairs_of[: len(found)] += found
            flat = flat[len(flat) // 2 * 2 :]
        total += np.bincount(flat, minlength=bins)
    both = pairs_of.reshape(256, 256)
    return total + (both.sum(axis=0) + both.sum(axis=1))[:bins] if kind is np.uint8 else total


def similarity_histogram(
    wide: DataFrame, key: str, modalities: Sequence[str], bins: int = SIMILARITY_BINS, tiles: int | None = None
) -> DataFrame:
    """(pair, bin, n): how many of all row pairs have a similarity in each of ``bins`` even
    parts of [-1, 1]. Rows without one of the vectors take no part; a strip of tiles gives
    one row of counts per pair of modalities and bin."""
    mods = ordered_modalities(modalities)
    pair_list = pairs(mods)
    n_tiles = tile_count(wide, tiles)

    def run(tile: int, held: pa.Table, streamed) -> Iterator[pa.Table]:
        total = np.zeros((len(pair_list), bins), np.int64)
        mine = {m: matrix(held, m) for m in mods}
        for other, table in streamed:
            theirs = {m: matrix(table, m) for m in mods}
            # A later tile meets this one here only, so both directions count.
            sides = [(mine, theirs), (theirs, mine)] if other != tile else [(mine, theirs)]
            for i, (a, b) in enumerate(pair_list):
                for left, right in sides:
                    total[i] += _bin_counts(left[a], right[b], bins)
        names = np.repeat([f"{a}_{b}" for a, b in pair_list], bins)
        numbers = np.tile(np.arange(bins), len(pair_list))
        yield pa.table({"pair": names.tolist(), "bin": pa.array(numbers, pa.int64()), "n": pa.array(total.ravel())})

    held, shipped, tasks = triangle_tasks(wide.select(key, *mods), key, n_tiles)
    partial = strip_scan(held, shipped, run, "pair string, bin bigint, n bigint", tasks, mods)
    return partial.groupBy("pair", "bin").agg(F.sum("n").alias("n")).where("n > 0")


def training_curves(history: DataFrame, group_metric: str, row_metric: str) -> DataFrame:
    """(epoch, train_loss, val_loss, r10); the group metric is preferred."""

    def col(name: str) -> Column:
        return F.col(f"`{name}`") if name in history.columns else F.lit(None).cast("double")

    run = [c for c in ("config", "seed") if c in history.columns]
    return history.select(
        *run,
        "epoch",
        col("loss_total").alias("train_loss"),
        col("val_loss").alias("val_loss"),
        F.coalesce(col(group_metric), col(row_metric)).alias("r10"),
    )
