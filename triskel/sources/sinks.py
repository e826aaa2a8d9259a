"""Writers for processed tables, manifests, result tables and run records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, folder: str) -> None:
    """Rows partitioned by split, so a reader of one split prunes the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/rows")


def manifest_table(
    spark: SparkSession, morph: Sequence[str], expr: Sequence[str]
) -> DataFrame:
    """(modality, ordinal, feature)."""
    rows = [("morph", i, f) for i, f in enumerate(morph)]
    rows += [("expr", i, f) for i, f in enumerate(expr)]
    return spark.createDataFrame(rows, "modality string, ordinal int, feature string")


def write_manifest(table: DataFrame, folder: str) -> None:
    """Ordered feature lists per modality as one JSON record."""

    def ordered(modality: str):
        pairs = F.collect_list(
            F.when(F.col("modality") == modality, F.struct("ordinal", "feature"))
        )
        return F.transform(F.array_sort(pairs), lambda p: p["feature"])

    table.agg(
        ordered("morph").alias("morph_features"), ordered("expr").alias("expr_features")
    ).write.mode("overwrite").json(f"{folder}/feature_columns.json")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_runs(df: DataFrame, path: str) -> None:
    """Append run records as JSON lines."""
    df.write.mode("append").json(path)


def run_record(best: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One record per run: its best epoch and metric, and its metrics as a JSON object.

    ``metrics`` is (keys, metric, value), a bounded handful of rows per run.
    """
    pairs = metrics.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("_m")
    )
    return best.join(pairs, list(keys), "left").withColumn(
        "metrics", F.to_json(F.col("_m"))
    ).drop("_m")


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
