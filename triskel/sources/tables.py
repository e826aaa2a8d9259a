"""Readers for the raw and processed tables.

Every reader turns NaN and ±inf into NULL where it types features, and the ones
whose row order carries meaning add an ``ordinal`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triskel.functions.numeric import finite
from triskel.functions.text import META_PREFIX, short_key, split_roles
from triskel.sources.csv_files import SUFFIXES, RowSource, exists, list_files, load, shared_columns

def morphology_csv(
    spark: SparkSession, folder: str, key: str = "Metadata_broad_sample", suffixes=SUFFIXES
) -> DataFrame:
    """All CSV files of a folder, reduced to the feature and metadata columns present
    in every file, with the 13-character ``compound_id`` and an ``ordinal`` in
    (file, row) order. The headers alone decide the schema."""
    files = list_files(spark, folder.rstrip("/"), suffixes, deep=False)
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    shared = shared_columns(spark, files)
    features = split_roles(shared)[0]
    meta = [c for c in shared if c.startswith(META_PREFIX)]
    if key not in meta:
        raise KeyError(f"column {key} missing from the shared columns of {folder}")
    schema = ", ".join([*[f"`{c}` double" for c in features], *[f"`{c}` string" for c in meta], "ordinal bigint"])
    rows = load(spark, RowSource, files, schema)
    return rows.select(*[finite(F.col(f)).alias(f) for f in features], *meta, "ordinal").withColumn("compound_id", short_key(key))


def transpose_long(matrix: DataFrame, index: str, samples: Sequence[str] | None = None) -> DataFrame:
    """Feature-by-sample matrix to (inst_id, feature, value)."""
    samples = list(samples or [c for c in matrix.columns if c != index])
    long = matrix.unpivot([index], samples, "inst_id", "value")
    return long.withColumnRenamed(index, "feature").withColumn("value", finite(F.col("value")))


def transpose(matrix: DataFrame, index: str, features: Sequence[str]) -> DataFrame:
    """One row per sample, one column per (known) feature."""
    return (
        transpose_long(matrix, index)
        .groupBy("inst_id")
        .pivot("feature", list(features))
        .agg(F.first("value", ignorenulls=True))
    )


def attach_sidecar(
    samples: DataFrame, sidecar: DataFrame | None, embedded: DataFrame | None = None
) -> DataFrame:
    """Left join of per-sample metadata.

    Without an ``inst_id`` column the first column is the key if any of its values
    names a sample; otherwise the sidecar is dropped and metadata embedded with the
    matrix, if any, takes its place.
    """
    if sidecar is not None and "inst_id" not in sidecar.columns:
        first = sidecar.columns[0]
        probe = sidecar.select(F.col(first).cast("string").alias("inst_id"))
        if probe.join(samples.select("inst_id"), "inst_id", "left_semi").isEmpty():
            sidecar = None
        else:
            sidecar = sidecar.withColumnRenamed(first, "inst_id")
    if sidecar is None:
        sidecar = embedded
    return samples if sidecar is None else samples.join(sidecar, "inst_id", "left")


def metadata_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated lookup with '!' comment lines; adds ``compound_id`` from
    ``broad_id`` and an ``ordinal`` in row order."""
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    df = reader.csv(path, sep="\t", header=True, comment="!")
    df = df.withColumn("ordinal", F.monotonically_increasing_id())
    return df.withColumn("compound_id", short_key("broad_id")) if "broad_id" in df.columns else df


def optional_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("ordinal", F.lit(0).cast("bigint"))
    return metadata_tsv(spark, path, schema)


def manifest(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """{'morph_features': [...], 'expr_features': [...]} in order; one small JSON row."""
    row = spark.read.json(path).first()
    return {k: list(row[k]) for k in ("morph_features", "expr_features")}


def processed_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One split of a processed folder, projected to the manifest's columns."""
    features = manifest(spark, f"{folder}/feature_columns.json")
    df = spark.read.parquet(f"{folder}/rows").where(F.col("split") == split)
    fixed = [c for c in ("compound_id", "smiles", "moa", "ordinal") if c in df.columns]
    return df.select(*fixed, *features["morph_features"], *features["expr_features"])


def run_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSONL run records; blank lines are skipped, an empty log is an error."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.json(path)
    if not df.columns or df.isEmpty():
        raise ValueError(f"no runs found in {path}")
    return df


def runs_long(runs: DataFrame, keys: Sequence[str] = ("config", "seed")) -> DataFrame:
    """(keys, metric, value) of every numeric column; missing values dropped."""
    numeric = [
        n for n, t in runs.dtypes if t in ("double", "float", "int", "bigint") and n not in keys
    ]
    typed = runs.select(*keys, *[finite(F.col(f"`{n}`").cast("double")).alias(n) for n in numeric])
    long = typed.unpivot(list(keys), [F.col(f"`{n}`") for n in numeric], "metric", "value")
    return long.where(F.col("value").isNotNull())


def union_shared(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of tables on the columns they all have, in sorted order."""
    shared = sorted(set(parts[0].columns).intersection(*[p.columns for p in parts[1:]]))
    out = parts[0].select(*shared)
    for p in parts[1:]:
        out = out.unionByName(p.select(*shared))
    return out


def union_keys(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct keys over several tables."""
    out = parts[0].select(key)
    for p in parts[1:]:
        out = out.unionByName(p.select(key))
    return out.where(F.col(key).isNotNull()).distinct()
