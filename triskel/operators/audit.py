"""Audits of raw sources: sizes, missing rates, coverage and key overlap."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triskel.functions.text import short_key

SUFFICIENT_OVERLAP = 1000


def audit_matrix(long: DataFrame, sample: str = "inst_id", feature: str = "feature") -> DataFrame:
    """Samples, genes, mean, population deviation and missing rate of a matrix in long
    form (sample, feature, value)."""
    sizes = long.agg(
        F.count_distinct(sample).alias("n_samples"), F.count_distinct(feature).alias("n_genes")
    )
    stats = long.agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.avg(F.col("value").isNull().cast("double")).alias("nan_rate"),
    )
    return sizes.withColumns({c: stats.select(c).scalar() for c in stats.columns})


def audit_lookup(df: DataFrame, identifier: str = "smiles", label: str = "moa") -> DataFrame:
    """Rows, columns, coverage of identifier and label, presence flags."""

    def coverage(c: str):
        return F.avg(F.col(c).isNotNull().cast("double")) if c in df.columns else F.lit(0.0)

    return df.agg(
        F.count(F.lit(1)).alias("n_compounds"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        coverage(identifier).alias("smiles_coverage"),
        coverage(label).alias("moa_coverage"),
        F.lit("broad_id" in df.columns).alias("has_broad_id"),
        F.lit(identifier in df.columns).alias("has_smiles"),
    )


def key_overlap(sources: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Sizes, pairwise and triple overlap of truncated keys of three sources.

    One aggregation folds each key's sources into a bit mask, combined map-side, so
    repeated keys cost nothing. An overlap is NULL unless every side has keys.
    """
    (a, b, c) = sources
    tagged = None
    for bit, name in enumerate(sources):
        part = sources[name].select(short_key(key).alias("k"), F.lit(1 << bit).alias("bit"))
        tagged = part if tagged is None else tagged.unionByName(part)
    masks = tagged.where(F.col("k").isNotNull()).groupBy("k").agg(F.bit_or("bit").alias("mask"))

    def holding(bits: int):
        return F.count_if(F.col("mask").bitwiseAND(bits) == bits)

    counts = masks.agg(
        holding(1).alias("n_a"), holding(2).alias("n_b"), holding(4).alias("n_c"),
        holding(3).alias("ab"), holding(5).alias("ac"), holding(6).alias("bc"), holding(7).alias("abc"),
    )
    has_a, has_b, has_c = (F.col(x) > 0 for x in ("n_a", "n_b", "n_c"))
    return counts.select(
        F.col("n_a").alias(f"{a}_keys"),
        F.col("n_b").alias(f"{b}_keys"),
        F.col("n_c").alias(f"{c}_keys"),
        F.when(has_a & has_b, F.col("ab")).alias(f"{a}_{b}_overlap"),
        F.when(has_a & has_c, F.col("ac")).alias(f"{a}_{c}_overlap"),
        F.when(has_b & has_c, F.col("bc")).alias(f"{b}_{c}_overlap"),
        F.when(has_a & has_b & has_c, F.col("abc")).alias("all_overlap"),
    )


def overlap_verdict(overlap: DataFrame, pair: str, minimum: int = SUFFICIENT_OVERLAP) -> DataFrame:
    """(paired, sufficient): the triple overlap, else the given pair."""
    paired = F.coalesce(F.col("all_overlap"), F.col(pair), F.lit(0))
    return overlap.select(paired.alias("paired"), (paired >= minimum).alias("sufficient"))


def report_section(section: str, stats: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(section, metric, value) of a one-row audit; an absent source says so."""
    if stats is None:
        return spark.createDataFrame(
            [(section, "status", "not available")], "section string, metric string, value string"
        )
    named = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in stats.columns
    ]
    return stats.select(F.lit(section).alias("section"), F.explode(F.array(*named)).alias("m")).select(
        "section", "m.metric", "m.value"
    )


def audit_report(spark: SparkSession, sections: Mapping[str, DataFrame | None]) -> DataFrame:
    out = None
    for name, stats in sections.items():
        part = report_section(name, stats, spark)
        out = part if out is None else out.unionByName(part)
    return out
