"""The evaluation flow: every metric of an aligned embedding table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triskel.operators.clustering import (
    adjusted_mutual_information,
    adjusted_rand,
    contingency,
)
from triskel.operators.embeddings import clustering_points, group_table
from triskel.operators.filters import labelled
from triskel.operators.kmeans import kmeans_assign
from triskel.operators.neighbours import KNN_KS, knn_accuracy
from triskel.operators.retrieval import alignment, retrieval_metrics, row_statistics
from triskel.operators.tiles import tile_count
from triskel.session import materialise

METRIC_COLUMNS = ("scope", "direction", "metric", "value")


def _tag(df: DataFrame, scope: str, metric) -> DataFrame:
    return df.select(
        F.lit(scope).alias("scope"),
        F.lit(None).cast("string").alias("direction"),
        metric.alias("metric"),
        F.col("value").cast("double").alias("value"),
    )


def clustering_metrics(
    groups: DataFrame,
    key: str,
    label: str,
    ks: Sequence[int] = KNN_KS,
    kmeans: bool = True,
    tiles: int | None = None,
) -> DataFrame:
    """kNN accuracy, and AMI and ARI of k-means against the labels; empty when at most
    one class is present."""
    points = labelled(groups, label)
    acc = knn_accuracy(points, key, label, ks, tiles).withColumnRenamed("accuracy", "value")
    out = _tag(acc, "moa", F.concat(F.lit("kNN_"), F.col("k").cast("string"), F.lit("_acc")))
    if not kmeans:
        return out
    classes = points.agg(F.count_distinct(label)).first()[0]
    if classes <= 1:
        return out
    clusters = kmeans_assign(points, key, classes)
    joined = points.select(key, label).join(clusters, key)
    cells = materialise(contingency(joined, label, "cluster"))
    ami = adjusted_mutual_information(cells, label, "cluster").withColumnRenamed("ami", "value")
    ari = adjusted_rand(cells, label, "cluster").withColumnRenamed("ari", "value")
    return out.unionByName(_tag(ami, "moa", F.lit("AMI"))).unionByName(_tag(ari, "moa", F.lit("ARI")))


def evaluation_metrics(
    wide: DataFrame,
    key: str,
    group: str,
    label: str,
    ordinal: str,
    modalities: Sequence[str],
    kmeans: bool = True,
    clustering: bool = True,
) -> DataFrame:
    """(scope, direction, metric, value): retrieval per row and per group, alignment,
    uniformity and clustering.

    Retrieval ranks and uniformity of the rows share one pass over the tiles. The
    group table is written once, since retrieval and clustering both scan it; write
    ``wide`` first too (``materialise``) if it is costly to recompute.
    """
    rows = row_statistics(wide, key, modalities, uniform=True)
    out = retrieval_metrics(rows, modalities, uniform=True)
    groups = materialise(group_table(wide, group, label, ordinal, modalities))
    tiles = tile_count(groups)
    stats = row_statistics(groups, group, modalities, uniform=False, tiles=tiles)
    out = out.unionByName(retrieval_metrics(stats, modalities, scope="compound"))
    aligned = alignment(wide, modalities).withColumnRenamed("alignment", "value")
    out = out.unionByName(_tag(aligned, "row", F.concat(F.lit("align_"), F.col("pair"))))
    if clustering:
        points = clustering_points(groups, group, label, modalities)
        metrics = clustering_metrics(points, group, label, kmeans=kmeans, tiles=tiles)
        out = out.unionByName(metrics)
    return out
