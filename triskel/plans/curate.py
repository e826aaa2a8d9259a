"""The curation flow: match, drop controls, filter features, split, scale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triskel.functions.text import META_PREFIX, short_key, split_roles
from triskel.operators.filters import drop_unresolved, quality_filter, remove_controls
from triskel.operators.joins import pair_round_robin, resolve_identifier, resolve_label
from triskel.operators.quantiles import profile
from triskel.operators.scaling import apply_scaling, fit_from, train_rows
from triskel.operators.splits import greedy_split, group_key, hashed_split
from triskel.session import materialise
from triskel.sources.sinks import manifest_table, write_manifest, write_splits


def with_compound(df: DataFrame, source: str) -> DataFrame:
    """Adds the 13-character ``compound_id`` unless it is there."""
    if "compound_id" in df.columns:
        return df
    if source not in df.columns:
        raise KeyError(f"neither compound_id nor {source} among {df.columns[:15]}")
    return df.withColumn("compound_id", short_key(source))


def match_treatments(
    morph: DataFrame,
    expr: DataFrame,
    meta: DataFrame,
    info: DataFrame | None = None,
    fallback: DataFrame | None = None,
) -> DataFrame:
    """Pairs every expression row with a morphology row of its compound, resolves
    identifier and label, drops rows without an identifier.

    Sources carry an ``ordinal``; keys never shared drop out in the pairing.
    """
    expr = with_compound(expr, "pert_id")
    morph = with_compound(morph, "Metadata_broad_sample")
    meta = with_compound(meta, "broad_id")
    kept = split_roles(morph.columns)[0] + [c for c in morph.columns if c.startswith(META_PREFIX)]
    paired = pair_round_robin(expr, morph.select("compound_id", "ordinal", *kept), "compound_id")
    # Every paired row is an expression row, so that source lists the keys to look up.
    resolved = resolve_identifier(paired, meta, fallback=fallback, keys_from=expr)
    if info is not None:
        info = with_compound(info, "pert_id")
    labelled = resolve_label(resolved, info, keys_from=expr)
    return drop_unresolved(labelled, ["smiles"])


@dataclass
class Curated:
    rows: DataFrame
    morph_features: list[str]
    expr_features: list[str]


def curate(
    matched: DataFrame,
    threshold: float = 0.05,
    seed: int = 42,
    greedy: bool = True,
    scaffold: str | None = None,
    low: float = -5.0,
    high: float = 5.0,
    cut: bool = True,
) -> Curated:
    """From matched rows to scaled, split rows.

    The order matters: the split precedes constant-feature removal and scaling, so
    both see the training rows only, through one profile of them. ``cut`` writes the
    matched rows once, since every later step scans them again.
    """
    rows = remove_controls(matched)
    if cut:
        rows = materialise(rows)
    morph, expr = split_roles(rows.columns)
    rows, kept = quality_filter(rows, morph + expr, threshold)
    group = group_key(F.col("smiles"), F.col(scaffold) if scaffold else None)
    if greedy:
        rows = greedy_split(rows, group=group, seed=seed)
        # The split came through a shuffle; the fit below scans it several times.
        rows = materialise(rows) if cut else rows
    else:
        rows = hashed_split(rows.withColumn("_group", group), "_group", seed).drop("_group")
    profiles = profile(train_rows(rows), kept)
    flat = [f for f in kept if f in profiles and profiles[f].sd == 0.0]
    rows, kept = rows.drop(*flat), [f for f in kept if f not in flat]
    morph, expr = split_roles(kept)
    fit = fit_from(rows, profiles, morph, expr)
    return Curated(apply_scaling(rows, fit, morph + expr, low, high), morph, expr)


def save(curated: Curated, folder: str) -> None:
    """Rows by split, and the manifest of ordered feature lists."""
    write_splits(curated.rows, folder)
    spark = curated.rows.sparkSession
    write_manifest(manifest_table(spark, curated.morph_features, curated.expr_features), folder)
