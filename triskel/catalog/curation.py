"""Queries of the curation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from triskel.catalog.base import query, table
from triskel.catalog.embedding_data import hash_sql
from triskel.catalog.source_data import (
    ALL_FEATURES,
    EXPR_FEATURES,
    EXPR_SIDE,
    EXPR_SQL,
    FEATURE_SQL,
    FEATURES,
    META_SQL,
    MORPH_FEATURES,
    MORPH_SIDE,
    MORPH_SQL,
    build,
    meta,
)
from triskel.functions import numeric, text
from triskel.functions.numeric import rounded
from triskel.functions.vectors import assemble, missing_count
from triskel.operators import filters, joins, ordering, scaling, splits
from triskel.plans import curate as flow
from triskel.session import materialise


def _expr(spark, sf_dir):
    return build(spark, sf_dir, EXPR_SIDE).withColumn("compound_id", text.short_key("pert_id"))


def _morph(spark, sf_dir):
    return build(spark, sf_dir, MORPH_SIDE).withColumn(
        "compound_id", text.short_key("Metadata_broad_sample")
    )


def _meta(spark, sf_dir):
    return meta(spark, sf_dir).withColumn("compound_id", text.short_key("broad_id"))


_KEYED = f"""{EXPR_SQL}, {MORPH_SQL}, {META_SQL},
    e AS (SELECT *, substr(pert_id, 1, 13) AS compound_id FROM ex),
    m AS (SELECT *, substr(Metadata_broad_sample, 1, 13) AS compound_id FROM mo),
    mt AS (SELECT *, substr(broad_id, 1, 13) AS compound_id FROM meta)"""


@query(
    "column_roles",
    """WITH n AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'Cells_' WHEN 1 THEN 'Cytoplasm_' WHEN 2 THEN 'Nuclei_'
      WHEN 3 THEN 'Metadata_' WHEN 4 THEN 'gene_' ELSE '' END || p_name ||
      CASE WHEN p_partkey % 6 = 4 THEN '_at' ELSE '' END AS name FROM part)
    SELECT name, CASE WHEN regexp_matches(name, '^(Cells_|Cytoplasm_|Nuclei_)') THEN 'morph'
      WHEN regexp_matches(name, '_at$') THEN 'expr' END AS role, count(*) AS n FROM n GROUP BY 1, 2""",
)
def column_roles(spark, sf_dir):
    name = F.expr(
        "CASE p_partkey % 6 WHEN 0 THEN 'Cells_' WHEN 1 THEN 'Cytoplasm_' WHEN 2 THEN 'Nuclei_' "
        "WHEN 3 THEN 'Metadata_' WHEN 4 THEN 'gene_' ELSE '' END || p_name || "
        "CASE WHEN p_partkey % 6 = 4 THEN '_at' ELSE '' END"
    )
    names = table(spark, sf_dir, "part").select(name.alias("name"))
    return names.select("name", text.feature_role(F.col("name")).alias("role")).groupBy("name", "role").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "short_keys",
    f"WITH {EXPR_SQL} SELECT ordinal, substr(pert_id, 1, 13) AS compound_id FROM ex",
)
def short_keys(spark, sf_dir):
    return _expr(spark, sf_dir).select("ordinal", "compound_id")


_VALID = "({c} IS NOT NULL AND trim({c}) <> '' AND NOT regexp_full_match(split_part({c}, ' |', 1), '-*[0-9]+'))"


@query(
    "identifier_checks",
    f"""WITH {META_SQL} SELECT ordinal, split_part(smiles, ' |', 1) AS stripped, {_VALID.format(c='smiles')} AS valid FROM meta""",
)
def identifier_checks(spark, sf_dir):
    s = F.col("smiles")
    return meta(spark, sf_dir).select(
        "ordinal", text.strip_annotation(s).alias("stripped"), text.identifier_ok(s).alias("valid")
    )


@query(
    "remove_controls",
    f"""WITH {EXPR_SQL} SELECT ordinal, lower(trim(pert_iname)) AS name, lower(trim(pert_type)) AS type FROM ex
    WHERE NOT coalesce(lower(trim(pert_iname)) IN ('dmso', 'empty'), FALSE)
      AND NOT coalesce(lower(trim(pert_type)) IN ('ctl_vehicle', 'ctl_untrt'), FALSE)""",
)
def remove_controls(spark, sf_dir):
    kept = filters.remove_controls(build(spark, sf_dir, EXPR_SIDE))
    return kept.select(
        "ordinal", text.fold(F.col("pert_iname")).alias("name"), text.fold(F.col("pert_type")).alias("type")
    )


@query(
    "finite_and_clipped",
    f"""WITH {FEATURE_SQL}, f AS (SELECT order_key, row_key, CASE WHEN isfinite(Nuclei_spike) THEN Nuclei_spike END AS x FROM ft)
    SELECT order_key, row_key, round(x, 6) + 0.0 AS finite,
      round(CASE WHEN x < -5 THEN -5.0::DOUBLE WHEN x > 5 THEN 5.0::DOUBLE ELSE x END, 6) + 0.0 AS clipped,
      round(coalesce(x, 0.0::DOUBLE), 6) + 0.0 AS filled FROM f""",
)
def finite_and_clipped(spark, sf_dir):
    x = numeric.finite(F.col("Nuclei_spike"))
    return build(spark, sf_dir, FEATURES).select(
        "order_key",
        "row_key",
        rounded(x).alias("finite"),
        rounded(numeric.clip(x)).alias("clipped"),
        rounded(F.coalesce(x, F.lit(0.0))).alias("filled"),
    )


@query(
    "vector_assembly",
    f"""WITH {EXPR_SQL} SELECT ordinal, pos - 1 AS dim, v[pos] AS value,
      ((gene_0_at IS NULL)::BIGINT + (gene_2_at IS NULL)::BIGINT + (gene_3_at IS NULL)::BIGINT) AS fills
    FROM (SELECT *, [coalesce(gene_0_at, 0::DOUBLE), coalesce(gene_2_at, 0::DOUBLE), coalesce(gene_3_at, 0::DOUBLE)] AS v FROM ex), range(1, 4) t(pos)""",
)
def vector_assembly(spark, sf_dir):
    genes = ["gene_0_at", "gene_2_at", "gene_3_at"]
    rows = build(spark, sf_dir, EXPR_SIDE).select(
        "ordinal", missing_count(genes).alias("fills"), F.posexplode(assemble(genes)).alias("dim", "value")
    )
    return rows.withColumn("dim", F.col("dim").cast("bigint"))


def _clean_sql() -> str:
    cleaned = ", ".join(f"CASE WHEN isfinite({f}) THEN {f} END AS {f}" for f in ALL_FEATURES)
    return f"""{FEATURE_SQL}, c0 AS (SELECT row_key, order_key, {cleaned} FROM ft),
    cl AS (SELECT * FROM c0 WHERE coalesce({', '.join(ALL_FEATURES)}) IS NOT NULL),
    lg AS ({' UNION ALL '.join(f"SELECT row_key, '{f}' AS feature, {f} AS value FROM cl" for f in ALL_FEATURES)})"""


def _clean(spark, sf_dir):
    df = filters.clean_features(build(spark, sf_dir, FEATURES), ALL_FEATURES)
    return filters.drop_empty_rows(df, ALL_FEATURES)


@query(
    "drop_empty_rows",
    f"WITH {_clean_sql()} SELECT order_key, row_key, Cells_qty, gene_tax_at FROM cl",
)
def drop_empty_rows(spark, sf_dir):
    return _clean(spark, sf_dir).select("order_key", "row_key", "Cells_qty", "gene_tax_at")


@query(
    "feature_missing_rates",
    f"""WITH {_clean_sql()}, r AS (SELECT feature, avg((value IS NULL)::INT) AS x FROM lg GROUP BY feature)
    SELECT feature, round(x, 6) + 0.0 AS missing_rate, x <= 0.05 AS kept FROM r""",
)
def feature_missing_rates(spark, sf_dir):
    rates = filters.missing_rates(_clean(spark, sf_dir), ALL_FEATURES)
    return rates.select(
        "feature", rounded(F.col("missing_rate")).alias("missing_rate"), (F.col("missing_rate") <= 0.05).alias("kept")
    )


_SPLIT = f"({hash_sql('42', 'row_key')} / 4294967296.0::DOUBLE)"
_SPLIT_CASE = f"CASE WHEN {_SPLIT} < 0.7 THEN 'train' WHEN {_SPLIT} < 0.7 + 0.15 THEN 'val' ELSE 'test' END"
_SPLIT_SQL = f"""{_clean_sql()},
    sp AS (SELECT *, {_SPLIT_CASE} AS split FROM cl),
    ls AS ({' UNION ALL '.join(f"SELECT split, '{f}' AS feature, {f} AS value FROM sp" for f in ALL_FEATURES)})"""


def _split(spark, sf_dir):
    return splits.hashed_split(_clean(spark, sf_dir), "row_key")


def _split_cut(spark, sf_dir):
    """The split rows written once: a fit scans them several times."""
    rows = build(spark, sf_dir, FEATURES)
    clean = filters.drop_empty_rows(filters.clean_features(rows, ALL_FEATURES), ALL_FEATURES)
    return materialise(splits.hashed_split(clean, "row_key"))


@query(
    "constant_features",
    f"""WITH {_SPLIT_SQL} SELECT feature FROM ls WHERE split = 'train' GROUP BY feature HAVING stddev_samp(value) = 0""",
)
def constant_features(spark, sf_dir):
    return filters.constant_features(_split(spark, sf_dir), ALL_FEATURES)


@query(
    "surviving_features",
    f"""WITH {_SPLIT_SQL} SELECT feature, CASE WHEN feature LIKE '%!_at' ESCAPE '!' THEN 'expr' ELSE 'morph' END AS modality
    FROM ls GROUP BY feature HAVING avg((value IS NULL)::INT) <= 0.05 AND stddev_samp(value) FILTER (split = 'train') <> 0""",
)
def surviving_features(spark, sf_dir):
    rows, kept = filters.quality_filter(build(spark, sf_dir, FEATURES), ALL_FEATURES)
    rows, kept = filters.drop_constant(splits.hashed_split(rows, "row_key"), kept)
    long = filters.to_long(rows, [], kept).select("feature").distinct()
    return long.select("feature", text.feature_role(F.col("feature")).alias("modality"))


_ROBUST_SQL = f"""{_SPLIT_SQL},
    tr AS (SELECT feature, value FROM ls WHERE split = 'train' AND feature NOT LIKE '%!_at' ESCAPE '!'),
    med AS (SELECT feature, median(value) AS med FROM tr GROUP BY feature),
    q AS (SELECT feature, quantile_cont(coalesce(value, med), 0.25) AS p25, quantile_cont(coalesce(value, med), 0.5) AS p50,
                 quantile_cont(coalesce(value, med), 0.75) AS p75 FROM tr JOIN med USING (feature) GROUP BY feature),
    rf AS (SELECT feature, p50 AS center, CASE WHEN p75 - p25 = 0 THEN 1.0::DOUBLE ELSE p75 - p25 END AS scale FROM q)"""

_STANDARD_SQL = """
    te AS (SELECT feature, value FROM ls WHERE split = 'train' AND feature LIKE '%!_at' ESCAPE '!'),
    mu AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM te GROUP BY feature),
    dec AS (SELECT abs(avg(m)) > 0.1 OR abs(avg(s) - 1) > 0.3 AS rescaled FROM mu),
    sf AS (SELECT feature, avg(coalesce(value, m)) AS center, stddev_pop(coalesce(value, m)) AS scale
           FROM te JOIN mu USING (feature) GROUP BY feature)"""


@query(
    "robust_fit",
    f"WITH {_ROBUST_SQL} SELECT feature, round(center, 6) + 0.0 AS center, round(scale, 6) + 0.0 AS scale FROM rf",
)
def robust_fit(spark, sf_dir):
    fit = scaling.fit_robust(_split_cut(spark, sf_dir), MORPH_FEATURES)
    return fit.select("feature", rounded(F.col("center")).alias("center"), rounded(F.col("scale")).alias("scale"))


@query(
    "standard_fit",
    f"""WITH {_SPLIT_SQL}, {_STANDARD_SQL}
    SELECT feature, round(center, 6) + 0.0 AS center, round(scale, 6) + 0.0 AS scale, rescaled FROM sf, dec""",
)
def standard_fit(spark, sf_dir):
    fit = scaling.fit_standard(_split(spark, sf_dir), EXPR_FEATURES)
    return fit.select(
        "feature", rounded(F.col("center")).alias("center"), rounded(F.col("scale")).alias("scale"), "rescaled"
    )


@query(
    "standard_fit_skipped",
    f"""WITH {_SPLIT_SQL}, {_STANDARD_SQL},
    z AS (SELECT feature, (value - center) / scale AS value FROM te JOIN sf USING (feature)),
    zm AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM z GROUP BY feature)
    SELECT feature, 0.0::DOUBLE AS center, 1.0::DOUBLE AS scale,
           (SELECT abs(avg(m)) > 0.1 OR abs(avg(s) - 1) > 0.3 FROM zm) AS rescaled FROM zm""",
)
def standard_fit_skipped(spark, sf_dir):
    """A modality that is already z-scored is left alone."""
    rows = _split_cut(spark, sf_dir)
    scaled = scaling.apply_scaling(rows, scaling.fit_standard(rows, EXPR_FEATURES), EXPR_FEATURES, -1e9, 1e9)
    return scaling.fit_standard(scaled, EXPR_FEATURES)


_SCALED_SQL = f"""{_ROBUST_SQL}, {_STANDARD_SQL},
    fits AS (SELECT * FROM rf UNION ALL SELECT feature, CASE WHEN rescaled THEN center ELSE 0 END, CASE WHEN rescaled THEN scale ELSE 1 END FROM sf, dec),
    fw AS (SELECT """ + ", ".join(
    f"max(center) FILTER (feature = '{f}') AS c_{f}, max(scale) FILTER (feature = '{f}') AS s_{f}" for f in ALL_FEATURES
) + """ FROM fits)"""


def _scaled_col(f: str) -> str:
    z = f"({f} - c_{f}) / s_{f}"
    return f"CASE WHEN {f} IS NULL THEN NULL ELSE least(greatest({z}, -5.0::DOUBLE), 5.0::DOUBLE) END"


@query(
    "scaled_rows",
    f"WITH {_SCALED_SQL} SELECT order_key, row_key, split, "
    + ", ".join(f"round({_scaled_col(f)}, 6) + 0.0 AS {f}" for f in ALL_FEATURES)
    + " FROM sp, fw",
)
def scaled_rows(spark, sf_dir):
    rows = _split_cut(spark, sf_dir)
    fit = scaling.fit_modalities(rows, MORPH_FEATURES, EXPR_FEATURES)
    scaled = scaling.apply_scaling(rows, fit, ALL_FEATURES)
    return scaled.select("order_key", "row_key", "split", *[rounded(F.col(f)).alias(f) for f in ALL_FEATURES])


@query(
    "split_moments",
    f"""WITH {_SPLIT_SQL}, pf AS (SELECT split, feature, avg(value) AS m, stddev_samp(value) AS s FROM ls GROUP BY 1, 2),
    pm AS (SELECT split, avg(m) AS mean, avg(s) AS std FROM pf GROUP BY split),
    sz AS (SELECT split, count(*) AS rows FROM sp GROUP BY split)
    SELECT split, rows, round(rows * 100.0::DOUBLE / (SELECT count(*) FROM sp), 6) + 0.0 AS percent,
           round(mean, 5) + 0.0 AS mean, round(std, 5) + 0.0 AS std FROM sz JOIN pm USING (split)""",
)
def split_moments(spark, sf_dir):
    m = scaling.split_moments(_split(spark, sf_dir), ALL_FEATURES)
    return m.select(
        "split", "rows", rounded(F.col("percent")).alias("percent"),
        rounded(F.col("mean"), 5).alias("mean"), rounded(F.col("std"), 5).alias("std"),
    )


@query(
    "shared_key_rows",
    f"""WITH {_KEYED}
    SELECT 'expr' AS side, ordinal, compound_id FROM e WHERE compound_id IN (SELECT compound_id FROM m)
    UNION ALL SELECT 'morph', ordinal, compound_id FROM m WHERE compound_id IN (SELECT compound_id FROM e)""",
)
def shared_key_rows(spark, sf_dir):
    left, right = joins.restrict_to_shared(_expr(spark, sf_dir), _morph(spark, sf_dir), "compound_id")
    parts = [
        d.select(F.lit(s).alias("side"), "ordinal", "compound_id") for s, d in (("expr", left), ("morph", right))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "key_set_operations",
    f"""WITH {_KEYED},
    i AS (SELECT compound_id FROM e INTERSECT SELECT compound_id FROM m),
    u AS (SELECT compound_id FROM e UNION SELECT compound_id FROM m),
    d AS (SELECT compound_id FROM m EXCEPT SELECT compound_id FROM e)
    SELECT 'intersection' AS op, compound_id FROM i UNION ALL SELECT 'union', compound_id FROM u
    UNION ALL SELECT 'difference', compound_id FROM d""",
)
def key_set_operations(spark, sf_dir):
    from triskel.sources.tables import union_keys

    e, m = (d.select("compound_id") for d in (_expr(spark, sf_dir), _morph(spark, sf_dir)))
    parts = {
        "intersection": e.intersect(m),
        "union": union_keys([e, m], "compound_id"),
        "difference": joins.not_yet_done(m.distinct(), e, ["compound_id"]),
    }
    out = None
    for op, df in parts.items():
        part = df.select(F.lit(op).alias("op"), "compound_id")
        out = part if out is None else out.unionByName(part)
    return out


_PAIRED_SQL = """
    li AS (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY ordinal) - 1 AS i FROM e),
    ri AS (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY ordinal) - 1 AS j, count(*) OVER (PARTITION BY compound_id) AS n FROM m),
    paired AS (SELECT li.*, ri.ordinal AS morph_ordinal, ri.Metadata_broad_sample, ri.Metadata_moa, ri.Metadata_Plate, ri.Cells_price, ri.Nuclei_mod, ri.Cytoplasm_flat
      FROM li JOIN ri ON li.compound_id = ri.compound_id AND li.i % ri.n = ri.j)"""


@query(
    "pair_round_robin",
    f"WITH {_KEYED}, {_PAIRED_SQL} SELECT compound_id, ordinal, morph_ordinal, Metadata_Plate FROM paired",
)
def pair_round_robin(spark, sf_dir):
    right = _morph(spark, sf_dir).withColumn("morph_ordinal", F.col("ordinal"))
    paired = joins.pair_round_robin(_expr(spark, sf_dir), right, "compound_id")
    return paired.select("compound_id", "ordinal", "morph_ordinal", "Metadata_Plate")


@query(
    "pair_round_robin_wrapped",
    f"""WITH {_KEYED}, li AS (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY ordinal) - 1 AS i FROM e),
    ri AS (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY ordinal) - 1 AS j, count(*) OVER (PARTITION BY compound_id) AS n FROM mt)
    SELECT li.compound_id, li.ordinal, ri.ordinal AS meta_ordinal FROM li JOIN ri ON li.compound_id = ri.compound_id AND li.i % ri.n = ri.j""",
)
def pair_round_robin_wrapped(spark, sf_dir):
    """More left than right rows per key, in slices of four rows: the lookup is the
    naturally short side."""
    right = _meta(spark, sf_dir).select("compound_id", "ordinal", F.col("ordinal").alias("meta_ordinal"))
    paired = joins.pair_round_robin(
        _expr(spark, sf_dir).select("compound_id", "ordinal"), right, "compound_id", slice_rows=4
    )
    return paired.select("compound_id", "ordinal", "meta_ordinal")


@query(
    "ordinal_within_key",
    f"WITH {_KEYED} SELECT compound_id, ordinal, row_number() OVER (PARTITION BY compound_id ORDER BY ordinal) - 1 AS position FROM m",
)
def ordinal_within_key(spark, sf_dir):
    df = _morph(spark, sf_dir).select("compound_id", "ordinal")
    return ordering.ordered_index(df, ["compound_id"], ["ordinal"], "position")


@query(
    "first_per_key",
    f"""WITH {_KEYED} SELECT compound_id, ordinal, Metadata_Plate FROM
    (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY ordinal) AS r FROM m) WHERE r = 1""",
)
def first_per_key(spark, sf_dir):
    return ordering.first_per_key(_morph(spark, sf_dir), ["compound_id"], "ordinal").select(
        "compound_id", "ordinal", "Metadata_Plate"
    )


@query(
    "last_wins_lookup",
    f"""WITH {_KEYED}, l AS (SELECT compound_id, smiles FROM (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY ordinal DESC) AS r FROM mt) WHERE r = 1)
    SELECT e.ordinal, e.compound_id, l.smiles FROM e LEFT JOIN l USING (compound_id)""",
)
def last_wins_lookup(spark, sf_dir):
    rows = _expr(spark, sf_dir).select("ordinal", "compound_id")
    return joins.lookup(rows, _meta(spark, sf_dir), "compound_id", "smiles", "smiles")


_RESOLVED_SQL = f"""
    s1 AS (SELECT compound_id, smiles AS v1 FROM (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY ordinal DESC) AS r FROM mt) WHERE r = 1),
    info AS (SELECT compound_id, moa AS moa1 FROM (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY ordinal DESC) AS r FROM mt WHERE moa IS NOT NULL) WHERE r = 1),
    third AS (SELECT DISTINCT 'cpd-' || CAST(user_id AS VARCHAR) AS pert_iname, CASE WHEN user_id % 2 = 0 THEN 'W' || CAST(user_id AS VARCHAR) END AS v3 FROM events),
    res0 AS (SELECT paired.*, v1, split_part(x_smiles, ' |', 1) AS v2, v3, moa1 FROM paired LEFT JOIN s1 USING (compound_id) LEFT JOIN info USING (compound_id) LEFT JOIN third USING (pert_iname)),
    res AS (SELECT *, CASE WHEN {_VALID.format(c='v1')} THEN split_part(v1, ' |', 1) WHEN {_VALID.format(c='v2')} THEN v2 WHEN {_VALID.format(c='v3')} THEN v3 END AS smiles,
      CASE WHEN {_VALID.format(c='v1')} THEN 1 WHEN {_VALID.format(c='v2')} THEN 2 WHEN {_VALID.format(c='v3')} THEN 3 END AS stage,
      coalesce(moa1, Metadata_moa) AS moa FROM res0)"""


def _fallback(spark, sf_dir):
    """Name to identifier: what a cached web lookup would hold."""
    names = build(spark, sf_dir, EXPR_SIDE).select("user_id", "ordinal")
    uid = F.col("user_id").cast("string")
    return names.select(F.concat(F.lit("cpd-"), uid).alias("pert_iname"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("W"), uid)).alias("smiles"), "ordinal")


def _paired(spark, sf_dir):
    return joins.pair_round_robin(_expr(spark, sf_dir), _morph(spark, sf_dir), "compound_id")


@query(
    "resolve_identifier",
    f"WITH {_KEYED}, {_PAIRED_SQL}, {_RESOLVED_SQL} SELECT ordinal, compound_id, smiles, stage FROM res",
)
def resolve_identifier(spark, sf_dir):
    out = joins.resolve_identifier(
        _paired(spark, sf_dir), _meta(spark, sf_dir), fallback=_fallback(spark, sf_dir)
    )
    return out.select("ordinal", "compound_id", "smiles", "stage")


@query(
    "resolution_counts",
    f"""WITH {_KEYED}, {_PAIRED_SQL}, {_RESOLVED_SQL} SELECT count(*) FILTER (stage = 1) AS stage1, count(*) FILTER (stage = 2) AS stage2,
    count(*) FILTER (stage = 3) AS stage3, count(smiles) AS resolved, count(*) FILTER (smiles IS NULL) AS missing,
    round(avg((smiles IS NOT NULL)::INT) * 100, 6) + 0.0 AS coverage FROM res""",
)
def resolution_counts(spark, sf_dir):
    out = joins.stage_counts(resolve_identifier(spark, sf_dir))
    return out.withColumn("coverage", rounded(F.col("coverage")))


@query(
    "resolve_label",
    f"WITH {_KEYED}, {_PAIRED_SQL}, {_RESOLVED_SQL} SELECT ordinal, compound_id, moa FROM res",
)
def resolve_label(spark, sf_dir):
    return joins.resolve_label(_paired(spark, sf_dir), _meta(spark, sf_dir)).select("ordinal", "compound_id", "moa")


def _matched(spark, sf_dir):
    m = _meta(spark, sf_dir)
    return flow.match_treatments(
        _morph(spark, sf_dir), _expr(spark, sf_dir), m, info=m, fallback=_fallback(spark, sf_dir)
    )


@query(
    "match_treatments",
    f"""WITH {_KEYED}, {_PAIRED_SQL}, {_RESOLVED_SQL} SELECT ordinal, compound_id, smiles, moa, Metadata_Plate, gene_0_at, Nuclei_mod
    FROM res WHERE smiles IS NOT NULL""",
)
def match_treatments(spark, sf_dir):
    return _matched(spark, sf_dir).select(
        "ordinal", "compound_id", "smiles", "moa", "Metadata_Plate", "gene_0_at", "Nuclei_mod"
    )


@query(
    "match_coverage",
    f"""WITH {_KEYED}, {_PAIRED_SQL}, {_RESOLVED_SQL} SELECT count(*) AS rows, count(DISTINCT compound_id) AS unique_keys,
    round(avg((smiles IS NOT NULL)::INT) * 100, 6) + 0.0 AS smiles_pct, round(avg((moa IS NOT NULL)::INT) * 100, 6) + 0.0 AS moa_pct
    FROM res WHERE smiles IS NOT NULL""",
)
def match_coverage(spark, sf_dir):
    c = joins.match_coverage(_matched(spark, sf_dir))
    return c.withColumns({k: rounded(F.col(k)) for k in ("smiles_pct", "moa_pct")})


# Compounds are customers, scaffolds a coarser id; every ninth has no scaffold.
_GROUPS = {
    "compound_id": "o_custkey",
    "ordinal": "o_orderkey",
    "smiles": "'R' || CAST(o_custkey AS STRING) || ' |x|'",
    "scaffold": "CASE WHEN o_custkey % 9 <> 0 THEN 'ring' || CAST((o_custkey * 7) % 211 AS STRING) END",
}
_GROUP_SQL = "gr AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _GROUPS.items()) + " FROM orders)"
_KEY_SQL = "coalesce(scaffold, split_part(smiles, ' |', 1))"


def _grouped(spark, sf_dir):
    return build(spark, sf_dir, ("orders", _GROUPS))


def _group_column():
    return splits.group_key(F.col("smiles"), F.col("scaffold"))


@query(
    "group_sizes",
    f"""WITH {_GROUP_SQL}, c AS (SELECT compound_id, count(*) AS n_rows, arg_min({_KEY_SQL}, ordinal) AS group_key FROM gr GROUP BY compound_id)
    SELECT group_key, count(*) AS compounds, sum(n_rows)::BIGINT AS rows FROM c GROUP BY group_key""",
)
def group_sizes(spark, sf_dir):
    c = splits.compounds_of(_grouped(spark, sf_dir), "compound_id", _group_column(), "ordinal")
    return c.groupBy("group_key").agg(F.count(F.lit(1)).alias("compounds"), F.sum("n_rows").alias("rows"))


_GH = hash_sql("42", "group_key")


# From c (compound_id, n_rows, group_key): the sequential rule, one group after another.
_WALK_SQL = f"""g AS (SELECT group_key, count(*) AS compounds, sum(n_rows)::BIGINT AS rows FROM c GROUP BY group_key),
    o AS (SELECT *, row_number() OVER (ORDER BY compounds DESC, rows DESC, {_GH}, group_key) AS i FROM g),
    t AS (SELECT sum(rows)::DOUBLE AS n FROM g),
    walk AS (
      SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, ''::VARCHAR AS pick
      UNION ALL
      SELECT i, a + CASE WHEN pick = 'train' THEN rows ELSE 0 END, b + CASE WHEN pick = 'val' THEN rows ELSE 0 END,
             c + CASE WHEN pick = 'test' THEN rows ELSE 0 END, pick
      FROM (SELECT o.i, walk.a, walk.b, walk.c, o.rows,
              CASE WHEN walk.a / (0.7 * n) <= walk.b / (0.15 * n) AND walk.a / (0.7 * n) <= walk.c / (0.15 * n) THEN 'train'
                   WHEN walk.b / (0.15 * n) <= walk.c / (0.15 * n) THEN 'val' ELSE 'test' END AS pick
            FROM walk JOIN o ON o.i = walk.i + 1, t)),
    quota AS (SELECT compounds, rows, count(*) FILTER (pick = 'train') AS nt, count(*) FILTER (pick = 'val') AS nv FROM walk JOIN o USING (i) GROUP BY 1, 2),
    placed AS (SELECT group_key, compounds, rows, row_number() OVER (PARTITION BY compounds, rows ORDER BY {_GH}, group_key) AS r FROM g),
    sp AS (SELECT compound_id, CASE WHEN r <= nt THEN 'train' WHEN r <= nt + nv THEN 'val' ELSE 'test' END AS split
      FROM c JOIN placed USING (group_key) JOIN quota USING (compounds, rows))"""


@query(
    "group_split_greedy",
    f"""WITH RECURSIVE {_GROUP_SQL},
    c AS (SELECT compound_id, count(*) AS n_rows, arg_min({_KEY_SQL}, ordinal) AS group_key FROM gr GROUP BY compound_id),
    {_WALK_SQL}
    SELECT * FROM sp""",
)
def group_split_greedy(spark, sf_dir):
    rows = splits.greedy_split(_grouped(spark, sf_dir), group=_group_column())
    return rows.select("compound_id", "split").distinct()


@query(
    "group_split_hashed",
    f"""WITH {_GROUP_SQL}, k AS (SELECT ordinal, compound_id, {_KEY_SQL} AS group_key FROM gr)
    SELECT ordinal, compound_id, group_key, CASE WHEN {_GH} / 4294967296.0::DOUBLE < 0.7 THEN 'train'
      WHEN {_GH} / 4294967296.0::DOUBLE < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM k""",
)
def group_split_hashed(spark, sf_dir):
    keyed = _grouped(spark, sf_dir).withColumn("group_key", _group_column())
    return splits.hashed_split(keyed, "group_key").select("ordinal", "compound_id", "group_key", "split")


@query(
    "split_sizes",
    f"""WITH {_GROUP_SQL}, k AS (SELECT {_KEY_SQL} AS group_key FROM gr),
    s AS (SELECT CASE WHEN {_GH} / 4294967296.0::DOUBLE < 0.7 THEN 'train' WHEN {_GH} / 4294967296.0::DOUBLE < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM k)
    SELECT split, count(*) AS rows, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM s), 6) + 0.0 AS percent FROM s GROUP BY split""",
)
def split_sizes(spark, sf_dir):
    return splits.split_sizes(group_split_hashed(spark, sf_dir)).withColumn("percent", rounded(F.col("percent")))


_Q1_FEATURES = ["Cells_price", "Nuclei_mod", "Cytoplasm_flat", "gene_0_at", "gene_1_at", "gene_2_at", "gene_3_at"]
_Q1_SPLIT = f"({hash_sql('42', 'smiles')} / 4294967296.0::DOUBLE)"


_Q1_HASHED = f"""q1s AS (SELECT *, CASE WHEN {_Q1_SPLIT} < 0.7 THEN 'train' WHEN {_Q1_SPLIT} < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM q1b)"""
_Q1_GREEDY = f"""c AS (SELECT compound_id, count(*) AS n_rows, arg_min(smiles, ordinal) AS group_key FROM q1b GROUP BY compound_id),
    {_WALK_SQL}, q1s AS (SELECT q1b.*, sp.split FROM q1b JOIN sp USING (compound_id))"""


def _q1_sql(split: str = _Q1_HASHED, mean: str = "avg(value)", deviation: str = "stddev_pop(coalesce(value, mean))") -> str:
    clean = ", ".join(f"CASE WHEN isfinite({f}) THEN {f} END AS {f}" for f in _Q1_FEATURES)
    long = " UNION ALL ".join(f"SELECT ordinal, split, '{f}' AS feature, {f} AS value FROM q1s" for f in _Q1_FEATURES)
    return f"""{_KEYED}, {_PAIRED_SQL}, {_RESOLVED_SQL},
    q1c AS (SELECT ordinal, compound_id, smiles, moa, {clean} FROM res WHERE smiles IS NOT NULL
      AND NOT coalesce(lower(trim(pert_iname)) IN ('dmso', 'empty'), FALSE)
      AND NOT coalesce(lower(trim(pert_type)) IN ('ctl_vehicle', 'ctl_untrt'), FALSE)),
    q1b AS (SELECT * FROM q1c WHERE coalesce({', '.join(_Q1_FEATURES)}) IS NOT NULL), {split},
    q1l AS ({long}),
    ok AS (SELECT feature FROM q1l GROUP BY feature HAVING avg((value IS NULL)::INT) <= 0.05 AND stddev_samp(value) FILTER (split = 'train') <> 0),
    lk AS (SELECT *, feature LIKE '%!_at' ESCAPE '!' AS is_expr FROM q1l JOIN ok USING (feature)),
    mm AS (SELECT feature, median(value) AS med, {mean} AS mean, stddev_samp(value) AS sd FROM lk WHERE split = 'train' GROUP BY feature),
    dd AS (SELECT abs(avg(mean)) > 0.1 OR abs(avg(sd) - 1) > 0.3 AS rescaled FROM mm WHERE feature LIKE '%!_at' ESCAPE '!'),
    ff AS (SELECT feature, any_value(is_expr) AS is_expr, any_value(med) AS med, any_value(mean) AS mean,
             quantile_cont(coalesce(value, med), 0.75) - quantile_cont(coalesce(value, med), 0.25) AS iqr,
             {deviation} AS sdp FROM lk JOIN mm USING (feature) WHERE split = 'train' GROUP BY feature),
    fc AS (SELECT feature, CASE WHEN NOT is_expr THEN med WHEN rescaled THEN mean ELSE 0 END AS center,
             CASE WHEN NOT is_expr THEN CASE WHEN iqr = 0 THEN 1 ELSE iqr END WHEN rescaled THEN CASE WHEN sdp = 0 THEN 1 ELSE sdp END ELSE 1 END AS scale FROM ff, dd)"""


_CURATED_SQL = """SELECT ordinal, compound_id, smiles, moa, split, feature,
      round(CASE WHEN value IS NULL THEN NULL ELSE least(greatest((value - center) / scale, -5.0::DOUBLE), 5.0::DOUBLE) END, 6) + 0.0 AS value
    FROM lk JOIN fc USING (feature) JOIN (SELECT ordinal, compound_id, smiles, moa FROM q1s) USING (ordinal)"""


def _curated(spark, sf_dir, greedy):
    curated = flow.curate(_matched(spark, sf_dir), greedy=greedy)
    features = curated.morph_features + curated.expr_features
    long = filters.to_long(curated.rows, ["ordinal", "compound_id", "smiles", "moa", "split"], features)
    return long.withColumn("value", rounded(F.col("value")))


@query("curated_rows", f"WITH {_q1_sql()} {_CURATED_SQL}")
def curated_rows(spark, sf_dir):
    """The whole curation flow, in long form."""
    return _curated(spark, sf_dir, greedy=False)


# Compensated sums: plain ones hang on the order of rows, and so would the last decimal.
_Q1_GREEDY_SQL = _q1_sql(_Q1_GREEDY, "favg(value)", "sqrt(favg(pow(coalesce(value, mean) - mean, 2)))")


@query("curated_rows_greedy", f"WITH RECURSIVE {_Q1_GREEDY_SQL} {_CURATED_SQL}")
def curated_rows_greedy(spark, sf_dir):
    """The same with the greedy split of groups."""
    return _curated(spark, sf_dir, greedy=True)
