"""Queries of sources, sinks and audits. Files are written from the driver's tables
into the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from triskel.catalog.base import query, table
from triskel.catalog.curation import _SPLIT_SQL, _split
from triskel.catalog.source_data import (
    EXPR_SIDE,
    EXPR_SQL,
    META_SQL,
    MORPH_SIDE,
    MORPH_SQL,
    build,
    meta,
)
from triskel.functions.numeric import rounded
from triskel.operators import audit
from triskel.session import shared_folder
from triskel.sources import csv_files, sinks, tables


def _write_batches(spark, sf_dir):
    """Two batches of morphology CSVs whose columns differ; the second is compressed."""
    folder = f"{shared_folder(spark)}/morph"
    one, two = _batches(build(spark, sf_dir, MORPH_SIDE))
    one.coalesce(2).write.mode("append").csv(folder, header=True)
    two.coalesce(2).write.mode("append").csv(folder, header=True, compression="gzip")
    return folder


def _batches(rows):
    one = rows.where("ordinal % 2 = 0").select(
        "Metadata_Plate", "Metadata_broad_sample", "Metadata_moa", "Cells_price",
        F.col("Nuclei_mod").alias("Nuclei_only_one"), "Nuclei_mod", F.col("ordinal").alias("extra"),
    )
    two = rows.where("ordinal % 2 = 1").select(
        "Nuclei_mod", "Cells_price", "Metadata_broad_sample", "Metadata_Plate", "Cytoplasm_flat"
    )
    return one, two


@query(
    "morphology_csv_union",
    f"""WITH {MORPH_SQL} SELECT substr(Metadata_broad_sample, 1, 13) AS compound_id, Metadata_Plate,
    round(CASE WHEN isfinite(Cells_price) THEN Cells_price END, 6) + 0.0 AS Cells_price, Nuclei_mod FROM mo""",
)
def morphology_csv_union(spark, sf_dir):
    df = tables.morphology_csv(spark, _write_batches(spark, sf_dir))
    expected = {"Cells_price", "Nuclei_mod", "Metadata_Plate", "Metadata_broad_sample", "ordinal", "compound_id"}
    if set(df.columns) != expected:
        raise ValueError(f"unexpected shared columns {df.columns}")
    return df.select("compound_id", "Metadata_Plate", rounded(F.col("Cells_price")).alias("Cells_price"), "Nuclei_mod")


_GENES = ["click", "error", "purchase", "signup", "view"]
_SAMPLES = [f"sample_{i}" for i in range(40)]
_MATRIX_SQL = """ag AS (SELECT event_type AS feature, user_id % 40 AS s, CASE WHEN (user_id % 40) % 13 <> 5 THEN avg(value) END AS value
      FROM events GROUP BY event_type, user_id % 40),
    mx AS (SELECT feature, 'sample_' || CAST(s AS VARCHAR) AS inst_id, value
      FROM (SELECT DISTINCT feature FROM ag) CROSS JOIN range(0, 40) g(s) LEFT JOIN ag USING (feature, s))"""


def _matrix(spark, sf_dir):
    """Feature-by-sample matrix: one row per event type, one column per user bucket."""
    cells = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("gene"),
        F.concat(F.lit("sample_"), (F.col("user_id") % 40).cast("string")).alias("s"),
        F.when((F.col("user_id") % 40) % 13 != 5, F.col("value")).alias("value"),
    )
    return cells.groupBy("gene").pivot("s", _SAMPLES).agg(F.avg("value"))


@query(
    "matrix_transpose",
    f"WITH {_MATRIX_SQL} SELECT inst_id, "
    + ", ".join(f"max(round(value, 6) + 0.0) FILTER (feature = '{g}') AS {g}" for g in _GENES)
    + " FROM mx GROUP BY inst_id",
)
def matrix_transpose(spark, sf_dir):
    wide = tables.transpose(_matrix(spark, sf_dir), "gene", _GENES)
    return wide.select("inst_id", *[rounded(F.col(g)).alias(g) for g in _GENES])


@query(
    "sidecar_join",
    f"""WITH {_MATRIX_SQL}, sc AS (SELECT 'sample_' || CAST(c_custkey AS VARCHAR) AS profile_id, c_mktsegment AS segment FROM customer)
    SELECT DISTINCT inst_id, segment FROM mx LEFT JOIN sc ON profile_id = inst_id""",
)
def sidecar_join(spark, sf_dir):
    samples = tables.transpose(_matrix(spark, sf_dir), "gene", _GENES)
    sidecar = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("sample_"), F.col("c_custkey").cast("string")).alias("profile_id"),
        F.col("c_mktsegment").alias("segment"),
    )
    return tables.attach_sidecar(samples, sidecar).select("inst_id", "segment")


_META_SCHEMA = "broad_id string, smiles string, moa string, place bigint"


def _write_meta(spark, sf_dir):
    """Lookup TSV with comment lines after the header."""
    path = f"{shared_folder(spark)}/meta.txt"
    rows = meta(spark, sf_dir).select("broad_id", "smiles", "moa", F.col("ordinal").alias("place"))
    notes = rows.where("place % 10 = 0").withColumn("broad_id", F.concat(F.lit("!"), "broad_id"))
    rows.unionByName(notes).write.csv(path, sep="\t", header=True)
    return path


@query(
    "metadata_tsv",
    f"WITH {META_SQL} SELECT ordinal AS place, substr(broad_id, 1, 13) AS compound_id, nullif(trim(smiles), '') AS smiles, moa FROM meta",
)
def metadata_tsv(spark, sf_dir):
    df = tables.metadata_tsv(spark, _write_meta(spark, sf_dir), _META_SCHEMA)
    return df.select("place", "compound_id", "smiles", "moa")


@query(
    "optional_source",
    f"""WITH {META_SQL}, s AS (SELECT 'present' AS source, count(*) AS n FROM meta UNION ALL SELECT 'absent', 0)
    SELECT source, n FROM s""",
)
def optional_source(spark, sf_dir):
    path = _write_meta(spark, sf_dir)
    out = None
    for name, p in (("present", path), ("absent", path + ".missing")):
        n = tables.optional_tsv(spark, p, _META_SCHEMA).agg(F.count(F.lit(1)).alias("n"))
        part = n.select(F.lit(name).alias("source"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "processed_split_roundtrip",
    f"""WITH {_SPLIT_SQL} SELECT order_key AS ordinal, CAST(row_key AS VARCHAR) AS compound_id, Cells_qty, Cells_price, gene_tax_at
    FROM sp WHERE split = 'val'""",
)
def processed_split_roundtrip(spark, sf_dir):
    folder = f"{shared_folder(spark)}/processed"
    rows = _split(spark, sf_dir).withColumn("compound_id", F.col("row_key").cast("string"))
    sinks.write_splits(rows.withColumnRenamed("order_key", "ordinal"), folder)
    sinks.write_manifest(sinks.manifest_table(spark, ["Cells_qty", "Cells_price"], ["gene_tax_at"]), folder)
    out = tables.processed_split(spark, folder, "val")
    return out.select("ordinal", "compound_id", "Cells_qty", "Cells_price", "gene_tax_at")


@query(
    "result_csv_roundtrip",
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY o_orderstatus",
)
def result_csv_roundtrip(spark, sf_dir):
    path = f"{shared_folder(spark)}/result.csv"
    result = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total")
    )
    sinks.write_csv(result, path)
    return spark.read.schema("o_orderstatus string, n bigint, total double").csv(path, header=True)


@query(
    "union_on_shared_columns",
    """SELECT c_name AS name, c_acctbal AS acctbal, c_nationkey AS nationkey FROM customer
    UNION ALL SELECT s_name, s_acctbal, s_nationkey FROM supplier""",
)
def union_on_shared_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier")
    parts = [d.toDF(*[n.split("_", 1)[1] for n in d.columns]) for d in (c, s)]
    return tables.union_shared(parts)


def _file_audit_sql(name: str, columns: str, half: int) -> str:
    """Table ``name`` of one written batch: rows, numeric columns, and missing and infinite cells in these."""
    return f"""{name}_rows AS (SELECT {columns} FROM mo WHERE ordinal % 2 = {half}),
    {name}_long AS (UNPIVOT (SELECT coalesce(COLUMNS(*)::VARCHAR, '') FROM {name}_rows) ON COLUMNS(*) INTO NAME c VALUE v),
    {name}_cols AS (SELECT c, count(*) FILTER (v = '') AS missing, count(*) FILTER (isinf(try_cast(v AS DOUBLE))) AS inf
      FROM {name}_long GROUP BY c HAVING bool_and(v = '' OR try_cast(v AS DOUBLE) IS NOT NULL)),
    {name} AS (SELECT (SELECT count(*) FROM {name}_rows) AS n, count(*) AS k, sum(missing) AS missing, sum(inf) AS inf FROM {name}_cols)"""


# The third file is broken: it counts as a file and gives nothing else.
_FILES_SQL = f"""{MORPH_SQL},
    {_file_audit_sql("one", "Metadata_Plate, Metadata_broad_sample, Metadata_moa, Cells_price, Nuclei_mod AS Nuclei_only_one, Nuclei_mod, ordinal AS extra", 0)},
    {_file_audit_sql("two", "Nuclei_mod, Cells_price, Metadata_broad_sample, Metadata_Plate, Cytoplasm_flat", 1)},
    fa AS (SELECT count(*) + 1 AS n_files, sum(n)::BIGINT AS total_rows, max(k) AS n_numeric_columns,
      sum(missing)::DOUBLE / sum(n * k) AS nan_rate, sum(inf)::BIGINT AS inf_count FROM (SELECT * FROM one UNION ALL SELECT * FROM two))"""


def _audit_files(spark, sf_dir):
    """The two batches as a file each, one of them in a sub-folder, and a file that is no archive."""
    folder = f"{shared_folder(spark)}/audit"
    rows = build(spark, sf_dir, MORPH_SIDE)
    one, two = _batches(rows)
    one.coalesce(1).write.csv(f"{folder}/first", header=True)
    two.coalesce(1).write.csv(f"{folder}/first/deeper", header=True, compression="gzip")
    csv_files.write_bytes(f"{folder}/broken.csv.gz", b"not an archive")
    return csv_files.audit_folder(spark, folder)


@query(
    "audit_feature_files",
    f"WITH {_FILES_SQL} SELECT n_files, total_rows, n_numeric_columns, round(nan_rate, 6) + 0.0 AS nan_rate, inf_count FROM fa",
)
def audit_feature_files(spark, sf_dir):
    return _audit_files(spark, sf_dir).withColumn("nan_rate", rounded(F.col("nan_rate")))


@query(
    "audit_matrix",
    f"""WITH {_MATRIX_SQL} SELECT count(DISTINCT inst_id) AS n_samples, count(DISTINCT feature) AS n_genes, round(avg(value), 6) + 0.0 AS mean,
    round(stddev_pop(value), 6) + 0.0 AS std, round(avg((value IS NULL)::INT), 6) + 0.0 AS nan_rate FROM mx""",
)
def audit_matrix(spark, sf_dir):
    stats = audit.audit_matrix(tables.transpose_long(_matrix(spark, sf_dir), "gene"))
    return stats.select("n_samples", "n_genes", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "nan_rate")])


@query(
    "audit_lookup",
    f"""WITH {META_SQL} SELECT count(*) AS n_compounds, 4::BIGINT AS n_columns, round(avg((smiles IS NOT NULL)::INT), 6) + 0.0 AS smiles_coverage,
    round(avg((moa IS NOT NULL)::INT), 6) + 0.0 AS moa_coverage, TRUE AS has_broad_id, TRUE AS has_smiles FROM meta""",
)
def audit_lookup(spark, sf_dir):
    stats = audit.audit_lookup(meta(spark, sf_dir))
    return stats.withColumns({c: rounded(F.col(c)) for c in ("smiles_coverage", "moa_coverage")})


_OVERLAP_SQL = f"""{EXPR_SQL}, {MORPH_SQL}, {META_SQL},
    a AS (SELECT DISTINCT substr(Metadata_broad_sample, 1, 13) AS k FROM mo), b AS (SELECT DISTINCT substr(pert_id, 1, 13) AS k FROM ex),
    c AS (SELECT DISTINCT substr(broad_id, 1, 13) AS k FROM meta),
    ov AS (SELECT (SELECT count(*) FROM a) AS morph_keys, (SELECT count(*) FROM b) AS expr_keys, (SELECT count(*) FROM c) AS meta_keys,
      (SELECT count(*) FROM a JOIN b USING (k)) AS morph_expr_overlap, (SELECT count(*) FROM a JOIN c USING (k)) AS morph_meta_overlap,
      (SELECT count(*) FROM b JOIN c USING (k)) AS expr_meta_overlap, (SELECT count(*) FROM a JOIN b USING (k) JOIN c USING (k)) AS all_overlap)"""


def _overlap(spark, sf_dir):
    sources = {
        "morph": build(spark, sf_dir, MORPH_SIDE).select(F.col("Metadata_broad_sample").alias("key")),
        "expr": build(spark, sf_dir, EXPR_SIDE).select(F.col("pert_id").alias("key")),
        "meta": meta(spark, sf_dir).select(F.col("broad_id").alias("key")),
    }
    return audit.key_overlap(sources, "key")


@query("key_overlap_counts", f"WITH {_OVERLAP_SQL} SELECT * FROM ov")
def key_overlap_counts(spark, sf_dir):
    return _overlap(spark, sf_dir)


@query(
    "overlap_verdict",
    f"WITH {_OVERLAP_SQL} SELECT all_overlap AS paired, all_overlap >= 1000 AS sufficient FROM ov",
)
def overlap_verdict(spark, sf_dir):
    return audit.overlap_verdict(_overlap(spark, sf_dir), "morph_expr_overlap")


@query(
    "audit_report",
    f"""WITH {_OVERLAP_SQL}, {_FILES_SQL.removeprefix(MORPH_SQL + ",")}
    SELECT 'morphology' AS section, metric, value FROM (SELECT CAST(n_files AS VARCHAR) AS n_files, CAST(total_rows AS VARCHAR) AS total_rows,
      CAST(n_numeric_columns AS VARCHAR) AS n_numeric_columns, printf('%.4f', nan_rate) AS nan_rate, CAST(inf_count AS VARCHAR) AS inf_count FROM fa)
      UNPIVOT (value FOR metric IN (n_files, total_rows, n_numeric_columns, nan_rate, inf_count))
    UNION ALL SELECT 'expression', 'status', 'not available'
    UNION ALL SELECT 'overlap', metric, value FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ov) UNPIVOT (value FOR metric IN (*))""",
)
def audit_report(spark, sf_dir):
    files = _audit_files(spark, sf_dir).withColumn("nan_rate", F.format_string("%.4f", "nan_rate"))
    return audit.audit_report(
        spark, {"morphology": files, "expression": None, "overlap": _overlap(spark, sf_dir)}
    )
