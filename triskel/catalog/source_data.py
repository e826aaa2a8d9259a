"""Raw-source stand-ins derived from the driver's tables.

The column expressions are valid in Spark and DuckDB alike, so both sides read the
same inputs; missing values, infinities, duplicates and controls are planted by
modulo. Only inputs are shared: the operators and their SQL are written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triskel.catalog.base import table

_ID = "'BRD-K' || lpad(CAST({c} AS STRING), 8, '0')"
_INF = "CAST('Infinity' AS DOUBLE)"
_NAN = "CAST('NaN' AS DOUBLE)"

EXPR_SIDE = (
    "events",
    {
        "ordinal": "event_id",
        "user_id": "user_id",
        "pert_id": _ID.format(c="user_id") + " || '-' || CAST(event_id % 7 AS STRING)",
        "pert_iname": "CASE WHEN event_id % 50 = 0 THEN ' DMSO ' WHEN event_id % 50 = 1 THEN 'Empty' "
        "WHEN event_id % 50 = 2 THEN NULL ELSE 'cpd-' || CAST(user_id AS STRING) END",
        "pert_type": "CASE WHEN event_id % 40 = 3 THEN 'CTL_Vehicle' WHEN event_id % 40 = 5 THEN 'ctl_untrt ' "
        "WHEN event_id % 40 = 7 THEN NULL ELSE 'trt_cp' END",
        "x_smiles": "CASE WHEN user_id % 6 = 0 THEN '-666' WHEN user_id % 6 = 1 THEN NULL WHEN user_id % 6 = 2 THEN '  ' "
        "WHEN user_id % 6 = 3 THEN 'C' || CAST(user_id AS STRING) || ' |r,f|' ELSE 'CC' || CAST(user_id AS STRING) END",
        "gene_0_at": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE value END",
        "gene_1_at": f"CASE WHEN event_id % 500 = 0 THEN {_INF} ELSE value / 10 + CAST(event_id % 17 AS DOUBLE) END",
        "gene_2_at": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END",
        "gene_3_at": "CAST(3 AS DOUBLE)",
    },
)

MORPH_SIDE = (
    "orders",
    {
        "ordinal": "o_orderkey",
        "Metadata_broad_sample": _ID.format(c="o_custkey") + " || '-001-01'",
        "Metadata_moa": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'moa-' || substr(o_orderpriority, 1, 1) END",
        "Metadata_Plate": "'P' || CAST(o_orderkey % 11 AS STRING)",
        "Cells_price": f"CASE WHEN o_orderkey % 53 = 0 THEN {_INF} ELSE o_totalprice / 1000 END",
        "Nuclei_mod": "CAST(o_orderkey % 97 AS DOUBLE)",
        "Cytoplasm_flat": "CAST(1 AS DOUBLE)",
    },
)

# Lookup with duplicates: later rows of a key win, and may hold NULL.
META_FIRST = (
    "customer",
    {
        "ordinal": "c_custkey",
        "broad_id": _ID.format(c="c_custkey") + " || '-003-22-1'",
        "smiles": "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN '-666' "
        "WHEN c_custkey % 7 = 2 THEN 'N' || CAST(c_custkey AS STRING) || ' |ann|' ELSE 'O' || CAST(c_custkey AS STRING) END",
        "moa": "CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE c_mktsegment END",
    },
)
META_SECOND = (
    "customer",
    {
        "ordinal": "c_custkey + 1000000000",
        "broad_id": _ID.format(c="c_custkey") + " || '-004-01-9'",
        "smiles": "CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'S2x' || CAST(c_custkey AS STRING) END",
        "moa": "CASE WHEN c_custkey % 12 = 0 THEN 'late-' || c_mktsegment END",
    },
)
META_SECOND_WHERE = "c_custkey % 4 = 0"

_ROW = "CASE WHEN l_orderkey % 777 = 3 THEN NULL ELSE {e} END"
FEATURES = (
    "lineitem",
    {
        "row_key": "l_partkey",
        "order_key": "l_orderkey",
        "Cells_qty": _ROW.format(e="l_quantity"),
        "Cells_price": _ROW.format(e="CASE WHEN l_orderkey % 25 = 0 THEN NULL ELSE l_extendedprice / 1000 END"),
        "Cells_gap": _ROW.format(e="CASE WHEN l_orderkey % 16 = 0 THEN NULL ELSE l_quantity * 2 END"),
        "Cells_flat": _ROW.format(e="CAST(1 AS DOUBLE)"),
        "Nuclei_spike": _ROW.format(
            e=f"CASE WHEN l_orderkey % 1000 = 7 THEN {_INF} WHEN l_orderkey % 1000 = 8 THEN {_NAN} "
            "ELSE l_extendedprice / (1000 + l_quantity) END"
        ),
        "gene_disc_at": _ROW.format(e="l_discount * 100"),
        "gene_tax_at": _ROW.format(e="CASE WHEN l_orderkey % 40 = 0 THEN NULL ELSE l_tax * 100 END"),
    },
)
MORPH_FEATURES = ["Cells_qty", "Cells_price", "Cells_gap", "Cells_flat", "Nuclei_spike"]
EXPR_FEATURES = ["gene_disc_at", "gene_tax_at"]
ALL_FEATURES = MORPH_FEATURES + EXPR_FEATURES


def build(spark: SparkSession, sf_dir: str, spec, where: str | None = None) -> DataFrame:
    name, columns = spec
    df = table(spark, sf_dir, name)
    if where:
        df = df.where(where)
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def sql_of(spec, where: str | None = None) -> str:
    name, columns = spec
    tail = f" WHERE {where}" if where else ""
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {name}{tail}"


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = build(spark, sf_dir, META_FIRST)
    return first.unionByName(build(spark, sf_dir, META_SECOND, META_SECOND_WHERE))


EXPR_SQL = f"ex AS ({sql_of(EXPR_SIDE)})"
MORPH_SQL = f"mo AS ({sql_of(MORPH_SIDE)})"
META_SQL = f"meta AS ({sql_of(META_FIRST)} UNION ALL {sql_of(META_SECOND, META_SECOND_WHERE)})"
FEATURE_SQL = f"ft AS ({sql_of(FEATURES)})"
