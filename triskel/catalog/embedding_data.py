"""The aligned embedding table derived from ``embeddings``, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triskel.catalog.base import table
from triskel.functions.vectors import unit

MODS = ["mol", "morph", "expr"]
PAIRS = [("mol", "morph"), ("mol", "expr"), ("morph", "expr")]
DIRECTIONS = [(a, b) for a in MODS for b in MODS if a != b]
WIDTH = 32


def raw_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, group_id, label, and unnormalised mol_raw, morph_raw, expr_raw."""
    base = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("G"), (F.col("vec_id") % 100).cast("string")).alias("group_id"),
        F.when(F.col("vec_id") % 5 != 0, F.concat(F.lit("L"), F.col("label").cast("string"))).alias("label"),
        F.transform(F.slice("embedding", 1, WIDTH), lambda x: x.cast("double")).alias("mol_raw"),
        F.transform(F.slice("embedding", WIDTH + 1, WIDTH), lambda x: x.cast("double")).alias("expr_raw"),
    )
    morph = F.transform(
        F.sequence(F.lit(1), F.lit(WIDTH)),
        lambda i: F.lit(0.5) * F.element_at("mol_raw", i)
        + F.lit(0.6) * F.element_at("expr_raw", i)
        + F.element_at("mol_raw", F.lit(WIDTH + 1) - i),
    )
    return base.withColumn("morph_raw", morph)


def embeddings(spark: SparkSession, sf_dir: str, keep_raw: bool = False) -> DataFrame:
    df = raw_embeddings(spark, sf_dir).withColumns({m: unit(F.col(f"{m}_raw")) for m in MODS})
    return df if keep_raw else df.drop(*[f"{m}_raw" for m in MODS])


def _norm(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"


EMB_SQL = f"""
emb_base AS (
  SELECT vec_id AS row_id, 'G' || CAST(vec_id % 100 AS VARCHAR) AS group_id,
         CASE WHEN vec_id % 5 <> 0 THEN 'L' || CAST(label AS VARCHAR) END AS label,
         list_transform(embedding[1:{WIDTH}], lambda x: x::DOUBLE) AS mol_raw,
         list_transform(embedding[{WIDTH + 1}:{2 * WIDTH}], lambda x: x::DOUBLE) AS expr_raw
  FROM embeddings),
emb_raw AS (
  SELECT *, list_transform(range(1, {WIDTH + 1}), lambda i:
           0.5::DOUBLE * mol_raw[i] + 0.6::DOUBLE * expr_raw[i] + mol_raw[{WIDTH + 1} - i]) AS morph_raw
  FROM emb_base),
emb AS (
  SELECT row_id, group_id, label, mol_raw, morph_raw, expr_raw,
         {_norm('mol_raw')} AS mol, {_norm('morph_raw')} AS morph, {_norm('expr_raw')} AS expr
  FROM emb_raw)"""


def _mean_dims(m: str) -> str:
    return f"""
gm_{m}_d AS (
  SELECT group_id, d, avg({m}[d]) AS x FROM emb, range(1, {WIDTH + 1}) t(d) GROUP BY group_id, d),
gm_{m}_r AS (SELECT group_id, list(x ORDER BY d) AS v FROM gm_{m}_d GROUP BY group_id),
gm_{m} AS (SELECT group_id, {_norm('v')} AS {m} FROM gm_{m}_r)"""


# Group mean vectors, renormalised: table grp(group_id, mol, morph, expr).
GROUP_SQL = (
    ",".join(_mean_dims(m) for m in MODS)
    + """,
grp AS (SELECT * FROM gm_mol JOIN gm_morph USING (group_id) JOIN gm_expr USING (group_id))"""
)

# First non-null label per group: table grp_label(group_id, label).
GROUP_LABEL_SQL = """
grp_label AS (
  SELECT group_id, arg_min(label, row_id) FILTER (WHERE label IS NOT NULL) AS label
  FROM emb GROUP BY group_id)"""


def ranks_sql(source: str, key: str, name: str = "ranks", directions=DIRECTIONS) -> str:
    parts = [
        f"""SELECT q.{key} AS id, '{a}->{b}' AS direction,
        count(*) FILTER (list_dot_product(q.{a}, c.{b}) >= list_dot_product(q.{a}, q.{b}) - 1e-12) AS rank
        FROM {source} q CROSS JOIN {source} c GROUP BY q.{key}"""
        for a, b in directions
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def metrics_sql(ranks: str, scope: str, name: str) -> str:
    """(scope, direction, metric, value) rows as a CTE."""
    rows = [
        f"SELECT direction, 'R@{k}' AS metric, avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS value FROM {ranks} GROUP BY direction"
        for k in (1, 5, 10)
    ]
    rows.append(f"SELECT direction, 'MRR', avg(1.0::DOUBLE / rank) FROM {ranks} GROUP BY direction")
    if scope == "compound":
        rows.append(f"SELECT direction, 'n_compounds', count(*)::DOUBLE FROM {ranks} GROUP BY direction")
    rows.append(
        f"SELECT NULL, 'mean_R@10', avg(v) FROM (SELECT avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM {ranks} GROUP BY direction)"
    )
    if scope == "compound":
        rows.append(
            f"SELECT NULL, 'random_R@10', least(10.0::DOUBLE / greatest(count(DISTINCT id), 1), 1.0::DOUBLE) FROM {ranks}"
        )
    return f"{name} AS (SELECT '{scope}' AS scope, direction, metric, value FROM ({' UNION ALL '.join(rows)}))"


def uniform_sql(source: str, key: str, name: str = "uni") -> str:
    parts = [
        f"""SELECT '{m}' AS modality, ln(avg(exp(-2.0::DOUBLE * list_sum(list_transform(list_zip(q.{m}, c.{m}), lambda p: (p[1]-p[2])*(p[1]-p[2])))))) AS uniformity
        FROM {source} q JOIN {source} c ON q.{key} <> c.{key}"""
        for m in MODS
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def align_sql(source: str, name: str = "ali") -> str:
    parts = [
        f"""SELECT '{a}_{b}' AS pair, avg(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]-p[2])*(p[1]-p[2])))) AS alignment FROM {source}"""
        for a, b in PAIRS
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def hash_sql(*parts: str, second: bool = False) -> str:
    """The portable hash over SQL expressions (string literals already quoted)."""
    start = 9 if second else 1
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', {joined})), {start}, 8) AS BIGINT)"
