"""Queries of batching, losses, augmentation, baselines and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from triskel.catalog.base import query, table
from triskel.catalog.embedding_data import (
    EMB_SQL,
    MODS,
    PAIRS,
    WIDTH,
    embeddings,
    hash_sql,
    metrics_sql,
    ranks_sql,
)
from triskel.catalog.source_data import META_SQL, meta
from triskel.functions.hashing import py_hash32
from triskel.functions.numeric import rounded
from triskel.operators import augment, encode, joins, losses, ordering, retrieval
from triskel.operators.filters import featurized_only

BATCH = 64
TAU = 7.38905609893065  # exp(2)


@query(
    "fixed_batches",
    f"""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events)
    SELECT event_id, i // 96 AS batch FROM p WHERE i < (n // 96) * 96""",
)
def fixed_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    return ordering.batches(rows, "event_id", 96, drop_last=True)


@query(
    "seeded_shuffle",
    f"SELECT event_id, row_number() OVER (ORDER BY {hash_sql('7', 'event_id')}, event_id) - 1 AS position FROM events",
)
def seeded_shuffle(spark, sf_dir):
    return ordering.seeded_shuffle(table(spark, sf_dir, "events").select("event_id"), "event_id", 7)


def _loss_sql(weights: dict[str, float]) -> str:
    pair = ", ".join(
        f"""l_{a}_{b} AS (SELECT batch, avg(greatest(-x, 0) + ln(1 + exp(-abs(x)))) AS loss FROM (
          SELECT q.batch, CASE WHEN q.group_id = c.group_id THEN 1 ELSE -1 END * ({TAU}::DOUBLE * list_dot_product(q.{a}, c.{b}) + 0.25::DOUBLE) AS x
          FROM b q JOIN b c ON q.batch = c.batch) GROUP BY batch)"""
        for a, b in PAIRS
    )
    pen = ", ".join(
        f"""x_{m} AS (SELECT batch, row_id, d, {m}_raw[d] AS x FROM b, range(1, {WIDTH + 1}) t(d)),
        k_{m} AS (SELECT p.batch, p.d AS d, q.d AS e, covar_samp(p.x, q.x) AS c FROM x_{m} p JOIN x_{m} q ON p.batch = q.batch AND p.row_id = q.row_id GROUP BY p.batch, p.d, q.d),
        v_{m} AS (SELECT batch, 0.1::DOUBLE * (avg(greatest(1 - sqrt(c + 0.0001), 0)) FILTER (d = e) + sum(c * c) FILTER (d <> e) / {WIDTH}) AS vic FROM k_{m} GROUP BY batch)"""
        for m in MODS
    )
    total = " + ".join(
        [f"{weights.get(f'{a}_{b}', 1.0)}::DOUBLE * l_{a}_{b}.loss" for a, b in PAIRS] + [f"v_{m}.vic" for m in MODS]
    )
    cols = ", ".join(
        [f"l_{a}_{b}.loss AS loss_{a}_{b}" for a, b in PAIRS] + [f"v_{m}.vic AS vicreg_{m}" for m in MODS]
    )
    joins_ = " ".join(
        [f"JOIN l_{a}_{b} USING (batch)" for a, b in PAIRS] + [f"JOIN v_{m} USING (batch)" for m in MODS]
    )
    return f"""{EMB_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // {BATCH} AS batch FROM emb), {pair}, {pen},
    los AS (SELECT n.batch, n.n, {cols}, {total} AS loss_total FROM (SELECT batch, count(*) AS n FROM b GROUP BY batch) n {joins_})"""


_WEIGHTS = {"mol_morph": 2.0, "mol_expr": 2.0, "morph_expr": 0.5}
_COMPONENTS = [f"loss_{a}_{b}" for a, b in PAIRS] + [f"vicreg_{m}" for m in MODS] + ["loss_total"]


def _losses(spark, sf_dir):
    df = ordering.batches(embeddings(spark, sf_dir, keep_raw=True), "row_id", BATCH)
    return losses.batch_losses(
        df,
        "batch",
        MODS,
        group="group_id",
        encoder={m: f"{m}_raw" for m in MODS},
        bias=0.25,
        pair_weights=_WEIGHTS,
    )


@query(
    "batch_losses",
    f"WITH {_loss_sql(_WEIGHTS)} SELECT batch, n, "
    + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _COMPONENTS)
    + " FROM los",
)
def batch_losses(spark, sf_dir):
    return _losses(spark, sf_dir).select("batch", "n", *[rounded(F.col(c)).alias(c) for c in _COMPONENTS])


@query(
    "mean_losses",
    f"WITH {_loss_sql(_WEIGHTS)} SELECT count(*) AS batches, "
    + ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in _COMPONENTS)
    + " FROM los",
)
def mean_losses(spark, sf_dir):
    mean = losses.mean_without_nan(_losses(spark, sf_dir))
    return mean.select("batches", *[rounded(F.col(c)).alias(c) for c in _COMPONENTS])


@query(
    "nan_batches",
    f"""WITH {_loss_sql(_WEIGHTS)} SELECT count(*) AS batches, count(*) FILTER (isnan(CASE WHEN batch % 3 = 1 THEN 'nan'::DOUBLE ELSE loss_total END)) AS nan_batches
    FROM los""",
)
def nan_batches(spark, sf_dir):
    """The check of a training run, on losses of which a third is NaN."""
    broken = F.when(F.col("batch") % 3 == 1, float("nan")).otherwise(F.col("loss_total"))
    return losses.nan_batches(_losses(spark, sf_dir).withColumn("loss_total", broken))


@query(
    "pair_loss_without_groups",
    f"""WITH {EMB_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // {BATCH} AS batch FROM emb)
    SELECT batch, round(avg(greatest(-x, 0) + ln(1 + exp(-abs(x)))), 6) + 0.0 AS loss_mol_morph FROM (
      SELECT q.batch, CASE WHEN q.row_id = c.row_id THEN 1 ELSE -1 END * ({TAU}::DOUBLE * list_dot_product(q.mol, c.morph)) AS x
      FROM b q JOIN b c ON q.batch = c.batch) GROUP BY batch""",
)
def pair_loss_without_groups(spark, sf_dir):
    df = ordering.batches(embeddings(spark, sf_dir), "row_id", BATCH)
    out = losses.batch_losses(df, "batch", ["mol", "morph"])
    return out.select("batch", rounded(F.col("loss_mol_morph")).alias("loss_mol_morph"))


_H = hash_sql("11", "position", "i")
_DONOR = hash_sql("11", "position", "i", second=True)


@query(
    "marginal_corruption",
    f"""WITH {EMB_SQL}, p AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position, count(*) OVER () AS n, mol FROM emb),
    c AS (SELECT position, row_id, n, i, mol[i + 1] AS x FROM p, range(0, {WIDTH}) t(i)),
    r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY {_H}, i) AS k, {_DONOR} % n AS donor FROM c)
    SELECT r.row_id, r.i AS dim, round(CASE WHEN r.k <= 12 THEN d.mol[r.i + 1] ELSE r.x END, 6) + 0.0 AS value, r.k <= 12 AS replaced
    FROM r JOIN p d ON d.position = r.donor""",
)
def marginal_corruption(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("row_id", "mol")
    indexed = ordering.ordered_index(rows, [], ["row_id"], "position")
    n = rows.count()
    out = augment.corrupt_marginals(indexed.withColumn("vec", F.col("mol")), "position", "vec", WIDTH, n, seed=11)
    # A cell counts as replaced by rank, which the draw may leave unchanged.
    flagged = out.select(
        "row_id",
        "position",
        F.posexplode("vec").alias("dim", "value"),
    )
    ranked = indexed.select(
        "position",
        F.explode(
            F.slice(
                F.array_sort(
                    F.transform(
                        F.sequence(F.lit(0), F.lit(WIDTH - 1)),
                        lambda i: F.struct(augment.hash32(11, F.col("position"), i).alias("h"), i.alias("i")),
                    )
                ),
                1,
                12,
            )
        ).alias("s"),
    ).select("position", F.col("s.i").alias("dim"), F.lit(True).alias("replaced"))
    return flagged.join(ranked, ["position", "dim"], "left").select(
        "row_id",
        F.col("dim").cast("bigint").alias("dim"),
        rounded(F.col("value")).alias("value"),
        F.coalesce("replaced", F.lit(False)).alias("replaced"),
    )


_FP_SQL = f"""{META_SQL},
    ids AS (SELECT DISTINCT smiles AS id, split_part(smiles, ' |', 1) AS s FROM meta
            WHERE smiles IS NOT NULL AND trim(smiles) <> '' AND NOT regexp_full_match(split_part(smiles, ' |', 1), '-*[0-9]+')),
    fp AS (SELECT DISTINCT id, ({hash_sql('substr(s, p, w)')} % 2048) AS bit FROM ids, range(1, 4) a(w), range(1, (SELECT max(len(s)) + 1 FROM ids)) b(p) WHERE p <= len(s) - w + 1)"""


@query("fingerprints", f"WITH {_FP_SQL} SELECT id AS smiles, bit FROM fp")
def fingerprints(spark, sf_dir):
    table_ = encode.fingerprint_table(meta(spark, sf_dir).select("smiles"), "smiles")
    return table_.select("smiles", F.explode("bits").alias("bit")).withColumn("bit", F.col("bit").cast("bigint"))


@query(
    "featurized_rows",
    f"WITH {_FP_SQL} SELECT ordinal, smiles, (SELECT count(*) FROM fp WHERE fp.id = smiles) AS n_bits FROM meta WHERE smiles IN (SELECT id FROM fp)",
)
def featurized_rows(spark, sf_dir):
    """Computed once per distinct identifier, joined back; failures drop out."""
    rows = meta(spark, sf_dir).select("ordinal", "smiles")
    usable = featurized_only(rows, encode.fingerprint_table(rows, "smiles"), "smiles")
    out = joins.map_distinct(usable, "smiles", lambda d: encode.fingerprint_table(d, "smiles"), how="inner")
    return out.select("ordinal", "smiles", F.size("bits").cast("bigint").alias("n_bits"))


_BIT_H = hash_sql("3", "id", "bit")


@query(
    "bit_dropout",
    f"""WITH {_FP_SQL}, r AS (SELECT id, bit, row_number() OVER (PARTITION BY id ORDER BY {_BIT_H}, bit) AS k, count(*) OVER (PARTITION BY id) AS n FROM fp)
    SELECT id AS smiles, bit FROM r WHERE k > floor(n * 0.1::DOUBLE)""",
)
def bit_dropout(spark, sf_dir):
    table_ = encode.fingerprint_table(meta(spark, sf_dir).select("smiles"), "smiles")
    kept = table_.select("smiles", augment.drop_bits(F.col("bits"), F.col("smiles"), 3).alias("bits"))
    return kept.select("smiles", F.explode("bits").alias("bit")).withColumn("bit", F.col("bit").cast("bigint"))


_U1 = f"(({hash_sql('42', 'modality', 'row_id', 'i')} + 1) / 4294967296.0::DOUBLE)"
_U2 = f"({hash_sql('42', 'modality', 'row_id', 'i', second=True)} / 4294967296.0::DOUBLE)"
_RANDOM_SQL = f"""
    g AS (SELECT vec_id AS row_id, modality, i, sqrt(-2.0::DOUBLE * ln({_U1})) * cos(2.0::DOUBLE * pi() * {_U2}) AS x
          FROM embeddings, (SELECT unnest(['mol', 'morph', 'expr']) AS modality) m, range(0, 16) t(i)),
    u AS (SELECT row_id, modality, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY row_id, modality)), 1e-12) AS x FROM g),
    rnd AS (SELECT row_id, list(x ORDER BY i) FILTER (modality = 'mol') AS mol, list(x ORDER BY i) FILTER (modality = 'morph') AS morph,
              list(x ORDER BY i) FILTER (modality = 'expr') AS expr FROM u GROUP BY row_id)"""


def _random(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"))
    return rows.withColumns({m: augment.random_unit_vector(F.col("row_id"), m, 16, 42) for m in MODS})


@query(
    "random_baseline_vectors",
    f"WITH {_RANDOM_SQL} SELECT row_id, modality, i AS dim, round(x, 6) + 0.0 AS value FROM u",
)
def random_baseline_vectors(spark, sf_dir):
    long = _random(spark, sf_dir).unpivot(["row_id"], MODS, "modality", "vec")
    out = long.select("row_id", "modality", F.posexplode("vec").alias("dim", "value"))
    return out.withColumn("dim", F.col("dim").cast("bigint")).withColumn("value", rounded(F.col("value")))


@query(
    "random_baseline_metrics",
    f"""WITH {_RANDOM_SQL}, {ranks_sql('rnd', 'row_id')}, {metrics_sql('ranks', 'compound', 'met')}
    SELECT scope, direction, metric, round(value, 6) + 0.0 AS value FROM met""",
)
def random_baseline_metrics(spark, sf_dir):
    stats = retrieval.row_statistics(_random(spark, sf_dir), "row_id", MODS, uniform=False)
    return retrieval.retrieval_metrics(stats, MODS, scope="compound").withColumn("value", rounded(F.col("value")))


_OUT = 12


def _projection_sql() -> str:
    parts = [
        f"""pj_{m} AS (SELECT row_id, o, sum({m}_raw[i + 1] * CASE WHEN {hash_sql('42', repr(m), 'i', 'o')} % 2 = 0 THEN 1 ELSE -1 END) / sqrt({WIDTH}.0::DOUBLE) AS x
        FROM emb, range(0, {WIDTH}) a(i), range(0, {_OUT}) b(o) GROUP BY row_id, o),
        pv_{m} AS (SELECT row_id, list(x ORDER BY o) AS v FROM pj_{m} GROUP BY row_id),
        pn_{m} AS (SELECT row_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS {m} FROM pv_{m})"""
        for m in MODS
    ]
    return ", ".join(parts) + ", prj AS (SELECT * FROM pn_mol JOIN pn_morph USING (row_id) JOIN pn_expr USING (row_id))"


def _projected(spark, sf_dir):
    df = embeddings(spark, sf_dir, keep_raw=True).select("row_id", *[F.col(f"{m}_raw").alias(m) for m in MODS])
    for m in MODS:
        df = augment.random_projection(df, m, m, WIDTH, _OUT, seed=42)
    return df


@query(
    "random_projection",
    f"WITH {EMB_SQL}, {_projection_sql()} "
    + " UNION ALL ".join(
        f"SELECT row_id, '{m}' AS modality, d - 1 AS dim, round({m}[d], 6) + 0.0 AS value FROM prj, range(1, {_OUT + 1}) t(d)"
        for m in MODS
    ),
)
def random_projection(spark, sf_dir):
    long = _projected(spark, sf_dir).unpivot(["row_id"], MODS, "modality", "vec")
    out = long.select("row_id", "modality", F.posexplode("vec").alias("dim", "value"))
    return out.withColumn("dim", F.col("dim").cast("bigint")).withColumn("value", rounded(F.col("value")))


@query(
    "raw_feature_baselines",
    f"""WITH {EMB_SQL}, {_projection_sql()}, {ranks_sql('prj', 'row_id')}, {metrics_sql('ranks', 'compound', 'met')},
    m AS (SELECT unnest(['mol', 'morph', 'expr']) AS modality)
    SELECT modality, count(*) AS directions, round(avg(value), 6) + 0.0 AS value FROM met JOIN m
      ON split_part(direction, '->', 1) = modality OR split_part(direction, '->', 2) = modality
    WHERE metric = 'R@10' GROUP BY modality""",
)
def raw_feature_baselines(spark, sf_dir):
    """Mean R@10 over the directions that involve each modality."""
    stats = retrieval.row_statistics(_projected(spark, sf_dir), "row_id", MODS, uniform=False)
    metrics = retrieval.retrieval_metrics(stats, MODS, scope="compound")
    split = F.split("direction", "->")
    metrics = metrics.withColumns({"source": split[0], "target": split[1]})
    means = joins.involved_means(metrics)
    return means.select("modality", "directions", rounded(F.col("value")).alias("value"))


_HID, _EMB = 8, 6


def _weight(layer: str, i: int, j: int) -> float:
    return py_hash32("w", layer, i, j) / 2.0**32 - 0.5


def _encoder() -> encode.Encoder:
    """A stored encoder stand-in with hashed parameters."""

    def mat(layer, rows, cols):
        return np.array([[_weight(layer, i, j) for j in range(cols)] for i in range(rows)])

    def vec(layer, n):
        return np.array([_weight(layer, 0, j) for j in range(n)])

    first = encode.Layer(
        mat("w1", WIDTH, _HID), vec("b1", _HID), mean=vec("m1", _HID), var=vec("v1", _HID) + 1.0,
        gamma=vec("g1", _HID) + 1.0, beta=vec("t1", _HID), relu=True,
    )
    return encode.Encoder([first], [encode.Layer(mat("w2", _HID, _EMB), vec("b2", _EMB))])


def _w_sql(layer: str, i: str, j: str) -> str:
    return f"({hash_sql(repr('w'), repr(layer), i, j)} / 4294967296.0::DOUBLE - 0.5::DOUBLE)"


@query(
    "encoder_scores",
    f"""WITH {EMB_SQL},
    h0 AS (SELECT row_id, j, sum(mol_raw[i + 1] * {_w_sql('w1', 'i', 'j')}) AS x FROM emb, range(0, {WIDTH}) a(i), range(0, {_HID}) b(j) GROUP BY row_id, j),
    h1 AS (SELECT row_id, j, greatest((x + {_w_sql('b1', '0', 'j')} - {_w_sql('m1', '0', 'j')}) / sqrt({_w_sql('v1', '0', 'j')} + 1 + 1e-5::DOUBLE)
              * ({_w_sql('g1', '0', 'j')} + 1) + {_w_sql('t1', '0', 'j')}, 0) AS x FROM h0),
    z0 AS (SELECT row_id, o, sum(x * {_w_sql('w2', 'j', 'o')}) AS x FROM h1, range(0, {_EMB}) b(o) GROUP BY row_id, o),
    z1 AS (SELECT row_id, o, x + {_w_sql('b2', '0', 'o')} AS x FROM z0)
    SELECT row_id, o AS dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY row_id)), 1e-12), 6) + 0.0 AS value FROM z1""",
)
def encoder_scores(spark, sf_dir):
    df = embeddings(spark, sf_dir, keep_raw=True).select("row_id", F.col("mol_raw").alias("vec"))
    scored = encode.score(df, "vec", _encoder())
    out = scored.select("row_id", F.posexplode("vec").alias("dim", "value"))
    return out.withColumn("dim", F.col("dim").cast("bigint")).withColumn("value", rounded(F.col("value")))
