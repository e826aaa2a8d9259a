"""Queries on embedding tables: similarity, retrieval, neighbours, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from triskel.catalog.base import query
from triskel.catalog.embedding_data import (
    EMB_SQL,
    GROUP_LABEL_SQL,
    GROUP_SQL,
    MODS,
    PAIRS,
    WIDTH,
    align_sql,
    embeddings,
    metrics_sql,
    ranks_sql,
    raw_embeddings,
    uniform_sql,
)
from triskel.functions.numeric import rounded
from triskel.functions.text import parse_metric_key
from triskel.functions.vectors import cosine, dot, squared_distance
from triskel.operators import clustering, embeddings as emb_ops, kmeans, neighbours, reports, retrieval
from triskel.operators.filters import labelled
from triskel.operators.ordering import encode_labels
from triskel.plans.evaluate import evaluation_metrics
from triskel.session import materialise


def _round_metrics(df):
    return df.withColumn("value", rounded(F.col("value")))


def _dims(df, keys, modalities):
    """(keys, modality, dim, value) rows of vector columns."""
    long = df.unpivot(keys, modalities, "modality", "vec")
    return long.select(*keys, "modality", F.posexplode("vec").alias("dim", "value")).select(
        *keys, "modality", F.col("dim").cast("bigint").alias("dim"), rounded(F.col("value")).alias("value")
    )


def _dims_sql(source: str, keys: str, modalities) -> str:
    return " UNION ALL ".join(
        f"""SELECT {keys}, '{m}' AS modality, d - 1 AS dim, round({m}[d], 6) + 0.0 AS value
        FROM {source}, range(1, {WIDTH + 1}) t(d)"""
        for m in modalities
    )


@query(
    "retrieval_mol_morph",
    f"""WITH {EMB_SQL}, {ranks_sql('emb', 'row_id', directions=[('mol', 'morph')])},
    {metrics_sql('ranks', 'row', 'met')}
    SELECT direction, metric, round(value, 6) + 0.0 AS value FROM met WHERE direction IS NOT NULL""",
)
def retrieval_mol_morph(spark, sf_dir):
    stats = retrieval.row_statistics(embeddings(spark, sf_dir), "row_id", ["mol", "morph"], uniform=False)
    metrics = retrieval.retrieval_metrics(stats, ["mol", "morph"])
    return _round_metrics(metrics.where("direction = 'mol->morph'")).drop("scope")


@query(
    "pair_ranks",
    f"WITH {EMB_SQL}, {ranks_sql('emb', 'row_id')} SELECT id AS row_id, direction, rank FROM ranks",
)
def pair_ranks(spark, sf_dir):
    stats = retrieval.row_statistics(embeddings(spark, sf_dir), "row_id", MODS, uniform=False)
    return retrieval.ranks_long(stats, "row_id", MODS)


@query(
    "row_retrieval_all",
    f"""WITH {EMB_SQL}, {ranks_sql('emb', 'row_id')}, {metrics_sql('ranks', 'row', 'met')}
    SELECT scope, direction, metric, round(value, 6) + 0.0 AS value FROM met""",
)
def row_retrieval_all(spark, sf_dir):
    stats = retrieval.row_statistics(embeddings(spark, sf_dir), "row_id", MODS, uniform=False)
    return _round_metrics(retrieval.retrieval_metrics(stats, MODS))


@query(
    "compound_retrieval_all",
    f"""WITH {EMB_SQL}, {GROUP_SQL}, {ranks_sql('grp', 'group_id')}, {metrics_sql('ranks', 'compound', 'met')}
    SELECT scope, direction, metric, round(value, 6) + 0.0 AS value FROM met""",
)
def compound_retrieval_all(spark, sf_dir):
    groups = emb_ops.group_vectors(embeddings(spark, sf_dir), "group_id", MODS)
    stats = retrieval.row_statistics(groups, "group_id", MODS, uniform=False)
    return _round_metrics(retrieval.retrieval_metrics(stats, MODS, scope="compound"))


@query(
    "group_mean_vectors",
    f"WITH {EMB_SQL}, {GROUP_SQL} {_dims_sql('grp', 'group_id', MODS)}",
)
def group_mean_vectors(spark, sf_dir):
    return _dims(emb_ops.group_vectors(embeddings(spark, sf_dir), "group_id", MODS), ["group_id"], MODS)


@query("unit_vectors", f"WITH {EMB_SQL} {_dims_sql('emb', 'row_id', MODS)}")
def unit_vectors(spark, sf_dir):
    return _dims(embeddings(spark, sf_dir), ["row_id"], MODS)


@query(
    "vector_products",
    f"""WITH {EMB_SQL}
    SELECT row_id, round(list_dot_product(mol_raw, morph_raw), 6) + 0.0 AS dot,
           round(list_dot_product(mol, morph), 6) + 0.0 AS cosine,
           round(list_sum(list_transform(list_zip(mol, morph), lambda p: (p[1]-p[2])*(p[1]-p[2]))), 6) + 0.0 AS d2
    FROM emb""",
)
def vector_products(spark, sf_dir):
    df = embeddings(spark, sf_dir, keep_raw=True)
    return df.select(
        "row_id",
        rounded(dot(F.col("mol_raw"), F.col("morph_raw"))).alias("dot"),
        rounded(cosine(F.col("mol_raw"), F.col("morph_raw"))).alias("cosine"),
        rounded(squared_distance(F.col("mol"), F.col("morph"))).alias("d2"),
    )


@query(
    "positive_pair_join",
    f"""WITH {EMB_SQL}
    SELECT row_id, round(list_sum(list_transform(list_zip(mol, expr), lambda p: (p[1]-p[2])*(p[1]-p[2]))), 6) + 0.0 AS d2
    FROM emb""",
)
def positive_pair_join(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    left = df.select("row_id", F.col("mol").alias("vec"))
    right = df.select("row_id", F.col("expr").alias("vec"))
    return retrieval.positive_pairs(left, right, "row_id").withColumn("d2", rounded(F.col("d2")))


@query(
    "alignment_pairs",
    f"WITH {EMB_SQL}, {align_sql('emb')} SELECT pair, round(alignment, 6) + 0.0 AS alignment FROM ali",
)
def alignment_pairs(spark, sf_dir):
    return retrieval.alignment(embeddings(spark, sf_dir), MODS).withColumn(
        "alignment", rounded(F.col("alignment"))
    )


@query(
    "uniformity_modalities",
    f"WITH {EMB_SQL}, {uniform_sql('emb', 'row_id')} SELECT modality, round(uniformity, 6) + 0.0 AS uniformity FROM uni",
)
def uniformity_modalities(spark, sf_dir):
    return retrieval.uniformity(embeddings(spark, sf_dir), "row_id", MODS).withColumn(
        "uniformity", rounded(F.col("uniformity"))
    )


@query(
    "labelled_codes",
    f"""WITH {EMB_SQL}
    SELECT row_id, label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM emb WHERE label IS NOT NULL""",
)
def labelled_codes(spark, sf_dir):
    rows = labelled(embeddings(spark, sf_dir), "label")
    return encode_labels(rows, "label").select("row_id", "label", "code")


def _neighbours_sql(source: str, key: str, k: int, where: str = "TRUE") -> str:
    return f"""
    pts AS (SELECT * FROM {source} WHERE {where}),
    sims AS (SELECT q.{key} AS id, c.{key} AS neighbour, round(list_dot_product(q.mol, c.mol), 12) AS sim
             FROM pts q JOIN pts c ON q.{key} <> c.{key}),
    nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS position
           FROM sims) WHERE position <= {k})"""


@query(
    "top_neighbours",
    f"""WITH {EMB_SQL}, {_neighbours_sql('emb', 'row_id', 10)}
    SELECT id AS row_id, neighbour, position, round(sim, 6) + 0.0 AS sim FROM nn""",
)
def top_neighbours(spark, sf_dir):
    points = embeddings(spark, sf_dir).select("row_id", F.col("mol").alias("vec"))
    nearest = neighbours.top_neighbours(points, "row_id", 10)
    return nearest.select(
        "row_id", "neighbour", F.col("position").cast("bigint").alias("position"), rounded(F.col("sim")).alias("sim")
    )


_VOTE_SQL = """
    ks AS (SELECT unnest([5, 10, 20]) AS k),
    votes AS (SELECT nn.id, k, p.label, count(*) AS n, min(position) AS f
              FROM nn JOIN pts p ON p.{key} = nn.neighbour JOIN ks ON nn.position <= k GROUP BY nn.id, k, p.label),
    won AS (SELECT id, k, label FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY n DESC, f) AS r FROM votes) WHERE r = 1),
    acc AS (SELECT k, count(*) FILTER (won.label = p.label) / (SELECT count(*) FROM pts)::DOUBLE AS accuracy
            FROM won JOIN pts p ON p.{key} = won.id GROUP BY k)"""


@query(
    "knn_accuracy_rows",
    f"""WITH {EMB_SQL}, {_neighbours_sql('emb', 'row_id', 20, 'label IS NOT NULL')}, {_VOTE_SQL.format(key='row_id')}
    SELECT k, round(accuracy, 6) + 0.0 AS accuracy FROM acc""",
)
def knn_accuracy_rows(spark, sf_dir):
    points = labelled(embeddings(spark, sf_dir), "label").select("row_id", "label", F.col("mol").alias("vec"))
    return neighbours.knn_accuracy(points, "row_id", "label").withColumn("accuracy", rounded(F.col("accuracy")))


@query(
    "clustering_input",
    f"""WITH {EMB_SQL}, {GROUP_SQL}, {GROUP_LABEL_SQL}
    SELECT group_id, label, d - 1 AS dim, round(mol[d], 6) + 0.0 AS value
    FROM grp JOIN grp_label USING (group_id), range(1, {WIDTH + 1}) t(d)""",
)
def clustering_input(spark, sf_dir):
    groups = emb_ops.clustering_input(embeddings(spark, sf_dir), "group_id", "label", "row_id", MODS)
    return groups.select("group_id", "label", F.posexplode("vec").alias("dim", "value")).select(
        "group_id", "label", F.col("dim").cast("bigint").alias("dim"), rounded(F.col("value")).alias("value")
    )


@query(
    "knn_accuracy_groups",
    f"""WITH {EMB_SQL}, {GROUP_SQL}, {GROUP_LABEL_SQL},
    gl AS (SELECT * FROM grp JOIN grp_label USING (group_id)),
    {_neighbours_sql('gl', 'group_id', 20, 'label IS NOT NULL')}, {_VOTE_SQL.format(key='group_id')}
    SELECT k, round(accuracy, 6) + 0.0 AS accuracy FROM acc""",
)
def knn_accuracy_groups(spark, sf_dir):
    groups = emb_ops.clustering_input(embeddings(spark, sf_dir), "group_id", "label", "row_id", MODS)
    return neighbours.knn_accuracy(labelled(groups, "label"), "group_id", "label").withColumn(
        "accuracy", rounded(F.col("accuracy"))
    )


# Starting centroids: the mean vector of every label, so each label has one.
_CENTRE_SQL = f"""
    lab AS (SELECT row_id, label, mol FROM emb WHERE label IS NOT NULL),
    cd AS (SELECT label, d, avg(mol[d]) AS x FROM lab, range(1, {WIDTH + 1}) t(d) GROUP BY label, d),
    centres AS (SELECT label AS cluster, list(x ORDER BY d) AS v FROM cd GROUP BY label),
    dist AS (SELECT l.row_id, c.cluster, round(list_sum(list_transform(list_zip(l.mol, c.v), lambda p: (p[1]-p[2])*(p[1]-p[2]))), 12) AS d2
             FROM lab l CROSS JOIN centres c),
    assigned AS (SELECT row_id, cluster, d2 FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2, cluster) AS r FROM dist) WHERE r = 1)"""


def _points_and_centres(spark, sf_dir):
    points = labelled(embeddings(spark, sf_dir), "label").select("row_id", "label", F.col("mol").alias("vec"))
    centres = points.groupBy(F.col("label").alias("cluster")).agg(emb_ops.mean_vector("vec"))
    return points, centres


@query(
    "nearest_centroid",
    f"WITH {EMB_SQL}, {_CENTRE_SQL} SELECT row_id, cluster, round(d2, 6) + 0.0 AS d2 FROM assigned",
)
def nearest_centroid(spark, sf_dir):
    points, centres = _points_and_centres(spark, sf_dir)
    return neighbours.assign_nearest(points, centres, "row_id").withColumn("d2", rounded(F.col("d2")))


@query(
    "lloyd_step",
    f"""WITH {EMB_SQL}, {_CENTRE_SQL}
    SELECT cluster, d - 1 AS dim, round(avg(mol[d]), 6) + 0.0 AS value
    FROM assigned JOIN lab USING (row_id), range(1, {WIDTH + 1}) t(d) GROUP BY cluster, d""",
)
def lloyd_step(spark, sf_dir):
    points, centres = _points_and_centres(spark, sf_dir)
    moved = neighbours.lloyd_step(points, centres, "row_id")
    return moved.select("cluster", F.posexplode("vec").alias("dim", "value")).select(
        "cluster", F.col("dim").cast("bigint").alias("dim"), rounded(F.col("value")).alias("value")
    )


def _kmeans_sql(points: str, label: str) -> str:
    """Table ``km`` (key, cluster) of ``points`` (key, v): seeding and iterations as recursions over whole states."""
    d2 = "pow(list_distance(v, m), 2)"
    return f"""
    kpts AS ({points}),
    kk AS (SELECT greatest(count(DISTINCT {label}), 2) AS k FROM gl),
    seeds(r, c, centres) AS (
      SELECT r, 0, []::DOUBLE[][] FROM range({kmeans.RESTARTS}) t(r)
      UNION ALL
      SELECT r, c + 1, list_append(centres, v) FROM (
        SELECT *, row_number() OVER (PARTITION BY r ORDER BY CASE WHEN d2 > 0 THEN -ln(u) / d2 ELSE 'inf'::DOUBLE END, key) AS n FROM (
          SELECT *, CASE WHEN c = 0 THEN 1.0 ELSE list_min(list_transform(centres, lambda m: {d2})) END AS d2,
            (CAST('0x' || substr(md5(concat_ws('|', 42, r, c, key)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS u
          FROM seeds, kpts, kk WHERE c < k)) WHERE n = 1),
    lloyd(r, it, centres, assigned, cost, done) AS (
      SELECT r, 0, centres, []::BIGINT[], 0.0::DOUBLE, false FROM seeds, kk WHERE c = k
      UNION ALL
      SELECT r, it + 1, list_transform(range(1, len(centres) + 1), lambda c: list_transform([list_filter(items, lambda i: i.slot = c)], lambda own:
            CASE WHEN len(own) = 0 THEN centres[c]
            ELSE list_transform(range(1, len(centres[c]) + 1), lambda j: list_avg(list_transform(own, lambda i: i.v[j]))) END)[1]),
          list_transform(items, lambda i: i.slot), list_sum(list_transform(items, lambda i: i.d2)),
          list_transform(items, lambda i: i.slot) = assigned
      FROM (SELECT r, it, any_value(centres) AS centres, any_value(assigned) AS assigned,
            list({{'slot': list_position(ds, list_min(ds))::BIGINT, 'd2': list_min(ds), 'v': v}} ORDER BY key) AS items
        FROM (SELECT *, list_transform(centres, lambda m: {d2}) AS ds FROM lloyd, kpts WHERE NOT done AND it < {kmeans.MAX_ITERATIONS})
        GROUP BY r, it)),
    ended AS (SELECT *, min(cost) OVER () AS least FROM lloyd WHERE done),
    kbest AS (SELECT assigned FROM ended WHERE cost <= least * (1 + {kmeans.SAME_COST}) ORDER BY r LIMIT 1),
    kat AS (SELECT key, assigned[row_number() OVER (ORDER BY key)] AS slot FROM kpts, kbest),
    km AS (SELECT key, dense_rank() OVER (ORDER BY least) - 1 AS cluster FROM (SELECT *, min(key) OVER (PARTITION BY slot) AS least FROM kat))"""


_GROUP_POINTS_SQL = "SELECT group_id AS key, mol AS v FROM gl WHERE label IS NOT NULL"


@query(
    "kmeans_assignment",
    f"""WITH RECURSIVE {EMB_SQL}, {GROUP_SQL}, {GROUP_LABEL_SQL},
    gl AS MATERIALIZED (SELECT * FROM grp JOIN grp_label USING (group_id)), {_kmeans_sql(_GROUP_POINTS_SQL, 'label')}
    SELECT key AS group_id, cluster FROM km""",
)
def kmeans_assignment(spark, sf_dir):
    groups = labelled(
        emb_ops.clustering_input(embeddings(spark, sf_dir), "group_id", "label", "row_id", MODS), "label"
    )
    classes = groups.agg(F.count_distinct("label")).first()[0]
    return kmeans.kmeans_assign(groups, "group_id", max(classes, 2), restarts=10)


def _cells(spark, sf_dir):
    points, centres = _points_and_centres(spark, sf_dir)
    assigned = neighbours.assign_nearest(points, centres, "row_id")
    return materialise(clustering.contingency(points.join(assigned, "row_id"), "label", "cluster"))


_CELLS_SQL = f"""{EMB_SQL}, {_CENTRE_SQL},
    cells AS (SELECT label AS a, cluster AS b, count(*) AS n FROM assigned JOIN lab USING (row_id) GROUP BY 1, 2)"""

_ARI_SQL = """
    ma AS (SELECT a, sum(n)::DOUBLE AS s FROM cells GROUP BY a),
    mb AS (SELECT b, sum(n)::DOUBLE AS s FROM cells GROUP BY b),
    tot AS (SELECT sum(n)::DOUBLE AS t FROM cells),
    ari AS (SELECT (S - A * B / (t*(t-1)/2)) / ((A + B) / 2 - A * B / (t*(t-1)/2)) AS ari
            FROM (SELECT sum(n::DOUBLE*(n-1)/2) AS S FROM cells), (SELECT sum(s*(s-1)/2) AS A FROM ma),
                 (SELECT sum(s*(s-1)/2) AS B FROM mb), tot)"""

_AMI_SQL = """
    ent AS (SELECT (SELECT -sum(s/t*ln(s/t)) FROM ma, tot) AS ha, (SELECT -sum(s/t*ln(s/t)) FROM mb, tot) AS hb),
    mi AS (SELECT sum(n/t*ln(n*t/(ma.s*mb.s))) AS mi FROM cells JOIN ma USING (a) JOIN mb USING (b), tot),
    emi AS (
      SELECT sum(k/t*ln(k*t/(sa*sb)) * exp(lgamma(sa+1)+lgamma(sb+1)+lgamma(t-sa+1)+lgamma(t-sb+1)
             -lgamma(t+1)-lgamma(k+1)-lgamma(sa-k+1)-lgamma(sb-k+1)-lgamma(t-sa-sb+k+1))) AS emi
      FROM (SELECT ma.s AS sa, mb.s AS sb, t,
                   unnest(range(greatest(1, ma.s+mb.s-t)::BIGINT, least(ma.s, mb.s)::BIGINT + 1))::DOUBLE AS k
            FROM ma, mb, tot)),
    ami AS (SELECT (mi - emi) / ((ha + hb) / 2 - emi) AS ami FROM mi, emi, ent)"""


@query("contingency", f"WITH {_CELLS_SQL} SELECT a AS label, b AS cluster, n FROM cells")
def contingency(spark, sf_dir):
    return _cells(spark, sf_dir)


@query("adjusted_rand", f"WITH {_CELLS_SQL}, {_ARI_SQL} SELECT round(ari, 6) + 0.0 AS ari FROM ari")
def adjusted_rand(spark, sf_dir):
    return clustering.adjusted_rand(_cells(spark, sf_dir), "label", "cluster").select(
        rounded(F.col("ari")).alias("ari")
    )


@query(
    "adjusted_mutual_information",
    f"WITH {_CELLS_SQL}, {_ARI_SQL}, {_AMI_SQL} SELECT round(ami, 6) + 0.0 AS ami FROM ami",
)
def adjusted_mutual_information(spark, sf_dir):
    return clustering.adjusted_mutual_information(_cells(spark, sf_dir), "label", "cluster").select(
        rounded(F.col("ami")).alias("ami")
    )


_ORDER_CELLS_SQL = "cells AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2)"


@query(
    "agreement_of_order_labels",
    f"""WITH {_ORDER_CELLS_SQL}, {_ARI_SQL}, {_AMI_SQL},
    both_ AS (SELECT ari, ami, emi FROM ari, ami, emi)
    SELECT round(ari, 8) + 0.0 AS ari, round(ami, 8) + 0.0 AS ami, round(emi, 8) + 0.0 AS emi FROM both_""",
)
def agreement_of_order_labels(spark, sf_dir):
    from triskel.catalog.base import table

    cells = clustering.contingency(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
    ari = clustering.adjusted_rand(cells, "o_orderstatus", "o_orderpriority")
    ami = clustering.adjusted_mutual_information(cells, "o_orderstatus", "o_orderpriority")
    emi = clustering.expected_information(cells, "o_orderstatus", "o_orderpriority")
    return ari.withColumns({"ami": ami.scalar(), "emi": emi.scalar()}).select(
        *[rounded(F.col(c), 8).alias(c) for c in ("ari", "ami", "emi")]
    )


_FULL_SQL = f"""{EMB_SQL}, {GROUP_SQL}, {GROUP_LABEL_SQL},
    {ranks_sql('emb', 'row_id', 'rr')}, {metrics_sql('rr', 'row', 'mr')},
    {ranks_sql('grp', 'group_id', 'cr')}, {metrics_sql('cr', 'compound', 'mc')},
    {align_sql('emb')}, {uniform_sql('emb', 'row_id')},
    gl AS (SELECT * FROM grp JOIN grp_label USING (group_id)),
    {_neighbours_sql('gl', 'group_id', 20, 'label IS NOT NULL')}, {_VOTE_SQL.format(key='group_id')},
    met AS (SELECT * FROM mr UNION ALL SELECT * FROM mc
      UNION ALL SELECT 'row', NULL, 'align_' || pair, alignment FROM ali
      UNION ALL SELECT 'row', NULL, 'uniform_' || modality, uniformity FROM uni
      UNION ALL SELECT 'moa', NULL, 'kNN_' || CAST(k AS VARCHAR) || '_acc', accuracy FROM acc)"""


@query(
    "full_metrics",
    f"WITH {_FULL_SQL} SELECT scope, direction, metric, round(value, 6) + 0.0 AS value FROM met",
)
def full_metrics(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return _round_metrics(evaluation_metrics(df, "row_id", "group_id", "label", "row_id", MODS, kmeans=False))


@query(
    "full_metrics_with_kmeans",
    f"""WITH RECURSIVE {_FULL_SQL.replace('gl AS (', 'gl AS MATERIALIZED (', 1)}, {_kmeans_sql(_GROUP_POINTS_SQL, 'label')},
    cells AS (SELECT label AS a, cluster AS b, count(*) AS n FROM gl JOIN km ON group_id = key GROUP BY 1, 2), {_ARI_SQL}, {_AMI_SQL}
    SELECT scope, direction, metric, round(value, 6) + 0.0 AS value FROM (
        SELECT * FROM met UNION ALL SELECT 'moa', NULL, 'AMI', ami FROM ami UNION ALL SELECT 'moa', NULL, 'ARI', ari FROM ari)""",
)
def full_metrics_with_kmeans(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return _round_metrics(evaluation_metrics(df, "row_id", "group_id", "label", "row_id", MODS, kmeans=True))


@query(
    "retrieval_table",
    f"WITH {_FULL_SQL} SELECT direction, "
    + ", ".join(
        f"""max(round(value, 6) + 0.0) FILTER (scope = '{s}' AND metric = '{m}') AS "{s}_{m}" """
        for s in ("row", "compound")
        for m in reports.TABLE_METRICS
    )
    + " FROM met WHERE direction IS NOT NULL GROUP BY direction",
)
def retrieval_table(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    row = retrieval.row_statistics(df, "row_id", MODS, uniform=False)
    groups = emb_ops.group_vectors(df, "group_id", MODS)
    compound = retrieval.row_statistics(groups, "group_id", MODS, uniform=False)
    metrics = retrieval.retrieval_metrics(row, MODS).unionByName(
        retrieval.retrieval_metrics(compound, MODS, scope="compound")
    )
    return reports.retrieval_table(_round_metrics(metrics))


@query(
    "metric_listing",
    f"""WITH {_FULL_SQL} SELECT section, name, value FROM (
    SELECT CASE WHEN scope = 'moa' THEN '4 clustering'
                WHEN metric LIKE 'align!_%' ESCAPE '!' OR metric LIKE 'uniform!_%' ESCAPE '!' THEN '3 diagnostics'
                WHEN metric IN ('R@10', 'mean_R@10') THEN CASE WHEN scope = 'compound' THEN '2 compound R@10' ELSE '1 row R@10' END END AS section,
           CASE WHEN metric = 'mean_R@10' THEN 'mean' ELSE coalesce(direction, metric) END AS name,
           round(value, 6) + 0.0 AS value FROM met) WHERE section IS NOT NULL""",
)
def metric_listing(spark, sf_dir):
    return reports.metric_listing(full_metrics(spark, sf_dir))


@query(
    "metric_keys",
    f"""WITH {EMB_SQL}, {GROUP_SQL}, {ranks_sql('grp', 'group_id')}, {metrics_sql('ranks', 'compound', 'met')}
    SELECT 'compound/' || direction || '/' || metric AS key, 'compound' AS scope, direction,
           split_part(direction, '->', 1) AS source, split_part(direction, '->', 2) AS target, metric,
           round(value, 6) + 0.0 AS value FROM met WHERE direction IS NOT NULL""",
)
def metric_keys(spark, sf_dir):
    metrics = compound_retrieval_all(spark, sf_dir).where("direction IS NOT NULL")
    flat = reports.flat_metrics(metrics)
    return flat.withColumns(parse_metric_key(F.col("key")))


@query(
    "similarity_histogram",
    f"""WITH {EMB_SQL}, s AS ("""
    + " UNION ALL ".join(
        f"SELECT '{a}_{b}' AS pair, round(list_dot_product(q.{a}, c.{b}), 12) AS sim FROM emb q CROSS JOIN emb c" for a, b in PAIRS
    )
    + """) SELECT pair, CAST(least(greatest(floor((sim + 1.0::DOUBLE) * 10), 0), 19) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY 1, 2""",
)
def similarity_histogram(spark, sf_dir):
    """The whole similarity matrix of each pair of modalities, binned."""
    return reports.similarity_histogram(embeddings(spark, sf_dir), "row_id", MODS)


# Every seventh mol vector is missing, every eleventh has a missing component.
_GAPS_SQL = f"""{EMB_SQL}, gp AS (SELECT CAST(row_id AS INTEGER) AS row_id,
    CASE WHEN row_id % 7 = 3 OR row_id % 11 = 5 THEN NULL ELSE mol END AS mol FROM emb)"""


@query(
    "top_neighbours_with_gaps",
    f"""WITH {_GAPS_SQL}, s AS (SELECT q.row_id, c.row_id AS neighbour, round(list_dot_product(q.mol, c.mol), 12) AS sim
      FROM gp q JOIN gp c ON q.row_id <> c.row_id WHERE q.mol IS NOT NULL AND c.mol IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, neighbour) AS position FROM s)
    SELECT row_id, neighbour, position, round(sim, 6) + 0.0 AS sim FROM r WHERE position <= 5""",
)
def top_neighbours_with_gaps(spark, sf_dir):
    """Missing vectors and components, and a key of 32 bits."""
    row = F.col("row_id")
    holed = F.transform("mol", lambda x, i: F.when(i > 0, x))
    mol = F.when(row % 7 == 3, F.lit(None)).when(row % 11 == 5, holed).otherwise(F.col("mol"))
    df = embeddings(spark, sf_dir).select(row.cast("int").alias("row_id"), mol.alias("vec"))
    out = neighbours.top_neighbours(df, "row_id", 5)
    return out.select("row_id", "neighbour", F.col("position").cast("bigint").alias("position"), rounded(F.col("sim")).alias("sim"))


@query(
    "embedding_table_build",
    f"WITH {EMB_SQL} "
    + " UNION ALL ".join(
        f"SELECT row_id, group_id, '{m}' AS modality, len({m}) AS width, round(list_sum({m}), 6) + 0.0 AS total FROM emb"
        for m in MODS
    ),
)
def embedding_table_build(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    parts = {m: df.select("row_id", "group_id", F.col(m).alias("vec")) for m in MODS}
    long = emb_ops.build_long(parts, "row_id", ["group_id"])
    wide = emb_ops.from_long(long, "row_id", MODS, carry=["group_id"])
    back = emb_ops.to_long(wide, "row_id", MODS, carry=["group_id"])
    return back.select(
        "row_id",
        "group_id",
        "modality",
        F.size("vec").cast("bigint").alias("width"),
        rounded(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("total"),
    )


@query(
    "group_labels",
    f"WITH {EMB_SQL}, {GROUP_LABEL_SQL} SELECT group_id, label FROM grp_label",
)
def group_labels(spark, sf_dir):
    return emb_ops.group_labels(raw_embeddings(spark, sf_dir), "group_id", "label", "row_id")


