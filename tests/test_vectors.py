"""Retrieval, diagnostics, neighbours and clustering against numpy."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triskel.operators import augment, clustering, embeddings, kmeans, neighbours, reports, retrieval, tiles
from triskel.operators.filters import labelled
from triskel.plans.evaluate import clustering_metrics, evaluation_metrics

MODS = ["mol", "morph", "expr"]


def unit_rows(rng, n, d):
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def wide(spark, vectors, groups=None, labels=None):
    n = len(next(iter(vectors.values())))
    rows = [
        (i, groups[i] if groups else f"g{i}", labels[i] if labels else None, *[v[i].tolist() for v in vectors.values()])
        for i in range(n)
    ]
    cols = ", ".join(f"{m} array<double>" for m in vectors)
    return spark.createDataFrame(rows, f"row_id bigint, group_id string, label string, {cols}")


def metric_map(df):
    return {(r["direction"], r["metric"]): r["value"] for r in df.collect()}


def brute_ranks(a, b):
    sim = a @ b.T
    return (sim >= np.diag(sim)[:, None] - 1e-12).sum(axis=1)


@pytest.mark.parametrize("tiles", [1, 3, 5])
def test_ranks_match_brute_force_for_any_tiling(spark, tiles):
    rng = np.random.default_rng(0)
    v = {m: unit_rows(rng, 70, 8) for m in MODS}
    v["morph"][10] = v["morph"][3]  # exact duplicates tie across tiles
    v["morph"][41] = v["morph"][3]
    stats = retrieval.row_statistics(wide(spark, v), "row_id", MODS, tiles=tiles).orderBy("row_id").collect()
    for a, b in retrieval.directions(MODS):
        assert [r[f"ge_{a}_{b}"] for r in stats] == brute_ranks(v[a], v[b]).tolist(), (a, b)
    for m in MODS:
        d2 = ((v[m][:, None] - v[m][None]) ** 2).sum(-1)
        want = math.log(np.exp(-2 * d2[~np.eye(70, dtype=bool)]).mean())
        got = math.log(sum(r[f"pot_{m}"] for r in stats) / (70 * 69))
        assert got == pytest.approx(want, abs=1e-12)


def test_identical_modalities_retrieve_perfectly(spark):
    z = unit_rows(np.random.default_rng(1), 16, 32)
    df = wide(spark, {"mol": z, "morph": z})
    m = metric_map(retrieval.retrieval_metrics(retrieval.row_statistics(df, "row_id", ["mol", "morph"]), ["mol", "morph"]))
    assert m["mol->morph", "R@1"] == 1.0 and m["morph->mol", "MRR"] == 1.0


def test_repeated_rows_hurt_row_metrics_but_not_group_metrics(spark):
    base = unit_rows(np.random.default_rng(2), 4, 32)
    z = np.repeat(base, 3, axis=0)
    groups = [f"c{i // 3}" for i in range(12)]
    df = wide(spark, {"mol": z, "morph": z}, groups)
    mods = ["mol", "morph"]
    row = metric_map(retrieval.retrieval_metrics(retrieval.row_statistics(df, "row_id", mods), mods))
    grp = embeddings.group_vectors(df, "group_id", mods)
    compound = metric_map(
        retrieval.retrieval_metrics(retrieval.row_statistics(grp, "group_id", mods), mods, scope="compound")
    )
    assert row["mol->morph", "R@1"] < 1.0
    assert compound["mol->morph", "R@1"] == 1.0
    assert compound["mol->morph", "n_compounds"] == 4.0
    assert compound[None, "random_R@10"] == 1.0


def test_unique_groups_equal_rows(spark):
    rng = np.random.default_rng(3)
    df = wide(spark, {"mol": unit_rows(rng, 20, 16), "morph": unit_rows(rng, 20, 16)})
    mods = ["mol", "morph"]
    row = metric_map(retrieval.retrieval_metrics(retrieval.row_statistics(df, "row_id", mods), mods))
    grp = embeddings.group_vectors(df, "group_id", mods)
    compound = metric_map(retrieval.retrieval_metrics(retrieval.row_statistics(grp, "group_id", mods), mods, scope="compound"))
    for k in ("R@1", "R@5", "R@10", "MRR"):
        assert compound["mol->morph", k] == pytest.approx(row["mol->morph", k])


def test_alignment_and_uniformity_extremes(spark):
    z = unit_rows(np.random.default_rng(4), 64, 64)
    flat = np.tile(z[0], (32, 1))
    same = retrieval.alignment(wide(spark, {"mol": z, "morph": z}), ["mol", "morph"]).first()
    assert same["alignment"] == 0.0
    spread = retrieval.uniformity(wide(spark, {"mol": z}), "row_id", ["mol"]).first()["uniformity"]
    collapsed = retrieval.uniformity(wide(spark, {"mol": flat}), "row_id", ["mol"]).first()["uniformity"]
    assert spread < -2 and collapsed > -0.5


def points(spark, x, labels=None):
    rows = [(i, labels[i] if labels else None, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_id bigint, label string, vec array<double>")


def test_neighbours_match_brute_force_with_duplicates(spark):
    x = unit_rows(np.random.default_rng(5), 40, 6)
    x[7] = x[2]
    x[9] = x[2]
    got = neighbours.top_neighbours(points(spark, x), "row_id", 4, tiles=3).collect()
    sim = np.round(x @ x.T, 12)
    for i in range(40):
        want = sorted((j for j in range(40) if j != i), key=lambda j: (-sim[i, j], j))[:4]
        mine = [r["neighbour"] for r in sorted((r for r in got if r["row_id"] == i), key=lambda r: r["position"])]
        assert mine == want


def clusters(rng, k=4, n=15, d=24):
    centres = unit_rows(rng, k, d) * 5
    x = np.concatenate([c + 0.05 * rng.standard_normal((n, d)) for c in centres])
    return x, [f"m{i // n}" for i in range(k * n)]


def test_separated_clusters_score_high(spark):
    x, labels = clusters(np.random.default_rng(6))
    m = metric_map(clustering_metrics(points(spark, x, labels), "row_id", "label"))
    assert m[None, "AMI"] > 0.8 and m[None, "ARI"] > 0.8
    assert m[None, "kNN_5_acc"] == 1.0


def test_single_class_gives_nothing_and_nulls_are_ignored(spark):
    x = unit_rows(np.random.default_rng(7), 12, 4)
    assert labelled(points(spark, x, ["a"] * 11 + [None]), "label").isEmpty()
    assert clustering_metrics(points(spark, x, ["a"] * 12), "row_id", "label").isEmpty()
    some = points(spark, x, ["a", "b", None] * 4)
    assert labelled(some, "label").count() == 8


def test_k_is_capped_by_the_number_of_points(spark):
    x = unit_rows(np.random.default_rng(8), 4, 4)
    acc = neighbours.knn_accuracy(points(spark, x, ["a", "a", "b", "b"]), "row_id", "label", (5, 20))
    assert {r["k"] for r in acc.collect()} == {5, 20}
    nearest = neighbours.top_neighbours(points(spark, x), "row_id", 20)
    assert nearest.count() == 4 * 3


def test_mean_vectors_of_a_hot_group(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 5))
    groups = ["hot" if i % 3 else f"g{i}" for i in range(300)]
    df = wide(spark, {"mol": x}, groups)
    got = {r["group_id"]: np.array(r["mol"]) for r in embeddings.group_vectors(df, "group_id", ["mol"]).collect()}
    want = x[[i for i in range(300) if i % 3]].mean(axis=0)
    assert np.allclose(got["hot"], want / np.linalg.norm(want))
    assert len(got) == 101


def exact_emi(sa, sb):
    n = sum(sa)
    lf = math.lgamma
    total = 0.0
    for a in sa:
        for b in sb:
            for k in range(max(1, a + b - n), min(a, b) + 1):
                w = math.exp(
                    lf(a + 1) + lf(b + 1) + lf(n - a + 1) + lf(n - b + 1) - lf(n + 1) - lf(k + 1)
                    - lf(a - k + 1) - lf(b - k + 1) - lf(n - a - b + k + 1)
                )
                total += k / n * math.log(n * k / (a * b)) * w
    return total


def test_expected_information_with_a_hot_class(spark):
    # One class holds a third of all rows; the sum over k is far longer than the kept reach.
    sa, sb = [20000, 15000, 25000], [30000, 10000, 20000]
    cells = [(i, j, 0) for i in range(3) for j in range(3)]
    left, right = list(sa), list(sb)
    i = j = 0
    counts = dict.fromkeys([(c[0], c[1]) for c in cells], 0)
    while i < 3 and j < 3:  # any table with these margins
        m = min(left[i], right[j])
        counts[i, j] += m
        left[i] -= m
        right[j] -= m
        i, j = (i + 1, j) if left[i] == 0 else (i, j + 1)
    df = spark.createDataFrame([(a, b, n) for (a, b), n in counts.items() if n], "a int, b int, n bigint")
    got = clustering.expected_information(df, "a", "b").first()["emi"]
    assert got == pytest.approx(exact_emi(sa, sb), rel=1e-6)


def test_agreement_of_equal_and_trivial_labelings(spark):
    same = spark.createDataFrame([("x", "p", 5), ("y", "q", 7)], "a string, b string, n bigint")
    assert clustering.adjusted_rand(same, "a", "b").first()["ari"] == pytest.approx(1.0)
    assert clustering.adjusted_mutual_information(same, "a", "b").first()["ami"] == pytest.approx(1.0)
    one = spark.createDataFrame([("x", "p", 9)], "a string, b string, n bigint")
    assert clustering.adjusted_rand(one, "a", "b").first()["ari"] == 1.0
    assert clustering.adjusted_mutual_information(one, "a", "b").first()["ami"] == 1.0


def test_evaluation_has_every_metric(spark):
    rng = np.random.default_rng(10)
    n = 30
    v = {m: unit_rows(rng, n, 8) for m in MODS}
    df = wide(spark, v, [f"g{i % 10}" for i in range(n)], [f"l{i % 3}" if i % 4 else None for i in range(n)])
    m = evaluation_metrics(df, "row_id", "group_id", "label", "row_id", MODS)
    names = {(r["scope"], r["metric"]) for r in m.collect()}
    assert {("row", "mean_R@10"), ("compound", "mean_R@10"), ("moa", "AMI"), ("moa", "kNN_20_acc")} <= names
    assert {("row", f"uniform_{x}") for x in MODS} <= names
    assert m.where(F.isnan("value") | F.col("value").isNull()).isEmpty()


def test_missing_and_uneven_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.6, 0.8]), (4, [0.0, None]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "row_id int, vec array<double>")
    got = {r["row_id"]: (r["neighbour"], round(r["sim"], 9)) for r in neighbours.top_neighbours(df, "row_id", 1).collect()}
    assert got == {1: (3, 0.6), 3: (5, 0.8), 5: (3, 0.8)}
    doubled = augment.map_vectors(df.where("row_id <> 4"), "vec", lambda x: 2 * x)
    assert {r["row_id"]: r["vec"] for r in doubled.collect()} == {1: [2.0, 0.0], 2: None, 3: [1.2, 1.6], 5: [0.0, 2.0]}
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "row_id int, vec array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ in width"):
        augment.map_vectors(uneven, "vec", lambda x: x).collect()


def test_best_columns_equal_a_full_sort():
    sim = np.random.default_rng(0).integers(0, 6, (50, 40)).astype(float)
    for k in (1, 5, 39, 40, 60):
        assert (neighbours._first_columns(sim, k) == np.argsort(-sim, axis=1, kind="stable")[:, :k]).all()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from triskel import session

    def fake(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("spark://host:7077"))
    assert session.shared_folder(fake("spark://host:7077", "hdfs://a/b/")).startswith("hdfs://a/b/triskel-")
    assert session.shared_folder(fake("local[8]"))


def plain_kmeans(points, k, restarts, seed):
    """Partition of {key: vector} by the same rule, one restart after the other."""
    keys = sorted(points)
    x = np.array([points[i] for i in keys])
    runs = []
    for r in range(restarts):
        centres = []
        for step in range(k):
            d2 = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0) if centres else np.ones(len(x))
            times = [(-np.log(kmeans._uniform(seed, r, step, i)) / d if d > 0 else np.inf, str(i), n) for n, (i, d) in enumerate(zip(keys, d2, strict=True))]
            centres.append(x[min(times)[2]])
        before = None
        while True:
            d2 = np.array([((x - c) ** 2).sum(axis=1) for c in centres])
            at = d2.argmin(axis=0)
            if before is not None and (at == before).all():
                break
            before = at
            centres = [x[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(k)]
        runs.append((d2.min(axis=0).sum(), at))
    least = min(c for c, _ in runs)
    at = next(a for c, a in runs if c <= least * (1 + 1e-9))
    return {frozenset(i for i, a in zip(keys, at, strict=True) if a == c) for c in set(at.tolist())}


@pytest.mark.parametrize("partitions", [1, 13])
def test_kmeans_equals_the_plain_rule_in_any_layout(spark, partitions):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 3)) * 3
    points = {i: (centres[i % 4] + rng.normal(size=3)).tolist() for i in range(120)}
    df = spark.createDataFrame([(i, v, 1) for i, v in points.items()] + [(900, None, 1), (901, [None, 1.0, 2.0], 1)], "id int, vec array<double>, cluster int")
    got = kmeans.kmeans_assign(df.repartition(partitions), "id", 4, restarts=3, seed=7).collect()
    found = {}
    for i, c in got:
        found.setdefault(c, set()).add(i)
    assert set(map(frozenset, found.values())) == plain_kmeans(points, 4, 3, 7)
    # Numbered by their least keys.
    assert [min(found[c]) for c in range(4)] == sorted(min(v) for v in found.values())


def test_kmeans_of_odd_tables(spark):
    kind = "id string, vec array<float>"
    assert kmeans.kmeans_assign(spark.createDataFrame([], kind), "id", 3).isEmpty()
    same = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [1.0, 1.0]), (None, [5.0, 5.0])], kind)
    got = {r["id"]: r["cluster"] for r in kmeans.kmeans_assign(same, "id", 5, restarts=2).collect()}
    assert got["a"] == got["b"] != got[None]


def test_strips_meet_every_pair_of_tiles_once(spark):
    rows = spark.createDataFrame([(i, [1.0]) for i in range(200)], "id bigint, vec array<double>")
    for strip in (1, 2, 7, 50):
        held, streamed, tasks = tiles.triangle_tasks(rows, "id", 7, strip)

        def count(tile, mine, rest):
            for other, table in rest:
                yield pa.table({"a": [min(tile, other)], "b": [max(tile, other)], "n": [len(mine) * len(table)]})

        met = tiles.strip_scan(held, streamed, count, "a int, b int, n bigint", tasks).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
        sizes = {r["_tile"]: r["n"] for r in streamed.dropDuplicates(["id"]).groupBy("_tile").agg(F.count("*").alias("n")).collect()}
        assert {(r["a"], r["b"]): r["n"] for r in met} == {(a, b): sizes[a] * sizes[b] for a in sizes for b in sizes if a <= b}


def clustered(rng, centres, each, d=8, spread=0.02):
    middle = rng.standard_normal((centres, d))
    x = np.repeat(middle, each, axis=0) + spread * rng.standard_normal((centres * each, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("make", "most"), [(lambda r: clustered(r, 40, 40), 0.4), (lambda r: unit_rows(r, 600, 8), 1.0)])
def test_pruned_neighbours_are_exact_and_skip_far_tiles(spark, make, most):
    x = make(np.random.default_rng(3))
    x[5], x[9], x[11] = 0.0, x[8], x[8]  # a vector without a direction, and equal ones
    df = spark.createDataFrame([(f"k{i:04}", v.tolist()) for i, v in enumerate(x)], "key string, vec array<double>").repartition(5)
    got = {}
    for prune in (True, False):
        found = neighbours.top_neighbours(df, "key", 6, tiles=40, prune=prune).collect()
        got[prune] = sorted((r["key"], r["position"], r["neighbour"], r["sim"]) for r in found)
    assert got[True] == got[False]
    sim = np.round(x @ x.T, 12)
    np.fill_diagonal(sim, -np.inf)
    for i in (0, 5, 8, 9, 11, 500):
        plain = sorted(range(len(x)), key=lambda j: (-sim[i, j], j))[:6]
        assert [r[2] for r in got[True] if r[0] == f"k{i:04}"] == [f"k{j:04}" for j in plain]
    _, pairs, total = neighbours.pruned_pairs(df, "key", 6, 40, tile_rows=100)
    assert pairs.count() <= most * total * total


def test_tasks_of_a_product_follow_its_terms():
    assert clustering.product_tasks((3, 300), (5, 500)) == (1, 1)
    for n, m in ((10, 10_000), (3000, 3000), (50_000, 40_000)):
        tall, wide = clustering.product_tasks((n, n * 1000), (m, m * 1000))
        wanted = min(n * m * 1000 / clustering.TASK_TERMS, clustering.MAX_TASKS)
        assert tall <= n and wide <= m and 0.6 * wanted <= tall * wide <= 1.6 * wanted + 2


def test_expected_information_with_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(clustering, "TASK_TERMS", 500)
    rng = np.random.default_rng(6)
    a, b = (np.minimum(rng.geometric(0.02, 4000), 150) for _ in range(2))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a int, b int")
    got = clustering.expected_information(clustering.contingency(df, "a", "b"), "a", "b").first()["emi"]
    n, total = len(a), 0.0
    lf = [math.lgamma(i + 1) for i in range(n + 1)]
    for sa in np.bincount(a)[np.bincount(a) > 0].tolist():
        for sb in np.bincount(b)[np.bincount(b) > 0].tolist():
            for k in range(max(1, sa + sb - n), min(sa, sb) + 1):
                w = lf[sa] + lf[sb] + lf[n - sa] + lf[n - sb] - lf[n] - lf[k] - lf[sa - k] - lf[sb - k] - lf[n - sa - sb + k]
                total += k / n * math.log(n * k / (sa * sb)) * math.exp(w)
    assert got == pytest.approx(total, rel=1e-9)


@pytest.mark.parametrize("bins", [20, 7, 300])
def test_bins_of_products_follow_the_rule_at_every_border(bins):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((517, 6))
    a /= np.linalg.norm(a, axis=1)[:, None]
    a[:40] = np.eye(6)[rng.integers(0, 6, 40)] * rng.choice([-1.0, 1.0], 40)[:, None]
    borders = np.linspace(-1.0, 1.0, bins + 1)  # products with the axes lie on them
    b = np.zeros((1300 + len(borders), 6))
    b[:1300] = rng.standard_normal((1300, 6))
    b[:1300] /= np.linalg.norm(b[:1300], axis=1)[:, None]
    b[1300:, 0], b[1300:, 1] = borders, np.sqrt(1.0 - borders**2)
    b[5] = 0.0
    for scale in (1.0, 3.0):
        left = a * scale
        sim = np.round(left @ b.T, neighbours.SIM_DECIMALS)
        want = np.bincount(np.clip(np.floor((sim + 1.0) * (bins / 2.0)), 0, bins - 1).astype(int).ravel(), minlength=bins)
        assert (reports._bin_counts(left, b, bins) == want).all()


def test_kernels_hold_little_whatever_the_tile():
    """A block of a product, not a tile's rows by another's, is in memory at once."""
    import tracemalloc

    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 8), pa.int32()), pa.array(x.ravel()))
    held = pa.table({"id": pa.array(np.arange(6000)), "vec": column, "a": column, "b": column})
    kernels = [neighbours._topk_kernel("id", 5, pa.int64()), retrieval._kernel("id", [("a", "b")], ["a", "b"])]
    for kernel in kernels:
        tracemalloc.start()
        list(kernel(0, held, iter([(0, held)])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24e6
    tracemalloc.start()
    reports._bin_counts(x, x, 20)
    assert tracemalloc.get_traced_memory()[1] < 24e6
    tracemalloc.stop()


def test_neighbours_found_by_blocks_equal_a_full_sort():
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((3000, 3)), 1)  # many ties
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 3), pa.int32()), pa.array(x.ravel()))
    table = pa.table({"id": pa.array(np.arange(3000)), "vec": column})
    parts = [(i, table.slice(i * 1100, 1100)) for i in range(3)]
    got = pa.concat_tables(neighbours._topk_kernel("id", 7, pa.int64())(0, table, iter(parts))).to_pandas()
    sim = np.round(x @ x.T, neighbours.SIM_DECIMALS)
    np.fill_diagonal(sim, -np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(3000), sim.shape), -sim), axis=1)[:, :7]
    assert (got["neighbour"].to_numpy().reshape(3000, 7) == order).all()


def test_the_metric_listing_draws_no_sample(spark):
    rows = [("row", "a->b", "R@10", 0.5), ("row", None, "mean_R@10", 0.5), ("moa", None, "kNN_5_acc", 0.1), ("row", None, "uniform_a", 0.2)]
    df = spark.createDataFrame(rows, "scope string, direction string, metric string, value double").repartition(4)
    out = reports.metric_listing(df)
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()
    assert [r["section"][0] for r in out.collect()] == ["1", "1", "3", "4"]
