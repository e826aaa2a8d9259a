"""Matching, filtering, splitting and scaling against small models."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triskel.operators import filters, joins, ordering, quantiles, scaling, splits
from triskel.plans import curate
from triskel.sources import sinks, tables


def hot_rows(n, seed):
    """A third of all rows share one key."""
    r = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{r.randrange(12)}", i) for i in range(n)]


def paired_model(left, right):
    by_key = {}
    for k, o in sorted(right, key=lambda x: x[1]):
        by_key.setdefault(k, []).append(o)
    seen, out = {}, []
    for k, o in sorted(left, key=lambda x: x[1]):
        if k in by_key:
            i = seen.get(k, 0)
            seen[k] = i + 1
            out.append((k, o, by_key[k][i % len(by_key[k])]))
    return sorted(out)


@pytest.mark.parametrize("slice_rows", [3, 1 << 20])
@pytest.mark.parametrize("sizes", [(300, 17), (40, 200)])
def test_round_robin_with_a_hot_key(spark, slice_rows, sizes):
    left, right = hot_rows(sizes[0], 1), hot_rows(sizes[1], 2)
    left.append((None, 9999))
    l = spark.createDataFrame(left, "key string, ordinal bigint")
    r = spark.createDataFrame([(k, o, o) for k, o in right], "key string, ordinal bigint, mate bigint")
    got = joins.pair_round_robin(l, r, "key", slice_rows=slice_rows).select("key", "ordinal", "mate")
    assert sorted(map(tuple, got.collect())) == paired_model([x for x in left if x[0]], right)


def test_right_columns_replace_left_ones(spark):
    l = spark.createDataFrame([("a", 0, "left")], "key string, ordinal bigint, v string")
    r = spark.createDataFrame([("a", 5, "right")], "key string, ordinal bigint, v string")
    assert tuple(joins.pair_round_robin(l, r, "key").select("ordinal", "v").first()) == (0, "right")


@pytest.mark.parametrize("width", [4, 1 << 20])
def test_ordered_index_of_a_hot_key(spark, width):
    rows = hot_rows(200, 3)
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, ordinal bigint").repartition(7)
    got = ordering.ordered_index(
        df, ["key"], ["ordinal"], "i", bucket=ordering.ordinal_bucket("ordinal", width)
    ).collect()
    seen = {}
    want = {}
    for k, o in sorted(rows, key=lambda x: x[1]):
        want[o] = seen.get(k, 0)
        seen[k] = want[o] + 1
    assert {r["ordinal"]: r["i"] for r in got} == want


def test_batches_keep_or_drop_the_short_last_one(spark):
    df = spark.range(10).withColumnRenamed("id", "ordinal")
    assert {r[0]: r[1] for r in ordering.batches(df, "ordinal", 4).groupBy("batch").count().collect()} == {0: 4, 1: 4, 2: 2}
    assert ordering.batches(df, "ordinal", 4, drop_last=True).count() == 8


def test_last_wins_and_null_rules(spark):
    t = spark.createDataFrame([("a", "x", 0), ("a", None, 1), ("b", "y", 2)], "k string, v string, ordinal bigint")
    keep = {r["k"]: r["v"] for r in joins.last_per_key(t, "k", "v").collect()}
    drop = {r["k"]: r["v"] for r in joins.last_per_key(t, "k", "v", keep_null=False).collect()}
    assert keep == {"a": None, "b": "y"} and drop == {"a": "x", "b": "y"}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_unique_join_equals_the_plain_join_for_a_hot_key(spark, how):
    rows = [*hot_rows(120, 11), (None, 500)]
    df = spark.createDataFrame([(k, o << 19) for k, o in rows], "key string, ordinal bigint")
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("other", 3)], "key string, v int")
    got = joins.join_unique(df, table, "key", how)
    want = df.join(table, "key", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_controls_are_case_insensitive_and_nulls_stay(spark):
    rows = [("DMSO", "trt_cp"), (" Dmso ", None), ("EMPTY", "x"), (None, None), ("ok", "CTL_VEHICLE"), ("ok", "trt_cp"), ("dmso2", "x")]
    df = spark.createDataFrame(rows, "pert_iname string, pert_type string")
    assert sorted(str(r[0]) for r in filters.remove_controls(df).collect()) == ["None", "dmso2", "ok"]
    only = spark.createDataFrame([(1,)], "value int")
    assert filters.remove_controls(only).count() == 1


def quality_frame(spark):
    """100 rows: constant, 6 missing, 4 missing, and three rows without any value."""
    rows = []
    for i in range(100):
        empty = i >= 97
        rows.append(
            (
                f"c{i // 2}",
                f"R{i % 20}",
                i,
                None if empty else 1.0,
                None if empty or i < 6 else float(i),
                None if empty or i < 4 else float(i % 7),
                None if empty else (float("inf") if i == 50 else float(i) / 10),
            )
        )
    return spark.createDataFrame(
        rows,
        "compound_id string, smiles string, ordinal bigint, Cells_flat double, Cells_six double, Cells_four double, gene_0_at double",
    )


def test_quality_filter_thresholds(spark):
    features = ["Cells_flat", "Cells_six", "Cells_four", "gene_0_at"]
    rows, kept = filters.quality_filter(quality_frame(spark), features)
    assert rows.count() == 97
    assert kept == ["Cells_flat", "Cells_four", "gene_0_at"]
    assert rows.where("gene_0_at = double('Infinity')").isEmpty()
    split = splits.hashed_split(rows, "smiles")
    assert filters.drop_constant(split, kept)[1] == ["Cells_four", "gene_0_at"]


def test_single_training_row_keeps_its_features(spark):
    df = spark.createDataFrame([("train", 1.0), ("val", 2.0)], "split string, f double")
    assert filters.constant_features(df, ["f"]).isEmpty()


def greedy_model(weights, fractions, start):
    total = {s: fractions[s] for s in fractions}
    counts = dict(start)
    given = dict.fromkeys(counts, 0)
    for w in weights:
        best = min(counts, key=lambda s: counts[s] / max(total[s], 1e-9))
        counts[best] += w
        given[best] += 1
    return given


@settings(max_examples=1500, deadline=None)
@given(
    st.integers(1, 50), st.integers(1, 400),
    st.tuples(st.integers(0, 300), st.integers(0, 300), st.integers(0, 300)),
    st.integers(100, 5000),
)
def test_equal_groups_are_shared_as_the_greedy_rule_would(weight, items, start, total):
    counts = dict(zip(("train", "val", "test"), start, strict=True))
    targets = {"train": 0.7 * total, "val": 0.15 * total, "test": 0.15 * total}
    assert splits.share_run(counts, targets, weight, items) == greedy_model([weight] * items, targets, counts)


def test_greedy_split_never_leaks_and_meets_its_targets(spark):
    r = random.Random(5)
    rows = []
    for c in range(400):
        scaffold = f"s{min(int(r.expovariate(0.05)), 90)}"
        rows += [(f"c{c}", scaffold, len(rows) + d) for d in range(r.choice([1, 1, 2, 3, 6]))]
    df = spark.createDataFrame(rows, "compound_id string, smiles string, ordinal bigint")
    out = splits.greedy_split(df)
    assert out.count() == len(rows)
    assert out.groupBy("compound_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert out.groupBy("smiles").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    share = {x["split"]: x["rows"] / len(rows) for x in splits.split_sizes(out).collect()}
    assert abs(share["train"] - 0.7) < 0.12 and abs(share["val"] - 0.15) < 0.12


def filled_model(values):
    present = [v for v in values if v is not None]
    med = float(np.median(present))
    f = [med if v is None else v for v in values]
    return med, float(np.percentile(f, 25)), float(np.percentile(f, 75))


def test_quartiles_are_exact_with_gaps_duplicates_and_hot_values(spark):
    r = random.Random(6)
    cols = {
        "plain": [r.gauss(0, 1) for _ in range(501)],
        "gaps": [None if r.random() < 0.3 else r.random() for _ in range(500)],
        "hot": [3.0 if r.random() < 0.4 else r.choice([1.0, 2.0, 9.0]) for _ in range(333)],
        "one": [None, 4.0, None],
        "pair": [1.0, 2.0],
        "mostly_gaps": [None] * 50 + [1.0, 5.0, 6.0],
        "flat": [2.5] * 40,
    }
    for f, vs in cols.items():
        df = spark.createDataFrame([(v, None) for v in vs], f"`{f}` double, void double").repartition(5)
        got = quantiles.filled_quartiles(df, [f, "void"])
        assert set(got) == {f}
        assert got[f] == pytest.approx(filled_model(vs), abs=1e-12), f


ODD = [-math.inf, -1e300, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, math.inf, math.nan]


def test_images_keep_the_order_of_doubles():
    images = quantiles.ordered_image(np.array(ODD)).tolist()
    assert images == sorted(images) and len(set(images)) == len(ODD) - 1  # the zeros are equal
    back = [quantiles.value_of_image(i) for i in images]
    assert math.isnan(back[-1]) and back[:-1] == ODD[:-1]


@pytest.mark.parametrize("fetched", [0, 20, 10**6])
def test_order_statistics_at_any_depth_of_the_search(spark, fetched):
    r = random.Random(8)
    cols = {
        "a": [r.choice([1.0, 2.0, r.gauss(0, 1)]) for _ in range(700)],
        "b": [2.0**-i for i in range(700)],
        "c": [None if i % 3 else 1.0 + i * 2**-52 for i in range(700)],
        "d": (ODD[:-1] * 70)[:700],
    }
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), "a double, b double, c double, d double").repartition(4)
    ranks = {"a": [0, 350, 699], "b": [1, 500], "c": [0, 100, 233], "d": [0, 10, 300, 699]}
    got = quantiles.order_statistics(df, ranks, fetched=fetched)
    plain = {f: sorted(v for v in vs if v is not None) for f, vs in cols.items()}
    assert got == {(f, p): plain[f][p] for f, ps in ranks.items() for p in ps}


def test_passes_are_bounded_with_a_spike_at_the_median(spark, monkeypatch):
    """A third of the rows is one value in the middle of distinct ones."""
    passes = []
    for name in ("_next_digits", "_fetched"):
        whole = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, whole=whole: passes.append(1) or whole(*a))
    n = 300_000
    spike = F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") - n / 2) * F.pi() / n)
    df = spark.range(n).select(spike.alias("spike"), F.rand(1).alias("even"))
    present = [v for v, in df.select("spike").collect()]
    got = quantiles.order_statistics(df, {"spike": [75_000, 150_000, 225_000], "even": [0, n - 1]})
    assert [got["spike", p] for p in (75_000, 150_000, 225_000)] == [sorted(present)[p] for p in (75_000, 150_000, 225_000)]
    assert len(passes) <= 5


def scaled_frame(spark):
    rng = np.random.default_rng(7)
    split = ["train"] * 70 + ["val"] * 15 + ["test"] * 15
    rows = [
        (s, float(5 + 2 * rng.standard_normal()), 1000.0 if i == 99 else float(rng.standard_normal()), float(10 + rng.standard_normal()))
        for i, s in enumerate(split)
    ]
    rows[3] = (*rows[3][:1], None, *rows[3][2:])
    return spark.createDataFrame(rows, "split string, Cells_F0 double, Cells_F1 double, gene_0_at double"), rows


def test_a_standard_fit_does_not_hang_on_the_order_of_sums(spark):
    x = F.col("id") % 977 / F.lit(10.0) + F.lit(1000.1)
    df = spark.range(0, 400_000, numPartitions=1).select(x.alias("gene_0_at"), F.lit("train").alias("split"))
    values = [float(i % 977) / 10.0 + 1000.1 for i in range(400_000)]
    mean = math.fsum(values) / len(values)
    deviation = math.sqrt(math.fsum((v - mean) ** 2 for v in values) / len(values))
    row = scaling.fit_standard(df, ["gene_0_at"]).first()
    assert row["center"] == pytest.approx(mean, rel=4e-16, abs=0)
    assert row["scale"] == pytest.approx(deviation, rel=2e-15, abs=0)


def test_scaling_fits_on_train_and_clips(spark):
    df, rows = scaled_frame(spark)
    fit = scaling.fit_modalities(df, ["Cells_F0", "Cells_F1"], ["gene_0_at"])
    f = {r["feature"]: (r["center"], r["scale"]) for r in fit.collect()}
    med, p25, p75 = filled_model([r[1] for r in rows[:70]])
    assert f["Cells_F0"] == pytest.approx((med, p75 - p25))
    genes = [r[3] for r in rows[:70]]
    assert f["gene_0_at"] == pytest.approx((np.mean(genes), np.std(genes)))
    out = scaling.apply_scaling(df, fit, ["Cells_F0", "Cells_F1", "gene_0_at"])
    stats = out.agg(F.max("Cells_F1"), F.min("Cells_F1"), F.count_if(F.col("Cells_F0").isNull())).first()
    assert stats[0] == 5.0 and stats[1] >= -5.0 and stats[2] == 1


def test_standardised_modality_is_left_alone(spark):
    x = np.random.default_rng(8).standard_normal(200)
    df = spark.createDataFrame([("train", float(v)) for v in (x - x.mean()) / x.std()], "split string, g_at double")
    row = scaling.fit_standard(df, ["g_at"]).first()
    assert (row["center"], row["scale"], row["rescaled"]) == (0.0, 1.0, False)


def sources(spark):
    r = random.Random(9)
    morph = [(f"BRD-K{i % 12:08d}-1", "m", "P", float(r.random()), float(i % 5), i) for i in range(40)]
    expr = [
        (f"BRD-K{i % 15:08d}-{i % 3}", "DMSO" if i == 0 else "x", f"C{i % 15}", r.gauss(0, 2), r.random(), i)
        for i in range(90)
    ]
    meta = [(f"BRD-K{i:08d}-9", "-666" if i == 2 else f"N{i} |z|", i) for i in range(8)]
    return (
        spark.createDataFrame(morph, "Metadata_broad_sample string, Metadata_moa string, Metadata_Plate string, Cells_a double, Nuclei_b double, ordinal bigint"),
        spark.createDataFrame(expr, "pert_id string, pert_iname string, x_smiles string, g0_at double, g1_at double, ordinal bigint"),
        spark.createDataFrame(meta, "broad_id string, smiles string, ordinal bigint"),
    )


def test_whole_curation_writes_and_reads_back(spark, tmp_path):
    morph, expr, meta = sources(spark)
    matched = curate.match_treatments(morph, expr, meta)
    assert matched.count() == 72  # 12 shared keys, six expression rows each
    curated = curate.curate(matched)
    assert curated.rows.count() == 71
    folder = str(tmp_path / "processed")
    curate.save(curated, folder)
    total = sum(tables.processed_split(spark, folder, s).count() for s in ("train", "val", "test"))
    assert total == 71
    assert tables.manifest(spark, f"{folder}/feature_columns.json")["morph_features"] == curated.morph_features
    smiles = {r[0] for r in matched.select("smiles").distinct().collect()}
    assert "C2" in smiles and "N3" in smiles and "-666" not in smiles


def test_missing_key_columns_are_errors(spark):
    morph, expr, meta = sources(spark)
    with pytest.raises(KeyError):
        curate.match_treatments(morph, expr.drop("pert_id"), meta)


def test_csv_source_errors_and_shared_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.morphology_csv(spark, str(tmp_path))
    (tmp_path / "b1.csv").write_text("Metadata_broad_sample,Cells_a,Cells_x\nBRD-K00000001-001,1.5,2\nBRD-K00000002-001,inf,3\n")
    (tmp_path / "b2.csv").write_text("Cells_a,Nuclei_y,Metadata_broad_sample\n,7,BRD-K00000003-001\n")
    df = tables.morphology_csv(spark, str(tmp_path)).orderBy("ordinal")
    assert df.columns == ["Cells_a", "Metadata_broad_sample", "ordinal", "compound_id"]
    assert [(r["Cells_a"], r["compound_id"]) for r in df.collect()] == [
        (1.5, "BRD-K00000001"), (None, "BRD-K00000002"), (None, "BRD-K00000003"),
    ]
    (tmp_path / "b3.csv").write_text("Cells_a\n1\n")
    with pytest.raises(KeyError):
        tables.morphology_csv(spark, str(tmp_path))


def test_many_files_are_read_in_order_by_ranges(spark, tmp_path, monkeypatch):
    import gzip

    from triskel.sources import csv_files

    monkeypatch.setattr(csv_files, "RANGE_BYTES", 100)
    wanted = []
    for i in range(300):
        name = f"f{i:03}.csv" + (".gz" if i % 10 == 9 else "")
        header = ["Metadata_broad_sample", "Cells_a", f"Only_{i}"] if i % 2 else ["Cells_a", "Metadata_broad_sample"]
        rows = [{"Cells_a": f"{i}.{j}", "Metadata_broad_sample": f"BRD-K{i:04}{j:04}-001", f"Only_{i}": "x"} for j in range(i % 17)]
        text = "\r\n".join([",".join(header), *[",".join(r[h] for h in header) for r in rows]]) + ("\r\n" if i % 3 else "")
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
        wanted.append((name.endswith("gz"), name, [(float(r["Cells_a"]), r["Metadata_broad_sample"]) for r in rows]))
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "other.csv").write_text("a\n1\n")
    df = tables.morphology_csv(spark, str(tmp_path))
    plan = df._jdf.queryExecution().toString()
    assert "f000.csv" not in plan.split("Physical Plan")[-1] or plan.count(".csv") < 900
    got = [(r["Cells_a"], r["Metadata_broad_sample"]) for r in df.orderBy("ordinal").collect()]
    assert got == [row for _, _, rows in sorted(wanted) for row in rows]
    assert df.select("ordinal").distinct().count() == len(got)


def test_audit_of_real_files(spark, tmp_path):
    from triskel.sources.csv_files import audit_folder

    assert audit_folder(spark, str(tmp_path / "none")).isEmpty()
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("id,x,y\nk1,1,\nk2,inf,2.5\n")
    (tmp_path / "sub" / "b.csv").write_text("x,y,z,w\n1,NaN,-inf,True\n,2,+3,False\n7,1e3, 4,True\n")
    (tmp_path / "c.csv").write_text("u,v\n")
    (tmp_path / "broken.csv.gz").write_bytes(b"this is no gzip")
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n1,2,3\n")
    (tmp_path / "empty.csv").write_text("")
    row = audit_folder(spark, str(tmp_path)).first()
    # a: x and y; b: x, y and z. Columns of a file without rows are all numbers as far as they go.
    assert tuple(row) == (6, 5, 3, pytest.approx(3 / 13), 2)


def test_sidecar_key_is_detected_or_dropped(spark):
    samples = spark.createDataFrame([("s0", 1.0), ("s1", 2.0)], "inst_id string, g double")
    known = spark.createDataFrame([("s1", "d")], "profile_id string, dose string")
    other = spark.createDataFrame([("zz", "d")], "profile_id string, dose string")
    assert tables.attach_sidecar(samples, known).columns == ["inst_id", "g", "dose"]
    assert tables.attach_sidecar(samples, other).columns == ["inst_id", "g"]
    assert tables.attach_sidecar(samples, other, known.withColumnRenamed("profile_id", "inst_id")).columns[-1] == "dose"


def test_run_log_reads_ragged_lines_and_rejects_empty(spark, tmp_path):
    log = tmp_path / "runs.jsonl"
    log.write_text('{"config": "T1", "seed": 1, "val_loss": NaN}\n\n' + json.dumps({"config": "B4", "seed": 2, "mean_R@10": 0.5}) + "\n")
    long = tables.runs_long(tables.run_log(spark, str(log)))
    assert [tuple(r) for r in long.collect()] == [("B4", 2, "mean_R@10", 0.5)]
    empty = tmp_path / "none.jsonl"
    empty.write_text("\n")
    with pytest.raises(ValueError):
        tables.run_log(spark, str(empty))


def test_optional_source_is_empty_when_missing(spark, tmp_path):
    assert tables.optional_tsv(spark, str(tmp_path / "absent.txt"), "pert_id string, moa string").isEmpty()


def test_append_only_log(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([("T1", 1)], "config string, seed int")
    sinks.append_runs(one, path)
    sinks.append_runs(one, path)
    assert spark.read.json(path).count() == 2
    assert math.isclose(1.0, 1.0)


def test_sidecar_key_is_found_behind_many_other_rows(spark):
    samples = spark.createDataFrame([("s1",), ("s2",)], "inst_id string")
    rows = [(f"other{i}", "x") for i in range(500)] + [("s2", "hit")]
    sidecar = spark.createDataFrame(rows, "profile string, tag string").repartition(7)
    got = {r["inst_id"]: r["tag"] for r in tables.attach_sidecar(samples, sidecar).collect()}
    assert got == {"s1": None, "s2": "hit"}
