"""Losses, augmentation, fingerprints, scoring, monitors and significance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from triskel.functions.hashing import hash32, py_hash32
from triskel.functions.numeric import clip, finite, log_factorial
from triskel.operators import augment, encode, losses, monitors, ordering, runs

MODS = ["mol", "morph"]


def frame(spark, vectors, groups):
    rows = [(0, groups[i], *[v[i].tolist() for v in vectors.values()]) for i in range(len(groups))]
    cols = ", ".join(f"{m} array<double>" for m in vectors)
    return spark.createDataFrame(rows, f"batch bigint, g string, {cols}")


def unit_rows(seed, n=8, d=16):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_pair_loss_is_symmetric_and_unique_groups_equal_none(spark):
    a, b = unit_rows(1), unit_rows(2)
    ids = list("ABCDEFGH")
    one = losses.batch_losses(frame(spark, {"mol": a, "morph": b}, ids), "batch", MODS).first()
    two = losses.batch_losses(frame(spark, {"mol": b, "morph": a}, ids), "batch", MODS).first()
    grouped = losses.batch_losses(frame(spark, {"mol": a, "morph": b}, ids), "batch", MODS, group="g").first()
    multi = losses.batch_losses(frame(spark, {"mol": a, "morph": b}, list("ABCDABCD")), "batch", MODS, group="g").first()
    assert one["loss_mol_morph"] == pytest.approx(two["loss_mol_morph"])
    assert grouped["loss_mol_morph"] == pytest.approx(one["loss_mol_morph"])
    assert multi["loss_mol_morph"] != pytest.approx(one["loss_mol_morph"])


def test_components_sum_to_the_total_and_weights_scale(spark):
    df = frame(spark, {"mol": unit_rows(3), "morph": unit_rows(4)}, list("ABCDEFGH"))
    base = losses.batch_losses(df, "batch", MODS).first()
    double = losses.batch_losses(df, "batch", MODS, pair_weights={"mol_morph": 2.0}).first()
    none = losses.batch_losses(df, "batch", MODS, pair_weights={"mol_morph": 0.0}).first()
    parts = base["loss_mol_morph"] + base["vicreg_mol"] + base["vicreg_morph"]
    assert base["loss_total"] == pytest.approx(parts)
    assert double["loss_total"] == pytest.approx(base["loss_total"] + base["loss_mol_morph"])
    assert none["loss_total"] == pytest.approx(base["vicreg_mol"] + base["vicreg_morph"])


def test_penalty_is_high_on_collapse_and_matches_the_covariance_form():
    assert losses._penalty(np.ones((32, 8))) > 0.9
    for shape in ((6, 20), (50, 5)):
        h = np.random.default_rng(5).standard_normal(shape)
        cov = np.cov(h, rowvar=False)
        want = np.maximum(1 - np.sqrt(np.diag(cov) + 1e-4), 0).mean()
        want += ((cov**2).sum() - (np.diag(cov) ** 2).sum()) / shape[1]
        assert losses._penalty(h) == pytest.approx(want)


def test_temperature_is_clamped():
    assert losses.temperature(-5.0) == 1.0 and losses.temperature(50.0) == 30.0


def test_nan_loss_raises(spark):
    bad = spark.createDataFrame([(0, float("nan")), (1, 2.0)], "batch bigint, loss_total double")
    with pytest.raises(Exception, match="NaN loss in 1 batches"):
        losses.mean_without_nan(bad).collect()
    assert losses.mean_without_nan(bad.where("batch = 1")).first()["loss_total"] == 2.0
    assert tuple(losses.nan_batches(bad).first()) == (2, 1)


def test_only_numbers_above_the_limit_are_explosions(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 10.0), (4, 10.5), (5, None)], "i int, grad_norm double")
    assert [r["i"] for r in monitors.explosion_alerts(df).orderBy("i").collect()] == [2, 4]


def test_label_codes_follow_the_type_of_the_label(spark):
    for values, kind in (([1, 2, 9, 10, 11, 100, -5], "int"), ([f"prefix{i:04d}" for i in range(300)], "string")):
        df = spark.createDataFrame([(v,) for v in values] * 2 + [(None,)], f"label {kind}").repartition(5)
        got = {r["label"]: r["code"] for r in ordering.label_codes(df, "label").collect()}
        assert got == {v: i for i, v in enumerate(sorted(values))}


def test_hash_agrees_with_python(spark):
    got = spark.range(20).select(hash32(7, F.col("id"), "x").alias("h")).collect()
    assert [r["h"] for r in got] == [py_hash32(7, i, "x") for i in range(20)]


def test_corruption_replaces_the_asked_number_of_cells_by_column_values(spark):
    n, d = 40, 10
    # Cell (row, dim) holds row + dim/100, so a value tells its column.
    rows = [(i, [i + j / 100 for j in range(d)]) for i in range(n)]
    df = spark.createDataFrame(rows, "pos bigint, vec array<double>")
    out = augment.corrupt_marginals(df, "pos", "vec", d, n, seed=1).orderBy("pos").collect()
    changed = 0
    for r in out:
        assert [round(v % 1, 2) for v in r["vec"]] == [j / 100 for j in range(d)]
        changed += sum(int(v) != r["pos"] for v in r["vec"])
    assert len(out) == n and 0.8 * 4 * n <= changed <= 4 * n


@pytest.mark.parametrize("block", [7, 40, 1000])
def test_corruption_by_blocks_equals_the_rule(spark, block):
    import hashlib

    n, d = 40, 10
    vectors = {i: None if i == 3 else [None if (i, j) == (5, 2) else i + j / 100 for j in range(d)] for i in range(n)}
    df = spark.createDataFrame([(f"id{i}", i, v, 1) for i, v in vectors.items()], "id string, pos bigint, vec array<double>, _row int").repartition(3)
    out = augment.corrupt_marginals(df, "pos", "vec", d, n, seed=9, block=block)
    assert out.columns == df.columns
    for r in out.collect():
        i, want = r["pos"], vectors[r["pos"]]
        if want is not None:
            digests = [hashlib.md5(f"9|{i}|{j}".encode()).hexdigest() for j in range(d)]
            want = list(want)
            for j in sorted(range(d), key=lambda j: (digests[j][:8], j))[:4]:
                donor = vectors[int(digests[j][8:16], 16) % n]
                want[j] = None if donor is None else donor[j]
        assert (r["id"], r["vec"], r["_row"]) == (f"id{i}", want, 1)


def test_bit_dropout_share(spark):
    df = spark.createDataFrame([("a", list(range(25))), ("b", [1, 2, 3]), ("c", [])], "k string, bits array<int>")
    kept = {r["k"]: r["b"] for r in df.select("k", augment.drop_bits(F.col("bits"), F.col("k"), 9).alias("b")).collect()}
    assert len(kept["a"]) == 23 and kept["b"] == [1, 2, 3] and kept["c"] == []


def test_random_vectors_have_unit_norm_and_repeat(spark):
    def draw():
        v = augment.random_unit_vector(F.col("id"), "mol", 64, 42).alias("v")
        return np.array([r["v"] for r in spark.range(6).select(v).collect()])

    assert np.allclose(np.linalg.norm(draw(), axis=1), 1.0)
    assert np.array_equal(draw(), draw())


def test_fingerprints_are_deduplicated_and_skip_invalid(spark):
    rows = [("CCO",), ("CCO",), ("CCO |x|",), ("-666",), ("  ",), (None,)]
    t = encode.fingerprint_table(spark.createDataFrame(rows, "s string"), "s", n_bits=64)
    bits = {r["s"]: r["bits"] for r in t.collect()}
    assert set(bits) == {"CCO", "CCO |x|"} and bits["CCO"] == bits["CCO |x|"]
    assert all(0 <= b < 64 for b in bits["CCO"]) and len(set(bits["CCO"])) == len(bits["CCO"])
    dense = t.where("s = 'CCO'").select(encode.dense_bits(F.col("bits"), 64).alias("d")).first()["d"]
    assert len(dense) == 64 and sum(dense) == len(bits["CCO"])


def test_scores_are_unit_vectors_and_match_numpy(spark):
    rng = np.random.default_rng(6)
    enc = encode.Encoder([encode.Layer(rng.standard_normal((5, 7)), rng.standard_normal(7), relu=True)],
                         [encode.Layer(rng.standard_normal((7, 3)), rng.standard_normal(3))])
    x = rng.standard_normal((9, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>").repartition(3)
    got = np.array([r["vec"] for r in encode.score(df, "vec", enc).orderBy("id").collect()])
    assert np.allclose(got, enc.embed(x)) and np.allclose(np.linalg.norm(got, axis=1), 1.0)


def stopping_model(values, patience):
    best, counter, best_epoch = -math.inf, 0, None
    for i, v in enumerate(values, 1):
        if v is not None and v > best:
            best, counter, best_epoch = v, 0, i
        else:
            counter += 1
            if counter >= patience:
                return i, best_epoch
    return None, best_epoch


def test_early_stopping_follows_the_counter(spark):
    rng = np.random.default_rng(7)
    cases = [([0.1, 0.05, 0.2, 0.2, 0.1, 0.15, 0.3], 3), ([0.5, 0.3, 0.3], 2), ([0.1, 0.05, 0.05, 0.2], 3), ([None, None, 0.2], 3), ([None] * 4, 2)]
    cases += [([round(float(v), 1) for v in rng.random(30)], 4) for _ in range(20)]
    for patience in {p for _, p in cases}:
        chosen = {i: v for i, (v, p) in enumerate(cases) if p == patience}
        rows = [(i, e, v) for i, vs in chosen.items() for e, v in enumerate(vs, 1)]
        df = spark.createDataFrame(rows, "run bigint, epoch int, m double")
        got = monitors.early_stopping(df, ["run"], "m", patience).collect()
        assert {r["run"]: (r["stop_epoch"], r["best_epoch"]) for r in got} == {
            i: stopping_model(v, patience) for i, v in chosen.items()
        }


def test_persistent_high_counts_consecutive_epochs(spark):
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for run in range(10):
        streak = 0
        for epoch in range(1, 80):
            v = None if rng.random() < 0.01 else float(rng.random() < 0.93)
            rows.append((run, epoch, v))
            streak = streak + 1 if v is not None and v > 0.5 else 0
            if streak >= 20:
                want.add((run, epoch, streak))
    df = spark.createDataFrame(rows, "run bigint, epoch int, v double")
    assert {tuple(r) for r in monitors.persistent_high(df, ["run"], "v").collect()} == want


def run_frame(spark):
    rng = np.random.default_rng(9)
    rows = [
        (c, s, "compound/mean_R@10", float(m + 0.01 * rng.standard_normal()))
        for c, m in (("B4", 0.12), ("B5", 0.12), ("B6", 0.7), ("T1", 0.36)) for s in range(5)
    ]
    rows.append(("B0", 42, "compound/mean_R@10", 0.06))
    return spark.createDataFrame(rows, "config string, seed int, metric string, value double"), rows


def test_welch_p_values_and_correction(spark):
    df, rows = run_frame(spark)
    out = {r["baseline"]: r for r in runs.welch_tests(df, "T1", ["B4", "B5", "B6", "B0"]).collect()}
    assert set(out) == {"B4", "B5", "B6"}  # a single run is skipped
    for r in out.values():
        assert 0 <= r["p_value"] <= 1 and r["p_corrected"] == pytest.approx(min(3 * r["p_value"], 1.0))
        assert r["stars"] == "***" and r["significant"]


def test_t_tail_known_values(spark):
    df = spark.createDataFrame([(2.306004135, 8.0), (1.959963985, 1e7), (12.70620474, 1.0), (0.0, 5.0)], "t double, df double")
    p = [r["p"] for r in df.select(runs.t_tail(F.col("t"), F.col("df")).alias("p")).collect()]
    assert p == pytest.approx([0.05, 0.05, 0.05, 1.0], abs=1e-7)


def test_summary_of_a_single_run_has_no_deviation(spark):
    df, _ = run_frame(spark)
    s = {r["config"]: r for r in runs.summarise(df).collect()}
    assert s["B0"]["std"] is None and s["B0"]["count"] == 1 and s["T1"]["count"] == 5
    t = {r["config"]: r["compound/mean_R@10"] for r in runs.summary_table(runs.summarise(df), ["compound/mean_R@10"]).collect()}
    assert t["B0"] == "0.0600" and " ± " in t["T1"]


def test_numeric_expressions(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (7.0,), (None,)], "x double")
    assert [r[0] for r in df.select(finite(F.col("x"))).collect()] == [None, None, None, 7.0, None]
    assert [r[0] for r in df.select(clip(finite(F.col("x")))).collect()] == [None, None, None, 5.0, None]
    got = spark.range(200).select(log_factorial(F.col("id")).alias("v")).collect()
    assert [r["v"] for r in got] == pytest.approx([math.lgamma(i + 1) for i in range(200)], abs=1e-10)


def closed_tail(t, df):
    """Two-sided p of Student's t for 2 and 4 degrees of freedom, without cancellation."""
    s = math.sqrt(df + t * t)
    gap = df / (s * (s + t))  # 1 - t/s
    if df == 2:
        return gap
    x = 1 - gap
    return gap * gap * (2 + x) / 2


@pytest.mark.parametrize("df", [2, 4])
def test_small_p_values_are_right_in_relative_terms(spark, df):
    ts = [0.1, 1.0, 5.0, 100.0, 1e3, 3e3]
    table = spark.createDataFrame([(t, float(df)) for t in ts], "t double, df double")
    got = [r["p"] for r in table.select("t", runs.t_tail(F.col("t"), F.col("df")).alias("p")).orderBy("t").collect()]
    for t, p in zip(ts, got, strict=True):
        assert p == pytest.approx(closed_tail(t, df), rel=1e-10), t
    assert closed_tail(3e3, 4) < 1e-12


def integrated_tail(t, df):
    """The same for any df in 60 digits: the density from t on, over the density from 0 on.

    With the substitution t = sqrt(df) sinh(u) the density is cosh(u)^-df and the trapezoidal
    rule converges beyond all powers of its step from 0 on.
    """
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    d, u = Decimal(df), math.asinh(t / math.sqrt(df))
    u0 = Decimal(u)
    for _ in range(3):  # to full precision
        s = (u0.exp() - (-u0).exp()) / 2
        u0 -= (s - Decimal(t) / d.sqrt()) / ((u0.exp() + (-u0).exp()) / 2)
    reach = Decimal(min(200.0 / df, 200.0)) + Decimal(18) / d.sqrt()

    def density(v):
        return (-d * ((v.exp() + (-v).exp()) / 2).ln()).exp()

    def area(lo, n=1500):
        # Gauss-Legendre on pieces; the integrand is smooth.
        x, w = np.polynomial.legendre.leggauss(20)
        total, h = Decimal(0), reach / (n // 20)
        for i in range(n // 20):
            middle = lo + h * (Decimal(i) + Decimal("0.5"))
            total += sum(Decimal(float(b)) * density(middle + Decimal(float(a)) * h / 2) for a, b in zip(x, w, strict=True)) * h / 2
        return total

    return float(area(u0) / area(Decimal(0)))


def test_p_values_for_any_degrees_of_freedom(spark):
    cases = [(t, df) for df in (1.0, 2.7, 9.3, 57.0, 1234.5, 1e6) for t in (0.01, 0.7, 1.6, 1.9, 4.0, 7.4)] + [(20.0, 9.3), (1e6, 2.7)]
    table = spark.createDataFrame(cases, "t double, df double")
    for t, df, p in table.select("t", "df", runs.t_tail(F.col("t"), F.col("df"))).collect():
        assert p == pytest.approx(integrated_tail(t, df), rel=1e-10), (t, df)


def test_fingerprints_are_computed_by_all_cores(spark):
    ids = spark.range(2000).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("smiles"))
    table = encode.fingerprint_table(ids, "smiles")
    assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    kept = table.select("bits", augment.drop_bits(F.col("bits"), F.col("smiles"), 3, 0.3).alias("kept")).limit(50).collect()
    for r in kept:
        assert r["bits"] == sorted(set(r["bits"])) and r["kept"] == sorted(r["kept"])
        assert set(r["kept"]) <= set(r["bits"]) and len(r["kept"]) == len(r["bits"]) - int(len(r["bits"]) * 0.3)
