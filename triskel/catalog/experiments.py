"""Queries of run logs, significance tests, monitors and their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from triskel.catalog.base import query, table
from triskel.functions.numeric import rounded
from triskel.operators import joins, monitors, reports, runs
from triskel.plans.compare import compare_runs
from triskel.session import shared_folder
from triskel.sources import sinks, tables

# Event types stand for configurations; B0 keeps a single seed, so it has no deviation.
_CONFIG = (
    "CASE event_type WHEN 'signup' THEN 'T1' WHEN 'view' THEN 'B4' WHEN 'error' THEN 'B5' "
    "WHEN 'purchase' THEN 'B6' WHEN 'click' THEN 'B0' END"
)
_SEED = "CASE WHEN event_type = 'click' THEN 0 ELSE user_id % 5 END"
_BASE_SQL = f"""ev AS (SELECT {_CONFIG} AS config, {_SEED} AS seed, event_id, event_id % 60 + 1 AS epoch, value FROM events),
    runs AS (SELECT config, seed, avg(value) / 100 AS mean_r, max(value) / 500 AS val_loss, (max(event_id) % 60)::DOUBLE AS best_epoch,
      stddev_samp(value) / 100 AS align_mol_morph, CASE WHEN config <> 'B5' THEN -min(value) END AS uniform_mol
      FROM ev GROUP BY config, seed)"""
_LONG_SQL = """lr AS (
      SELECT config, seed, 'compound/mean_R@10' AS metric, mean_r AS value FROM runs
      UNION ALL SELECT config, seed, 'val_loss', val_loss FROM runs
      UNION ALL SELECT config, seed, 'best_epoch', best_epoch FROM runs
      UNION ALL SELECT config, seed, 'align_mol_morph', align_mol_morph FROM runs
      UNION ALL SELECT config, seed, 'uniform_mol', uniform_mol FROM runs WHERE uniform_mol IS NOT NULL)"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        f"{_CONFIG} AS config", f"{_SEED} AS seed", "event_id", "event_id % 60 + 1 AS epoch", "value"
    )


def _runs(spark, sf_dir):
    v = F.col("value")
    return (
        _events(spark, sf_dir)
        .groupBy("config", "seed")
        .agg(
            (F.avg(v) / 100).alias("compound/mean_R@10"),
            (F.max(v) / 500).alias("val_loss"),
            (F.max("event_id") % 60).cast("double").alias("best_epoch"),
            (F.stddev_samp(v) / 100).alias("align_mol_morph"),
            F.when(F.col("config") != "B5", -F.min(v)).alias("uniform_mol"),
        )
    )


def _logged(spark, sf_dir):
    """The runs appended to a JSONL log in two writes and read back."""
    path = f"{shared_folder(spark)}/runs.jsonl"
    rows = _runs(spark, sf_dir)
    sinks.append_runs(rows.where("seed < 3"), path)
    sinks.append_runs(rows.where("seed >= 3"), path)
    return tables.runs_long(tables.run_log(spark, path))


@query(
    "run_log_roundtrip",
    f"WITH {_BASE_SQL}, {_LONG_SQL} SELECT config, seed, metric, round(value, 6) + 0.0 AS value FROM lr",
)
def run_log_roundtrip(spark, sf_dir):
    return _logged(spark, sf_dir).withColumn("value", rounded(F.col("value")))


_SUMMARY_SQL = f"""{_BASE_SQL}, {_LONG_SQL},
    su AS (SELECT config, metric, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS count FROM lr GROUP BY 1, 2)"""


@query(
    "run_summary",
    f"""WITH {_SUMMARY_SQL} SELECT config, metric, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, count,
    CASE config WHEN 'B0' THEN 1 WHEN 'B4' THEN 5 WHEN 'B5' THEN 6 WHEN 'B6' THEN 7 WHEN 'T1' THEN 8 END::BIGINT AS rank FROM su""",
)
def run_summary(spark, sf_dir):
    s = runs.summarise(tables.runs_long(_runs(spark, sf_dir)))
    return s.select(
        "config", "metric", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), "count",
        F.col("rank").cast("bigint").alias("rank"),
    )


_METRICS = ["compound/mean_R@10", "val_loss", "best_epoch", "align_mol_morph", "uniform_mol"]


@query(
    "run_summary_table",
    f"""WITH {_SUMMARY_SQL}, c AS (SELECT config, metric, CASE WHEN std IS NULL THEN printf('%.4f', mean) ELSE printf('%.4f ± %.4f', mean, std) END AS cell FROM su)
    SELECT config, """
    + ", ".join(f"""max(cell) FILTER (metric = '{m}') AS "{m}" """ for m in _METRICS)
    + " FROM c GROUP BY config",
)
def run_summary_table(spark, sf_dir):
    return runs.summary_table(runs.summarise(tables.runs_long(_runs(spark, sf_dir))), _METRICS)


def _welch_sql(source: str, treated: str) -> str:
    """Moments to p, by the power series of the incomplete beta function; ``source`` is (config, value)."""

    def series(a: str, b: str, x: str) -> str:
        return f"""exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}))
          * (SELECT sum(exp(lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({x}))) FROM range(0, (4000 + 4 * df)::BIGINT) s(i))"""

    return f"""mo AS (SELECT config, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM {source} GROUP BY config HAVING count(*) >= 2),
    tt AS (SELECT b.config AS baseline, a.m AS m1, sqrt(a.v) AS s1, b.m AS m2, sqrt(b.v) AS s2,
        (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t_stat,
        (a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)) AS df
      FROM mo a JOIN mo b ON a.config = '{treated}' AND b.config IN ('B4', 'B5', 'B6')),
    tp AS (SELECT *, df / 2 AS a, 0.5::DOUBLE AS b, df / (df + t_stat ** 2) AS x, t_stat ** 2 / (df + t_stat ** 2) AS y FROM tt),
    pv AS (SELECT *, CASE WHEN t_stat ** 2 >= 12 THEN {series('a', 'b', 'x')} ELSE 1 - {series('b', 'a', 'y')} END AS p FROM tp)"""


_STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END"
_WELCH_COLS = f"""'T1 vs ' || baseline AS comparison, round(m1, 6) + 0.0 AS treated_mean, round(s1, 6) + 0.0 AS treated_std,
    round(m2, 6) + 0.0 AS baseline_mean, round(s2, 6) + 0.0 AS baseline_std, round(m1 - m2, 6) + 0.0 AS diff,
    round(t_stat, 6) + 0.0 AS t_stat, round(df, 4) + 0.0 AS df, round(p, 8) + 0.0 AS p_value, round(least(p * 3, 1), 8) + 0.0 AS p_corrected,
    least(p * 3, 1) < 0.05 AS significant, {_STARS} AS stars"""
_WELCH_DIGITS = {"df": 4, "p_value": 8, "p_corrected": 8}


def _round_tests(df):
    numeric = ["treated_mean", "treated_std", "baseline_mean", "baseline_std", "diff", "t_stat", "df", "p_value", "p_corrected"]
    return df.select(
        "comparison", *[rounded(F.col(c), _WELCH_DIGITS.get(c, 6)).alias(c) for c in numeric], "significant", "stars"
    )


@query(
    "welch_tests",
    f"""WITH {_BASE_SQL}, {_LONG_SQL}, src AS (SELECT config, value FROM lr WHERE metric = 'compound/mean_R@10'),
    {_welch_sql('src', 'T1')} SELECT {_WELCH_COLS} FROM pv""",
)
def welch_tests(spark, sf_dir):
    return _round_tests(runs.welch_tests(tables.runs_long(_runs(spark, sf_dir)), "T1", ["B4", "B5", "B6"]))


@query(
    "welch_tests_many_runs",
    f"WITH {_BASE_SQL}, {_welch_sql('ev', 'T1')} SELECT {_WELCH_COLS} FROM pv",
)
def welch_tests_many_runs(spark, sf_dir):
    """Every event is a run: large groups, moments combined map-side."""
    return _round_tests(runs.welch_tests(_events(spark, sf_dir), "T1", ["B4", "B5", "B6"], metric=None))


@query(
    "comparison_table",
    f"""WITH {_SUMMARY_SQL}, src AS (SELECT config, value FROM lr WHERE metric = 'compound/mean_R@10'), {_welch_sql('src', 'T1')}
    SELECT su.config, round(mean * 100, 6) + 0.0 AS mean_pct, round(std * 100, 6) + 0.0 AS std_pct, round(p, 8) + 0.0 AS p_value,
      coalesce(CASE WHEN p IS NOT NULL THEN {_STARS} END, '') AS stars
    FROM su LEFT JOIN pv ON pv.baseline = su.config WHERE metric = 'compound/mean_R@10'""",
)
def comparison_table(spark, sf_dir):
    out = compare_runs(_runs(spark, sf_dir)).comparison
    return out.select(
        "config", rounded(F.col("mean_pct")).alias("mean_pct"), rounded(F.col("std_pct")).alias("std_pct"),
        rounded(F.col("p_value"), 8).alias("p_value"), "stars",
    )


@query(
    "bar_table",
    f"""WITH {_SUMMARY_SQL} SELECT config, round(mean * 100, 6) + 0.0 AS mean_pct, round(coalesce(std, 0) * 100, 6) + 0.0 AS std_pct,
      round((SELECT 10.0::DOUBLE / count(DISTINCT user_id) FROM events) * 100, 6) + 0.0 AS random_pct FROM su WHERE metric = 'compound/mean_R@10'""",
)
def bar_table(spark, sf_dir):
    groups = table(spark, sf_dir, "events").agg(F.lit(10.0) / F.count_distinct("user_id")).scalar()
    bars = runs.bar_table(runs.summarise(tables.runs_long(_runs(spark, sf_dir))), groups)
    return bars.select("config", *[rounded(F.col(c)).alias(c) for c in ("mean_pct", "std_pct", "random_pct")])


def _matrix(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("config").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))


@query(
    "run_matrix",
    f"""WITH {_BASE_SQL} SELECT DISTINCT 'all' AS list, config, seed FROM ev
    UNION ALL SELECT DISTINCT 'chosen', config, s FROM ev, (SELECT unnest([42, 123]) AS s) WHERE config IN ('B4', 'T1')""",
)
def run_matrix(spark, sf_dir):
    matrix = _matrix(spark, sf_dir)
    full = runs.expand_runs(matrix).select(F.lit("all").alias("list"), "config", F.col("seed").cast("bigint").alias("seed"))
    chosen = runs.expand_runs(matrix, ["B4", "T1"], [42, 123])
    return full.unionByName(chosen.select(F.lit("chosen").alias("list"), "config", F.col("seed").cast("bigint").alias("seed")))


@query(
    "runs_left_to_do",
    f"WITH {_BASE_SQL} SELECT DISTINCT config, seed FROM ev WHERE (config, seed) NOT IN (SELECT (config, seed) FROM runs)",
)
def runs_left_to_do(spark, sf_dir):
    planned = runs.expand_runs(_matrix(spark, sf_dir)).select("config", "seed")
    return joins.not_yet_done(planned, _runs(spark, sf_dir), ["config", "seed"])


_EPOCH_SQL = f"""{_BASE_SQL},
    ep AS (SELECT config, seed, epoch, avg(value) AS v, avg(value / 50) AS vicreg_mol, avg(value) / 10 AS grad_norm, -avg(value) / 100 AS uniformity FROM ev GROUP BY 1, 2, 3)"""


def _epochs(spark, sf_dir):
    batches = _events(spark, sf_dir).select(
        "config", "seed", "epoch", F.col("value").alias("v"), (F.col("value") / 50).alias("vicreg_mol"),
        (F.col("value") / 10).alias("grad_norm"), (-F.col("value") / 100).alias("uniformity"),
    )
    return monitors.epoch_averages(batches, ["config", "seed"], ["v", "vicreg_mol", "grad_norm", "uniformity"])


@query(
    "epoch_averages",
    f"WITH {_EPOCH_SQL} SELECT config, seed, epoch, round(v, 9) + 0.0 AS v, round(vicreg_mol, 9) + 0.0 AS vicreg_mol, round(grad_norm, 9) + 0.0 AS grad_norm FROM ep",
)
def epoch_averages(spark, sf_dir):
    e = _epochs(spark, sf_dir)
    return e.select("config", "seed", "epoch", *[rounded(F.col(c), 9).alias(c) for c in ("v", "vicreg_mol", "grad_norm")])


_STOP_SQL = f"""{_EPOCH_SQL},
    s1 AS (SELECT *, row_number() OVER w AS pos, max(v) OVER (PARTITION BY config, seed ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
           FROM ep WINDOW w AS (PARTITION BY config, seed ORDER BY epoch)),
    s2 AS (SELECT *, (best IS NULL OR v > best) AS improved FROM s1),
    s3 AS (SELECT *, pos - coalesce(max(CASE WHEN improved THEN pos END) OVER (PARTITION BY config, seed ORDER BY epoch), 0) AS counter FROM s2),
    s4 AS (SELECT *, min(CASE WHEN counter >= 15 THEN epoch END) OVER (PARTITION BY config, seed) AS stop_epoch FROM s3),
    es AS (SELECT config, seed, any_value(stop_epoch) AS stop_epoch, max(epoch) FILTER (improved) AS best_epoch,
             arg_max(v, epoch) FILTER (improved) AS best_metric FROM s4 WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY 1, 2)"""


@query(
    "early_stopping",
    f"WITH {_STOP_SQL} SELECT config, seed, stop_epoch, best_epoch, round(best_metric, 9) + 0.0 AS best_metric FROM es",
)
def early_stopping(spark, sf_dir):
    out = monitors.early_stopping(_epochs(spark, sf_dir), ["config", "seed"], "v", patience=15)
    return out.withColumn("best_metric", rounded(F.col("best_metric"), 9))


@query(
    "persistent_high_loss",
    f"""WITH {_STOP_SQL},
    h1 AS (SELECT *, coalesce(vicreg_mol > 0.9, FALSE) AS hi FROM ep),
    h2 AS (SELECT *, sum((NOT hi)::INT) OVER (PARTITION BY config, seed ORDER BY epoch) AS g FROM h1),
    h3 AS (SELECT *, sum(hi::INT) OVER (PARTITION BY config, seed, g ORDER BY epoch) AS streak FROM h2)
    SELECT h3.config, h3.seed, h3.epoch, streak::BIGINT AS streak FROM h3 JOIN es USING (config, seed)
    WHERE hi AND streak >= 4 AND (es.stop_epoch IS NULL OR h3.epoch < es.stop_epoch)""",
)
def persistent_high_loss(spark, sf_dir):
    epochs = _epochs(spark, sf_dir)
    stops = monitors.early_stopping(epochs, ["config", "seed"], "v", patience=15)
    return monitors.persistent_high(epochs, ["config", "seed"], "vicreg_mol", threshold=0.9, epochs=4, stops=stops)


@query(
    "collapse_alerts",
    f"WITH {_EPOCH_SQL} SELECT config, seed, epoch, round(uniformity, 9) + 0.0 AS uniformity FROM ep WHERE uniformity > -0.5",
)
def collapse_alerts(spark, sf_dir):
    alerts = monitors.collapse_alerts(_epochs(spark, sf_dir))
    return alerts.select("config", "seed", "epoch", rounded(F.col("uniformity"), 9).alias("uniformity"))


@query(
    "explosion_alerts",
    f"WITH {_BASE_SQL} SELECT config, seed, event_id, value / 10 AS grad_norm FROM ev WHERE value / 10 > 10",
)
def explosion_alerts(spark, sf_dir):
    batches = _events(spark, sf_dir).select("config", "seed", "event_id", (F.col("value") / 10).alias("grad_norm"))
    return monitors.explosion_alerts(batches)


@query(
    "training_curves",
    f"""WITH {_EPOCH_SQL} SELECT config, seed, epoch, round(v / 100, 9) + 0.0 AS train_loss, round(vicreg_mol, 9) + 0.0 AS val_loss,
    round(CASE WHEN config <> 'B6' THEN grad_norm ELSE uniformity END, 9) + 0.0 AS r10 FROM ep""",
)
def training_curves(spark, sf_dir):
    history = _epochs(spark, sf_dir).select(
        "config", "seed", "epoch", (F.col("v") / 100).alias("loss_total"), F.col("vicreg_mol").alias("val_loss"),
        F.when(F.col("config") != "B6", F.col("grad_norm")).alias("compound/mean_R@10"),
        F.col("uniformity").alias("mean_R@10"),
    )
    curves = reports.training_curves(history, "compound/mean_R@10", "mean_R@10")
    return curves.select("config", "seed", "epoch", *[rounded(F.col(c), 9).alias(c) for c in ("train_loss", "val_loss", "r10")])


@query(
    "run_records",
    f"""WITH {_STOP_SQL}, {_LONG_SQL} SELECT es.config, es.seed, es.best_epoch, round(es.best_metric, 6) + 0.0 AS best_metric, lr.metric,
    round(lr.value, 6) + 0.0 AS value FROM es JOIN lr USING (config, seed)""",
)
def run_records(spark, sf_dir):
    """Per-run records written as JSON and read back."""
    best = monitors.early_stopping(_epochs(spark, sf_dir), ["config", "seed"], "v", patience=15)
    metrics = tables.runs_long(_runs(spark, sf_dir))
    path = f"{shared_folder(spark)}/records"
    sinks.write_records(sinks.run_record(best, metrics, ["config", "seed"]), path)
    back = spark.read.schema(
        "config string, seed bigint, best_epoch bigint, best_metric double, metrics string"
    ).json(path)
    parsed = back.select(
        "config", "seed", "best_epoch", "best_metric",
        F.explode(F.from_json("metrics", "map<string,double>")).alias("metric", "value"),
    )
    return parsed.withColumns({c: rounded(F.col(c)) for c in ("best_metric", "value")})
