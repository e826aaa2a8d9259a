"""Run matrices, summaries over seeds and significance tests."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triskel.functions.text import mean_std_text, stars

# Display order of configurations, and the metrics of the summary.
CONFIG_ORDER = ("B0", "B1", "B2", "B3", "B4", "B5", "B6", "T1")
KEY_METRICS = (
    "compound/mean_R@10",
    "compound/mol->morph/R@10",
    "compound/morph->mol/R@10",
    "compound/mol->expr/R@10",
    "compound/expr->mol/R@10",
    "compound/morph->expr/R@10",
    "compound/expr->morph/R@10",
    "mean_R@10",
    "best_epoch",
    "val_loss",
)
PRIMARY_METRIC = "compound/mean_R@10"
# gamma(a + 1/2) / (gamma(a) sqrt(a)) as a series in 1/a.
RATIO_SERIES = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)


def matrix_table(spark: SparkSession, configs: Mapping[str, Mapping]) -> DataFrame:
    """(config, name, description, model, seeds) from a run-matrix mapping."""
    rows = [
        (c, d["name"], d.get("description", ""), d.get("model"), list(d["seeds"]))
        for c, d in configs.items()
    ]
    return spark.createDataFrame(
        rows, "config string, name string, description string, model string, seeds array<int>"
    )


def expand_runs(
    matrix: DataFrame, configs: Sequence[str] | None = None, seeds: Sequence[int] | None = None
) -> DataFrame:
    """One row per (config, seed), with optional config filter and seed override."""
    df = matrix.where(F.col("config").isin(*configs)) if configs else matrix
    chosen = F.array(*[F.lit(s) for s in seeds]) if seeds else F.col("seeds")
    return df.withColumn("seed", F.explode(chosen)).drop("seeds")


def config_rank(c: Column, order: Sequence[str] = CONFIG_ORDER) -> Column:
    """Position in the display order; NULL for a configuration not listed."""
    return F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), c), F.lit(0))


def wanted_metric(metric: Column) -> Column:
    return metric.isin(*KEY_METRICS) | metric.startswith("align_") | metric.startswith("uniform_")


def summarise(long: DataFrame, order: Sequence[str] | None = CONFIG_ORDER) -> DataFrame:
    """(config, metric, mean, std, count) over runs; std is NULL for a single run.
    With ``order``, only listed configurations are kept, and ranked for display."""
    stats = long.where(F.col("value").isNotNull()).groupBy("config", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count("value").alias("count"),
    )
    if order is None:
        return stats
    ranked = stats.withColumn("rank", config_rank(F.col("config"), order))
    return ranked.where(F.col("rank").isNotNull())


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): moved up by 24, where its series in 1/a is exact to rounding."""
    up = F.aggregate(F.sequence(F.lit(0), F.lit(23)), F.lit(1.0), lambda acc, i: acc * (a + i) / (a + i + 0.5))
    r = 1.0 / (a + 24.0)
    series = F.lit(0.0)
    for c in reversed(RATIO_SERIES):
        series = series * r + c
    return up * F.sqrt(a + 24.0) * series


def _beta_fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """Continued fraction of the incomplete beta integral (modified Lentz), two terms a step.

    It converges in some sqrt(max(a, b)) steps for x below (a + 1) / (a + b + 2); steps beyond change nothing.
    """

    def kept(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def term(acc: Column, value: Column) -> Column:
        d, c = 1.0 / kept(1.0 + value * acc["d"]), kept(1.0 + value / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1.0 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1.0 + 2 * m))
        # Held in an array, so that the first of the two terms is computed once.
        return F.get(F.transform(F.array(term(acc, even)), lambda half: term(half, odd)), F.lit(0))

    first = 1.0 / kept(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), steps), lambda m: m.cast("double")), start, step)["h"]


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t: the regularised incomplete beta function I_x(df/2, 1/2) at
    x = df / (df + t²), or one minus its mirror image where that converges fast."""
    a, half = df / 2.0, F.lit(0.5)
    u = t * t / df
    x, y = 1.0 / (1.0 + u), u / (1.0 + u)
    # x^a y^(1/2) / B(a, 1/2), with ln x = -ln(1 + u) free of cancellation.
    front = F.exp(-a * F.log1p(u)) * F.sqrt(y) * _gamma_ratio(a) / math.sqrt(math.pi)
    steps = (F.lit(60) + 4 * F.ceil(F.sqrt(a))).cast("int")
    tail = front / a * _beta_fraction(a, half, x, steps)
    rest = 1.0 - front / 0.5 * _beta_fraction(half, a, y, steps)
    # For many degrees of freedom x is rounded near 1, so the mirror image serves for all but small p.
    mirrored = (x >= (a + 1.0) / (a + 2.5)) | ((df > 100.0) & (t * t < 12.0))
    return F.when(mirrored, rest).otherwise(tail)


def welch_tests(
    long: DataFrame,
    treated: str,
    baselines: Sequence[str],
    metric: str | None = PRIMARY_METRIC,
    factor: int = 3,
    alpha: float = 0.05,
) -> DataFrame:
    """One configuration against each baseline: t, df, p, Bonferroni-corrected p,
    significance and stars. A side with fewer than two runs is skipped.

    Only one row of moments per configuration meets in the join.
    """
    rows = long if metric is None else long.where(F.col("metric") == metric)
    moments = (
        rows.where(F.col("value").isNotNull() & F.col("config").isin(treated, *baselines))
        .groupBy("config")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("m"),
            F.var_samp("value").alias("v"),
        )
        .where("n >= 2")
    )
    a = moments.where(F.col("config") == treated).select(
        F.lit("vs").alias("_k"), *[F.col(c).alias(f"{c}1") for c in ("n", "m", "v")]
    )
    b = moments.where(F.col("config").isin(*baselines)).select(
        F.when(F.col("config").isNotNull(), "vs").alias("_k"),
        F.col("config").alias("baseline"),
        *[F.col(c).alias(f"{c}2") for c in ("n", "m", "v")],
    )
    joined = b.join(F.broadcast(a), "_k").drop("_k")
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(e1 + e2))
    df = F.try_divide(
        (e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1)
    )
    out = joined.withColumn("t_stat", t).withColumn("df", df)
    out = out.withColumn("p_value", t_tail(F.col("t_stat"), F.col("df")))
    out = out.withColumn("p_corrected", F.least(F.col("p_value") * float(factor), F.lit(1.0)))
    return out.select(
        F.concat(F.lit(f"{treated} vs "), F.col("baseline")).alias("comparison"),
        "baseline",
        F.col("m1").alias("treated_mean"),
        F.sqrt("v1").alias("treated_std"),
        F.col("m2").alias("baseline_mean"),
        F.sqrt("v2").alias("baseline_std"),
        (F.col("m1") - F.col("m2")).alias("diff"),
        "t_stat",
        "df",
        "p_value",
        "p_corrected",
        (F.col("p_corrected") < alpha).alias("significant"),
        stars(F.col("p_value")).alias("stars"),
    )


def summary_table(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Config by metric with 'mean ± std' cells, in display order."""
    cells = summary.withColumn("cell", mean_std_text(F.col("mean"), F.col("std")))
    return cells.groupBy("config").pivot("metric", list(metrics)).agg(F.first("cell"))


def comparison_table(summary: DataFrame, tests: DataFrame, metric: str = PRIMARY_METRIC) -> DataFrame:
    """Per config: mean and std in percent, p and stars where tested."""
    rows = summary.where(F.col("metric") == metric)
    tested = tests.select(F.col("baseline").alias("config"), "p_value", "stars")
    return rows.join(tested, "config", "left").select(
        "config",
        (F.col("mean") * 100.0).alias("mean_pct"),
        (F.col("std") * 100.0).alias("std_pct"),
        "p_value",
        F.coalesce("stars", F.lit("")).alias("stars"),
    )


def bar_table(summary: DataFrame, reference: Column, metric: str = PRIMARY_METRIC) -> DataFrame:
    """Per config: mean and std in percent (0 for one run), and the random line."""
    return summary.where(F.col("metric") == metric).select(
        "config",
        (F.col("mean") * 100.0).alias("mean_pct"),
        F.coalesce(F.col("std") * 100.0, F.lit(0.0)).alias("std_pct"),
        (reference * 100.0).alias("random_pct"),
    )
