"""The comparison flow: run log to summary, tests and result tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from triskel.operators.runs import (
    CONFIG_ORDER,
    PRIMARY_METRIC,
    comparison_table,
    summarise,
    wanted_metric,
    welch_tests,
)
from triskel.sources.tables import runs_long


@dataclass
class Comparison:
    summary: DataFrame
    tests: DataFrame
    comparison: DataFrame


def compare_runs(
    runs: DataFrame,
    treated: str = "T1",
    baselines: Sequence[str] = ("B4", "B5", "B6"),
    metric: str = PRIMARY_METRIC,
    order: Sequence[str] = CONFIG_ORDER,
) -> Comparison:
    """Mean and deviation per configuration and metric, Welch tests of one
    configuration against the baselines, and the joined table."""
    long = runs_long(runs)
    summary = summarise(long.where(wanted_metric(long["metric"])), order)
    tests = welch_tests(long, treated, baselines, metric)
    return Comparison(summary, tests, comparison_table(summary, tests, metric))
