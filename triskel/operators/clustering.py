"""Agreement of two labelings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triskel.functions.numeric import log_factorial
from triskel.session import materialise

TASK_TERMS = 1 << 21
MAX_TASKS = 16384


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n). The agreement scores read it several times: pass it through
    ``materialise`` first when ``df`` is expensive."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def _choose2(c):
    x = c.cast("double")
    return x * (x - 1.0) / 2.0


def adjusted_rand(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): 1.0 when both labelings are trivially equal."""
    left = cells.groupBy(a).agg(F.sum("n").alias("s")).agg(F.sum(_choose2(F.col("s")))).scalar()
    right = cells.groupBy(b).agg(F.sum("n").alias("s")).agg(F.sum(_choose2(F.col("s")))).scalar()
    both = cells.agg(
        F.sum(_choose2(F.col("n"))).alias("s"), _choose2(F.sum("n")).alias("pairs")
    ).withColumns({"a": left, "b": right})
    expected = F.coalesce(F.try_divide(F.col("a") * F.col("b"), F.col("pairs")), F.lit(0.0))
    top = (F.col("a") + F.col("b")) / 2.0 - expected
    return both.select(
        F.when(top == 0.0, 1.0).otherwise(F.try_divide(F.col("s") - expected, top)).alias("ari")
    )


def _reach(size: Column) -> Column:
    """How far from the mean a term of a cell with this smaller margin may differ from zero."""
    return F.sqrt(size * (746.0 + F.log(2.0 * (size + 1.0))) / 2.0) + 2.0


def product_tasks(left: tuple[int, int], right: tuple[int, int], terms: int = TASK_TERMS) -> tuple[int, int]:
    """Tiles of two margins, given the number of sizes and the sum of terms of each; so many that
    a tile pair has some ``terms`` terms, in proportion to the margins' numbers of sizes."""
    (n, reach_n), (m, reach_m) = left, right
    if not (n and m):
        return 1, 1
    total = min(n * reach_m, m * reach_n)  # a term sum is bounded by either margin
    tasks = min(max(1, math.ceil(total / terms)), MAX_TASKS, n * m)
    tall = min(n, max(1, round(math.sqrt(tasks * n / max(m, 1)))))
    return tall, min(m, math.ceil(tasks / tall))


def _tiled(margin: DataFrame, size: str, tiles: int, tile: str) -> DataFrame:
    """Runs of sizes with about as many terms each. Sizes are distinct, at most some sqrt(2 n) of them."""
    order = Window.partitionBy(F.lit(0)).orderBy(size)
    before = F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_w")
    whole = F.sum("_w").over(Window.partitionBy(F.lit(0)))
    at = F.least(F.floor(before / whole * tiles), F.lit(tiles - 1)).cast("int")
    return margin.withColumn("_w", _reach(F.col(size).cast("double"))).withColumn(tile, at).drop("_w")


def _product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every combination of the sizes of two margins (``sa`` and ``sb``), as an equi-join on tile pairs.

    The number of tile pairs, which is that of tasks, follows the number of terms.
    """

    def facts(margin: DataFrame, size: str) -> tuple[int, int]:
        row = margin.agg(F.count(F.lit(1)), F.coalesce(F.sum(2 * _reach(F.col(size).cast("double"))), F.lit(0.0))).first()
        return row[0], math.ceil(row[1])

    tall, wide = product_tasks(facts(left, "sa"), facts(right, "sb"))
    l = _tiled(left, "sa", tall, "_i").withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    r = _tiled(right, "sb", wide, "_j").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(tall - 1))))
    pair = (F.col("_i") * wide + F.col("_j")).alias("_pair")
    l = l.select("*", pair).repartition(tall * wide, "_pair").drop("_i", "_j")
    return l.join(r.select("*", pair).drop("_i", "_j"), "_pair").drop("_pair")


def expected_information(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(emi): expected mutual information of the hypergeometric model.

    It depends on margin sizes only, so equal sizes are counted once. With s the smaller
    margin, a term r from the mean weighs at most 2(s+1)exp(-2r²/s) of the largest one
    (Hoeffding; the largest is at least 1/(s+1) of all). Beyond the ``reach`` below that is
    under exp(-746), which is 0 in double precision: leaving those terms out changes no
    bit of the sum, and a cell costs O(sqrt(size)) terms. Weights are relative to the mode,
    which has a closed form, and normalised per cell, which cancels the rounding of large
    factorials; the sum is one aggregate without a window.
    """
    n = cells.agg(F.sum("n")).scalar()

    def sizes(col: str, name: str) -> DataFrame:
        margin = cells.groupBy(col).agg(F.sum("n").alias(name))
        return margin.groupBy(name).agg(F.count(F.lit(1)).alias(f"m_{name}"))

    combos = _product(materialise(sizes(a, "sa")), materialise(sizes(b, "sb"))).withColumn("n", n)
    sa, sb, total = F.col("sa"), F.col("sb"), F.col("n")
    mean = sa.cast("double") * sb / total
    small = F.least(sa, sb).cast("double")
    reach = _reach(small)
    low = F.greatest(F.lit(0), sa + sb - total, F.floor(mean - reach))
    high = F.least(sa, sb, F.ceil(mean + reach))
    terms = combos.withColumn("k", F.explode(F.sequence(low, high)))
    k = F.col("k")
    # Factors that hang on the margins alone cancel when a cell is normalised.
    def log_weight(x):
        return -(log_factorial(x) + log_factorial(sa - x) + log_factorial(sb - x) + log_factorial(total - sa - sb + x))

    mode = F.floor((sa + 1).cast("double") * (sb + 1) / (total + 2))
    terms = terms.withColumn("_mode", F.least(F.greatest(mode, F.lit(0), sa + sb - total), sa, sb))
    weight = F.exp(log_weight(k) - log_weight(F.col("_mode")))
    ratio = k.cast("double") * total / (sa.cast("double") * sb)
    gain = F.when(k > 0, k / total * F.log(ratio)).otherwise(0.0)
    per_cell = terms.select("sa", "sb", "m_sa", "m_sb", weight.alias("w"), gain.alias("g")).groupBy(
        "sa", "sb", "m_sa", "m_sb"
    ).agg((F.sum(F.col("w") * F.col("g")) / F.sum("w")).alias("e"))
    return per_cell.agg(F.sum(F.col("e") * F.col("m_sa") * F.col("m_sb")).alias("emi"))


def adjusted_mutual_information(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(ami), arithmetic average of the entropies; 1.0 for two one-class labelings.

    Mutual information and both entropies are sums of n*ln(.) over the cells plus
    ln of the total, so one aggregation yields them all.
    """
    n = F.col("n")
    joint = cells.select(
        a,
        b,
        n.cast("double").alias("n"),
        F.sum("n").over(Window.partitionBy(a)).cast("double").alias("sa"),
        F.sum("n").over(Window.partitionBy(b)).cast("double").alias("sb"),
    )
    sums = joint.agg(
        F.sum("n").alias("t"),
        F.sum(n * F.log("n")).alias("ln"),
        F.sum(n * F.log("sa")).alias("la"),
        F.sum(n * F.log("sb")).alias("lb"),
        (F.min(a) == F.max(a)).alias("one_a"),
        (F.min(b) == F.max(b)).alias("one_b"),
    ).withColumn("emi", expected_information(cells, a, b).scalar())
    t, la, lb = F.col("t"), F.col("la"), F.col("lb")
    mi = (F.col("ln") - la - lb) / t + F.log(t)
    top = F.log(t) - (la + lb) / (2.0 * t) - F.col("emi")
    eps = 2.220446049250313e-16
    safe = F.when(top < 0, F.least(top, F.lit(-eps))).otherwise(F.greatest(top, F.lit(eps)))
    return sums.select(
        F.when(F.col("one_a") & F.col("one_b"), 1.0).otherwise((mi - F.col("emi")) / safe).alias("ami")
    )
