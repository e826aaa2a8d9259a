"""Quality rules whose cutoffs come with a guarantee, in DataFrame functions only.

``measure_quality`` counts words, symbols, repeated lines and repeated three-word windows
of each whole text and turns them into rules: whole numbers from 0 to 10,000, higher for
worse. ``fit_cutoffs`` picks a cutoff for each rule and stratum from labelled texts:

* A quarter of the texts (by digest) tunes. A rule is used in a stratum if, where it would
  reject its part of the limit of the good texts, it rejects a fifth of the bad ones: few
  tests leave each a larger part of the limit and of the error.
* The others are held out. Of its n good texts a cutoff may reject k, where k is the
  largest number with P(Binomial(n, a) <= k) <= d. Whatever the distribution of the rule,
  more than a share ``a`` of good texts is then rejected with probability ``d`` at most
  (the exact bound of Clopper and Pearson, read at an order statistic). ``a`` is the
  stratum's limit over its rules in use, so that all rules together keep the limit; ``d``
  is the error over the number of tests in all strata (Bonferroni).

The guarantee takes the held-out good texts of a stratum as independent draws; copies of
a text in a stratum count once, as bad if any copy is.

Defined results: a null or empty text has no words and fails; a null stratum is a stratum;
a stratum with too few good held-out texts for any bound, or no label, rejects nothing by
rule; labels of null ids or null quality are not used; of several labels of one id the least
counts; an empty table gives an empty table. Output columns replace nothing: only the
columns asked for are kept beside them, and a clash of names is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triskel.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WHOLE = 10_000
LEAST_WORDS = 50
RULES = ("symbols", "repeated_lines", "repeated_words", "long_words", "short_words", "capitals")
LIMIT = 0.02  # of the good texts of a stratum
ERROR = 0.05  # chance that any limit of any stratum is broken
TUNED = "4"  # digests below tune, the others are held out
CAUGHT = 0.2  # share of the bad texts that a rule must reject to be worth a test
BROADCAST_STRATA = 50_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _removed(text: Column, pattern: str) -> Column:
    """Code points that matches of ``pattern`` take."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""
    last = F.size(words) - 3

    def at(i: Column) -> Column:
        return F.get(words, i)

    def hashed(i: Column) -> Column:
        return F.xxhash64(at(i), at(i + 1), at(i + 2))

    def count(order: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            a, b = F.get(order, i), F.get(order, j)
            equal = F.lit(True)
            for k in range(3):
                equal = equal & (at(a["i"] + k) == at(b["i"] + k))
            return F.coalesce((a["h"] == b["h"]) & equal, F.lit(False))

        hits = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(k, k - 1)) | ((k < last) & same(k, k + 1)))
        places = F.sort_array(F.transform(hits, lambda k: F.get(order, k)["i"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        covered = F.aggregate(
            places, none, lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end"))
        )
        return covered["n"]

    def ordered(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        # Most short texts repeat nothing, which a set tells without a sort.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(F.sort_array(pairs), count))

    return F.when(last < 1, 0).otherwise(_let(F.transform(F.sequence(F.lit(0), last), hashed), ordered))


def measure_quality(docs: DataFrame, text_col: str, keep: dict[str, Column]) -> DataFrame:
    """The columns of ``keep``, ``text_md5``, the counts and the rules of every text.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` are as their names say,
    ``base_failed`` is set below 50 words or where over half of the words lie in repeated
    windows. One narrow pass; a task holds one text at a time.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    seen = docs.select(
        *[c.alias(n) for n, c in keep.items()],
        F.md5(text.cast("binary")).alias("text_md5"),
        _let(
            F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeated_words(w).cast("bigint").alias("n_repeat_words")),
        ).alias("words"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("bigint").alias("word_chars"),
        _removed(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        _removed(text, r"\p{Lu}").cast("bigint").alias("capital_chars"),
        _let(
            lines,
            lambda found: F.struct(
                F.size(found).cast("bigint").alias("n"), (F.size(found) - F.size(F.array_distinct(found))).cast("bigint").alias("again")
            ),
        ).alias("lines"),
    )
    n_words, repeated = F.col("words.n_words"), F.col("words.n_repeat_words")

    def share(part: Column, of: Column) -> Column:
        return F.when(of > 0, F.floor(WHOLE * part / of)).otherwise(0).cast("int")

    length = F.when(n_words > 0, F.least(F.floor(100 * F.col("word_chars") / n_words), F.lit(WHOLE))).otherwise(0).cast("int")
    rules = {
        "symbols": share(F.col("n_symbols"), F.col("word_chars")),
        "repeated_lines": share(F.col("lines.again"), F.col("lines.n")),
        "repeated_words": share(repeated, n_words),
        "long_words": length,
        "short_words": F.when(n_words > 0, WHOLE - length).otherwise(0).cast("int"),
        "capitals": share(F.col("capital_chars"), F.col("word_chars")),
    }
    return seen.select(
        *keep,
        "text_md5",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.again").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        ((n_words < LEAST_WORDS) | (100 * repeated > 50 * n_words)).alias("base_failed"),
        *[rules[r].alias(r) for r in RULES],
    )


def rejections_allowed(n: Column, share: Column, level: Column) -> Column:
    """Largest k with P(Binomial(n, share) <= k) <= level, or -1. ``level`` at least 1e-20.

    The terms are added from twelve deviations below the mean (from 0 for a small mean), so
    that the work is a few roots of n; the first term is exact, or Stirling's with its error series.
    """
    n, share = n.cast("double"), share.cast("double")
    mean = n * share
    low = mean - 12 * F.sqrt(mean * (1 - share))
    first = F.when(low < 50, F.lit(0.0)).otherwise(F.floor(low).cast("double"))

    def series(x: Column) -> Column:
        return 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)

    def deviance(x: Column, m: Column) -> Column:
        return x * F.log(x / m) + m - x

    rest = n - first
    stirling = F.exp(
        series(n) - series(first) - series(rest) - deviance(first, mean) - deviance(rest, n * (1 - share))
    ) * F.sqrt(n / (2 * math.pi * first * rest))
    term = F.when(first == 0, F.exp(n * F.log1p(-share))).otherwise(stirling)
    start = F.struct(term.alias("term"), F.lit(0.0).alias("sum"), (first - 1).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        total = acc["sum"] + acc["term"]
        following = acc["term"] * (n - i) / (i + 1) * share / (1 - share)
        return F.struct(
            following.alias("term"), total.alias("sum"), F.when(total <= level, i.cast("double")).otherwise(acc["k"]).alias("k")
        )

    steps = F.sequence(first.cast("bigint"), F.ceil(mean).cast("bigint"))
    return F.when(n > 0, F.aggregate(steps, start, step)["k"]).otherwise(-1.0).cast("bigint")


def _tails(counts: DataFrame) -> DataFrame:
    """Beside each value of a rule, how many good and bad texts lie beyond it.

    ``counts`` has at most 10,001 rows a stratum and rule, so each window is bounded.
    """
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum", "rule")
    return counts.select(
        "stratum",
        "rule",
        "value",
        F.coalesce(F.sum("good").over(above), F.lit(0)).alias("good_beyond"),
        F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("bad_beyond"),
        F.sum("good").over(whole).alias("n_good"),
        F.sum("bad").over(whole).alias("n_bad"),
    )


def fit_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    id_col: str,
    stratum_col: str,
    quality_col: str,
    limit: float = LIMIT,
    error: float = ERROR,
) -> DataFrame:
    """``stratum, rule, cutoff`` (written): reject where the rule is above the cutoff.

    ``labels`` has ``id_col`` and ``quality_col`` (1 good, 0 bad). Texts and labels are
    reduced to counts by value before anything is gathered.
    """
    marked = labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull())
    marked = marked.groupBy(id_col).agg(F.min(quality_col).alias("quality"))
    texts = measured.select(id_col, F.col(stratum_col).alias("stratum"), "text_md5", *RULES).join(marked, id_col)
    texts = texts.groupBy("stratum", "text_md5", *RULES).agg(F.min("quality").alias("quality"))
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES]))
    held = F.substring("text_md5", 1, 1) >= TUNED
    good = F.col("quality") == 1

    def number(which: Column) -> Column:
        return F.coalesce(F.sum(which.cast("bigint")), F.lit(0))

    flat = texts.select("stratum", held.alias("held"), good.alias("is_good"), pairs.alias("p"))
    flat = flat.select("stratum", "held", "is_good", "p.rule", "p.value")
    counts = flat.groupBy("stratum", "rule", "value", "held").agg(
        number(F.col("is_good")).alias("good"), number(~F.col("is_good")).alias("bad")
    )
    counts = materialise(counts)

    # Rules in use, from the tuning part.
    part = limit / len(RULES)
    tuned = _tails(counts.where("NOT held")).where(F.col("good_beyond") <= F.floor(part * F.col("n_good")))
    tuned = tuned.groupBy("stratum", "rule").agg(F.max(F.try_divide("bad_beyond", "n_bad")).alias("caught"))
    used = tuned.where(F.col("caught") >= CAUGHT).select("stratum", "rule")
    used = materialise(used)
    tests = used.count()
    shares = used.groupBy("stratum").agg(F.count("*").alias("n_rules"))

    # Their cutoffs, from the part held out: at good texts' own values, so no grid is searched.
    tails = _tails(counts.where("held AND good > 0"))
    tails = tails.alias("t").join(
        used.alias("u"), F.col("t.stratum").eqNullSafe(F.col("u.stratum")) & (F.col("t.rule") == F.col("u.rule")), "left_semi"
    )
    tails = tails.alias("t").join(shares.alias("s"), F.col("t.stratum").eqNullSafe(F.col("s.stratum"))).select("t.*", "s.n_rules")
    sizes = tails.groupBy("stratum", "rule").agg(F.max("n_good").alias("n_good"), F.max("n_rules").alias("n_rules"))
    level = F.lit(error / max(tests, 1))
    sizes = sizes.select("stratum", "rule", rejections_allowed(F.col("n_good"), limit / F.col("n_rules"), level).alias("allowed"))
    met = tails.alias("t").join(
        sizes.alias("a"), F.col("t.stratum").eqNullSafe(F.col("a.stratum")) & (F.col("t.rule") == F.col("a.rule"))
    )
    met = met.where(F.col("good_beyond") <= F.col("allowed")).groupBy("t.stratum", "t.rule").agg(F.min("value").alias("cutoff"))
    return materialise(met.select("stratum", "rule", "cutoff"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum_col: str) -> DataFrame:
    """``measured`` with ``kept``: no base failure and no rule above its stratum's cutoff."""
    rows = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in RULES])
    rows = rows.withColumnRenamed("stratum", "cutoff_stratum")
    if rows.count() <= BROADCAST_STRATA:  # else Spark shuffles both
        rows = F.broadcast(rows)
    joined = measured.join(rows, F.col(stratum_col).eqNullSafe(F.col("cutoff_stratum")), "left")
    kept = ~F.col("base_failed")
    for r in RULES:
        kept = kept & ~F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False))
    return joined.withColumn("kept", kept).select(*measured.columns, "kept")
