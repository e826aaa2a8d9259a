"""Prefix tries, whitening and quality rules against plain versions."""

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from triskel.llm import quality, trie, whitening

# ---------------------------------------------------------------- prefix trie

CHATS = "conv_id bigint, turn bigint, role string, text string, path string, n int"


def plain_trie(paths):
    """Nodes of {id: ((digest, words), ...)} by brute force."""
    members, ends, words = defaultdict(list), defaultdict(list), {(): 0}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                words[path[:d]] = path[d - 1][1]
        ends[path].append(c)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        children = [q for q in below if len(q) == len(p) + 1]
        saved = sum((len(members[q]) - 1) * words[q] for q in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        parent = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), parent, len(own), len(children), len(leaves), saved, sha))
    return sorted(out, key=str)


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def nodes_of(spark, chats):
    items = trie.turn_items(chats, "conv_id", "turn", "role", "text")
    found = trie.prefix_trie(items.select("conv_id", *trie.paths(F.col("items"))))
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, many_partitions, seed):
    rnd = random.Random(seed)
    texts = ["a b c", "a", "", None, "x y z"]
    rows, paths = [], {}
    for c in range(-20, 60):
        # Some long paths that many share, some equal ones, and prefixes of others.
        chosen = [rnd.choice(texts) for _ in range(rnd.choice((1, 1, 2, 3, 9)))] if rnd.random() < 0.7 else ["a b c", "a"] * rnd.choice((1, 6))
        rows += [(c, t, None if t % 3 == 2 else "user", x, "clash", 1) for t, x in enumerate(chosen)]
        paths[c] = tuple(((None if t % 3 == 2 else "user") or "", x or "", len(re.findall(trie.WORD, x or ""))) for t, x in enumerate(chosen))
    paths = {c: tuple(((r, x), w) for r, x, w in p) for c, p in paths.items()}
    rnd.shuffle(rows)
    chats = spark.createDataFrame(rows, CHATS).repartition(5)
    assert nodes_of(spark, chats) == plain_trie(paths)


def test_trie_of_odd_tables(spark, many_partitions):
    assert nodes_of(spark, spark.createDataFrame([], CHATS)) == []
    # A null id takes no part; a null number comes first; of one number the digests decide.
    rows = [(None, 0, "user", "x", "", 1), (1, 5, "user", "last", "", 1), (1, None, None, None, "", 1), (1, 5, "user", "last", "", 1)]
    found = nodes_of(spark, spark.createDataFrame(rows, CHATS))
    assert [r[:7] for r in sorted(found, key=lambda r: r[1])] == [(1, 0, None, 1, 1, 1, 0), (1, 1, 1, 1, 1, 1, 0), (1, 2, 1, 1, 1, 1, 0), (1, 3, 1, 1, 0, 1, 0)]


def test_a_path_that_thousands_share_and_a_long_one(spark, many_partitions):
    shared = [(c, t, "user", "same words here", "", 1) for c in range(3000) for t in range(2)]
    long = [(9000, t, "user", f"turn {t % 7}", "", 1) for t in range(5000)]
    found = nodes_of(spark, spark.createDataFrame(shared + long, CHATS))
    assert len(found) == 1 + 2 + 5000
    ends = hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    assert (0, 2, 0, 3000, 0, 1, 2999 * 3, ends) in found


def test_forest_of_a_partition_by_hand():
    # Paths ab, abc, abd, b.
    t = {k: hashlib.md5(k.encode()).digest() for k in "abcd"}
    paths = sorted(b"".join(t[k] for k in p) for p in ("ab", "abc", "abd", "b"))
    lcp = [0] + [trie.common_turns(a, b) for a, b in zip(paths, paths[1:], strict=False)]
    forest = trie.Forest([len(p) // 16 for p in paths], lcp, [1, 2, 3, 4], [1] * 4)
    assert forest.n[forest.top] == 4
    assert sorted(len(c) for c in forest.children if c) == [2, 2]


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id bigint, embedding array<float>, id string, x int, n double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1, 2.0) for i, v in rows], VECTORS).repartition(3)


def polynomial_by_fractions(a):
    """Faddeev and LeVerrier's recurrence in exact numbers, lowest first."""
    d = len(a)
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        am = [[sum(a[i][t] * m[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(am[i][i] for i in range(d)) / k)
    return [int(v) for v in reversed(out)]


@pytest.mark.parametrize("rank", [6, 3])
def test_characteristic_polynomial_is_exact(spark, rank):
    rnd = random.Random(rank)
    b = [[rnd.randint(-9999, 9999) for _ in range(6)] for _ in range(rank)]
    a = [[sum(r[i] * r[j] for r in b) for j in range(6)] for i in range(6)]
    assert whitening.characteristic_polynomial(spark, a) == polynomial_by_fractions(a)


def test_roots_are_counted_with_multiplicity():
    # (x - 5)^2 (x - 2) x (x - 1000003)
    poly = [1]
    for r in (5, 5, 2, 0, 1_000_003):
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    found = [(round(p / 2**b, 9), m) for p, b, m in whitening.real_roots(poly, 5)]
    assert found == [(1_000_003.0, 1), (5.0, 2), (2.0, 1)]
    assert [m for _, _, m in whitening.real_roots(poly, 2)] == [1, 2]


def test_products_are_exact_for_any_long():
    rnd = np.random.default_rng(1)
    y = rnd.integers(-(2**62), 2**62, (50, 3))
    want = y.astype(object).T @ y.astype(object)
    assert (whitening.exact_products(y) == want).all()


def whitened(spark, rows, k=32):
    found = whitening.whiten(vectors(spark, rows), "vec_id", "embedding", k).collect()
    return {r["id"]: r for r in found}


def test_whitening_equals_a_plain_decomposition(spark):
    rnd = np.random.default_rng(0)
    mixed = (rnd.normal(size=(300, 8)) @ rnd.normal(size=(8, 8))).astype(np.float32)
    found = whitened(spark, list(enumerate(mixed.tolist())), 5)
    x = np.floor(64.0 * mixed.astype(float)) + 1_000_000
    centred = x - x.mean(axis=0)
    values, parts = np.linalg.eigh(centred.T @ centred / len(x))
    values, parts = values[::-1], parts[:, ::-1]
    want = centred @ parts[:, :5] / np.sqrt(values[:5])
    got = np.array([found[i]["whitened"] for i in range(300)])
    for k in range(5):
        assert min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-9
    assert np.allclose(found[0]["explained"], values[:5] / values.sum(), rtol=1e-12)
    sums = x.astype(int).sum(axis=0)
    assert [found[i]["deviation"] for i in range(300)] == [sum((300 * int(v) - int(s)) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert found[0]["n"] == 300 and found[0]["identity_error"] < 1e-9


def test_close_and_equal_eigenvalues_give_orthonormal_vectors(spark):
    # A cross polytope has one eigenvalue, as often as dimensions; a tilt makes some all but equal.
    rows = [(2 * i + s, [float((1 - 2 * s) * (k == i)) for k in range(6)]) for i in range(6) for s in range(2)]
    found = whitened(spark, rows)
    assert len(found[0]["whitened"]) == 6 and found[0]["identity_error"] < 1e-9
    a = [[10**9 * (i == j) + (i == j == 3) for j in range(4)] for i in range(4)]
    parts = whitening.principal_components(spark, a, 1, 4)
    v = np.array([p[2] for p in parts])
    assert np.abs(v @ v.T - np.eye(4)).max() < 1e-14
    assert abs(v[0][3]) == 1.0 and parts[0][0] == 10**9 + 1


def test_whitening_of_odd_tables(spark):
    assert whitened(spark, []) == {}
    assert whitened(spark, [(1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (5, [])]) == {}
    one = whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])])
    assert sorted(one) == [1, 2] and one[1]["whitened"] == [] and one[1]["deviation"] == 0
    # Entries up to 2^55: products and sums stay exact, the deviation does not fit.
    far = whitened(spark, [(1, [2.0**55, 0.0]), (2, [-(2.0**55), 1.0]), (3, [0.0, 3.0]), (None, [3.0e38, 0.0])])
    assert sorted(far) == [1, 2, 3] and far[1]["deviation"] is None and far[1]["identity_error"] < 1e-4


# ---------------------------------------------------------------- quality rules

DOCS = "doc_id bigint, text string, lang string, n_words int, kept string"
LABELS = "doc_id bigint, quality int, toxic int"


def plain_counts(text):
    text = text or ""
    words = re.findall(quality.WORD, text)
    lines = [line for line in text.split("\n") if re.search(quality.WORD, line)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    places = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places)


def test_counts_equal_a_plain_count(spark):
    rnd = random.Random(5)
    parts = ["a", "b", "ab", "é#", "\n", "\x0b", "\x85", " ", " ", "<>|", "a b a b a", "\r\n", "😀*"]
    texts = [None, "", " ", "a", "a b", "a b c a b c", "x " * 30_000, "\n\n"]
    texts += ["".join(rnd.choice(parts) + rnd.choice(("", " ", "\n")) for _ in range(rnd.choice((3, 20, 300)))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, None, 7, "clash") for i, t in enumerate(texts)], DOCS).repartition(3)
    rows = quality.measure_quality(docs, "text", {"doc_id": F.col("doc_id")}).collect()
    for r in rows:
        assert tuple(r[c] for c in quality.COUNTS) == plain_counts(texts[r["doc_id"]]), texts[r["doc_id"]]
        n, again = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n)
    assert len(rows) == len(texts)


def plain_allowed(n, share, level):
    total, best = 0.0, -1
    for k in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share))
        if total > level:
            return best
        best = k
    return best


def test_allowed_rejections_are_the_exact_bound(spark):
    cases = [(n, s, d) for n in (0, 1, 50, 500, 5000, 100_000) for s in (0.0005, 0.01, 0.2) for d in (0.05, 0.002, 1e-9)]
    rows = spark.createDataFrame(cases, "n bigint, s double, d double")
    for n, s, d, got in rows.select("n", "s", "d", quality.rejections_allowed(F.col("n"), F.col("s"), F.col("d"))).collect():
        assert got == (plain_allowed(n, s, d) if n else -1), (n, s, d)


def certified(spark, rows, marks):
    docs = spark.createDataFrame([(i, t, lang, 7, "clash") for i, t, lang in rows], DOCS).repartition(4)
    measured = quality.measure_quality(docs, "text", {"doc_id": F.col("doc_id"), "lang": F.col("lang")})
    cutoffs = quality.fit_cutoffs(measured, spark.createDataFrame(marks, LABELS), "doc_id", "lang", "quality")
    return measured, cutoffs


def test_cutoffs_keep_the_limit_in_every_stratum(spark):
    rnd = random.Random(2)
    rows, marks = [], []
    for i in range(6000):
        bad, lang = rnd.random() < 0.2, rnd.choice(("en", "en", None))
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(60)]
        if bad:
            words = [w + "$$" if rnd.random() < 0.7 else w for w in words]
        elif rnd.random() < 0.05:
            words[0] += "#" * rnd.randint(1, 9)
        rows.append((i, " ".join(words), lang))
        marks.append((i, int(not bad), 0))
    measured, cutoffs = certified(spark, rows, marks)
    found = {(r["stratum"], r["rule"]): r["cutoff"] for r in cutoffs.collect()}
    assert {lang for lang, rule in found if rule == "symbols"} == {"en", None}
    judged = quality.judge(measured, cutoffs, "lang").collect()
    assert len(judged) == 6000
    for lang in ("en", None):
        mine = [(marks[r["doc_id"]][1], r["kept"]) for r in judged if r["lang"] == lang]
        good, poor = [k for q, k in mine if q == 1], [k for q, k in mine if q == 0]
        assert good.count(False) <= quality.LIMIT * len(good)
        assert poor.count(True) <= 0.02 * len(poor)


def test_no_certificate_without_enough_labels(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en"), (2, None, None), (None, text + " #", "en"), (1, text, "en")]
    for marks in ([], [(1, 1, 0), (1, 0, 0), (None, 0, 0), (2, None, 1)]):
        measured, cutoffs = certified(spark, rows, marks)
        assert cutoffs.isEmpty()
        kept = quality.judge(measured, cutoffs, "lang").select("doc_id", "kept").collect()
        assert sorted((str(i), k) for i, k in kept) == [("1", True), ("1", True), ("2", False), ("None", True)]
    measured, cutoffs = certified(spark, [], [])
    assert quality.judge(measured, cutoffs, "lang").isEmpty()


def test_quality_query_has_no_python(spark):
    import __spark_entry__ as entry_point

    plan = entry_point.queries()["op13_quality_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
