"""Retrieval ranks, Recall@K, MRR, alignment and uniformity."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triskel.functions.vectors import ordered_modalities, squared_distance
from triskel.operators.tiles import (
    column_counts,
    key_type,
    matrix,
    products,
    row_counts,
    same_keys,
    strip_scan,
    tile_count,
    triangle_tasks,
    values,
)

KS = (1, 5, 10)
# Similarities this close count as tied: it covers the rounding of a double dot
# product, so equal vectors tie whichever tile computed them.
TIE = 1e-12


def pairs(modalities: Sequence[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(ordered_modalities(modalities), 2))


def directions(modalities: Sequence[str]) -> list[tuple[str, str]]:
    return list(itertools.permutations(ordered_modalities(modalities), 2))


def _kernel(key_name: str, pair_list, uniform_mods):
    """Counts of one held tile against a strip of tiles.

    A pair of tiles is met once: products with a later tile serve the rows of both, in
    both directions of a modality pair; the held tile with itself covers all its pairs.
    """
    ge_names = [f"ge_{a}_{b}" for a, b in pair_list] + [f"ge_{b}_{a}" for a, b in pair_list]
    pot_names = [f"pot_{m}" for m in uniform_mods]
    mods = sorted({m for p in pair_list for m in p} | set(uniform_mods))

    def sides(table: pa.Table):
        m = {name: matrix(table, name) for name in mods}
        need = {(a, b): np.einsum("ij,ij->i", m[a], m[b]) - TIE for a, b in pair_list}
        return m, need, {n: np.zeros(len(table), np.int64) for n in ge_names} | {n: np.zeros(len(table)) for n in pot_names}

    def out_table(table: pa.Table, sums) -> pa.Table:
        return pa.table({key_name: table.column(key_name)} | {n: pa.array(sums[n]) for n in ge_names + pot_names})

    def run(tile: int, held: pa.Table, streamed) -> Iterator[pa.Table]:
        qm, need_q, out_q = sides(held)
        for other, table in streamed:
            later = other != tile
            cm, need_c, out_c = sides(table)
            for a, b in [d for a, b in pair_list for d in ((a, b), (b, a))]:
                own = need_q.get((a, b), need_q.get((b, a)))
                theirs = need_c.get((a, b), need_c.get((b, a)))
                for s, c, sim in products(qm[a], cm[b]):
                    out_q[f"ge_{a}_{b}"][s] += row_counts(sim >= own[s, None])
                    if later:
                        out_c[f"ge_{b}_{a}"][c] += column_counts(sim >= theirs[None, c])
            if pot_names and not later:
                codes_q, codes_c = same_keys(values(held, key_name), values(table, key_name))
            for m in uniform_mods:
                # -2 d2 = 4 q.c - 2 q.q - 2 c.c in one product.
                sq_q = np.einsum("ij,ij->i", qm[m], qm[m])
                sq_c = np.einsum("ij,ij->i", cm[m], cm[m])
                left = np.column_stack([4.0 * qm[m], -2.0 * sq_q, np.ones(len(sq_q))])
                right = np.column_stack([cm[m], np.ones(len(sq_c)), -2.0 * sq_c])
                for s, c, pot in products(left, right):
                    np.exp(np.minimum(pot, 0.0, out=pot), out=pot)
                    if not later:
                        pot[codes_q[s, None] == codes_c[None, c]] = 0.0
                    out_q[f"pot_{m}"][s] += pot.sum(axis=1)
                    if later:
                        out_c[f"pot_{m}"][c] += pot.sum(axis=0)
            if later:
                yield out_table(table, out_c)
        yield out_table(held, out_q)

    return run


def row_statistics(
    wide: DataFrame,
    key: str,
    modalities: Sequence[str],
    uniform: bool = True,
    tiles: int | None = None,
    retrieval: bool = True,
) -> DataFrame:
    """Per row: ``ge_a_b`` = rank of its own b-vector among all b-vectors for query a
    (pessimistic on ties, 1-based), and ``pot_m`` = sum over the other rows of
    exp(-2 d²). One pass over the tiles yields every direction and modality."""
    mods = ordered_modalities(modalities)
    pair_list = pairs(mods) if retrieval else []
    uniform_mods = mods if uniform else []
    n_tiles = tile_count(wide, tiles)
    kind = key_type(wide, key)
    names = [f"ge_{a}_{b}" for a, b in pair_list] + [f"ge_{b}_{a}" for a, b in pair_list]
    schema = ", ".join(
        [f"{key} {kind}"]
        + [f"{n} bigint" for n in names]
        + [f"pot_{m} double" for m in uniform_mods]
    )
    held, streamed, tasks = triangle_tasks(wide.select(key, *mods), key, n_tiles)
    partial = strip_scan(held, streamed, _kernel(key, pair_list, uniform_mods), schema, tasks, mods)
    sums = [F.sum(n).alias(n) for n in names + [f"pot_{m}" for m in uniform_mods]]
    return partial.groupBy(key).agg(*sums)


def ranks_long(stats: DataFrame, key: str, modalities: Sequence[str]) -> DataFrame:
    """(key, direction, rank)."""
    named = [
        F.struct(F.lit(f"{a}->{b}").alias("direction"), F.col(f"ge_{a}_{b}").alias("rank"))
        for a, b in directions(modalities)
    ]
    return stats.select(key, F.explode(F.array(*named)).alias("d")).select(
        key, "d.direction", "d.rank"
    )


def _metric_rows(entries) -> list:
    return [
        F.struct(
            F.lit(scope).alias("scope"),
            F.lit(direction).cast("string").alias("direction"),
            F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
        )
        for scope, direction, metric, value in entries
    ]


def _explode_metrics(one_row: DataFrame, entries) -> DataFrame:
    return one_row.select(F.explode(F.array(*_metric_rows(entries))).alias("m")).select("m.*")


def retrieval_metrics(
    stats: DataFrame,
    modalities: Sequence[str],
    scope: str = "row",
    ks: Sequence[int] = KS,
    uniform: bool = False,
) -> DataFrame:
    """(scope, direction, metric, value): R@K and MRR per direction, their mean R@10,
    group counts for the compound scope, uniformity per modality if present.

    All metrics come from one aggregation over the rows.
    """
    dirs = directions(modalities)
    aggs, entries = [F.count(F.lit(1)).alias("n")], []
    for a, b in dirs:
        rank = F.col(f"ge_{a}_{b}")
        for k in ks:
            name = f"r{k}_{a}_{b}"
            aggs.append(F.avg((rank <= k).cast("double")).alias(name))
            entries.append((scope, f"{a}->{b}", f"R@{k}", F.col(name)))
        aggs.append(F.avg(1.0 / rank).alias(f"mrr_{a}_{b}"))
        entries.append((scope, f"{a}->{b}", "MRR", F.col(f"mrr_{a}_{b}")))
        if scope == "compound":
            entries.append((scope, f"{a}->{b}", "n_compounds", F.col("n")))
    if 10 in ks:
        r10 = [F.col(f"r10_{a}_{b}") for a, b in dirs]
        mean = r10[0]
        for c in r10[1:]:
            mean = mean + c
        entries.append((scope, None, "mean_R@10", mean / len(dirs)))
    if scope == "compound":
        entries.append(
            (scope, None, "random_R@10", F.least(10.0 / F.greatest(F.col("n"), F.lit(1)), F.lit(1.0)))
        )
    if uniform:
        for m in ordered_modalities(modalities):
            aggs.append(F.sum(f"pot_{m}").alias(f"pot_{m}"))
            entries.append((scope, None, f"uniform_{m}", uniformity_value(f"pot_{m}", "n")))
    return _explode_metrics(stats.agg(*aggs), entries)


def uniformity_value(potential: str, n: str):
    count = F.col(n).cast("double")
    return F.log(F.try_divide(F.col(potential), count * (count - 1.0)))


def uniformity(wide: DataFrame, key: str, modalities: Sequence[str], tiles: int | None = None) -> DataFrame:
    """(modality, uniformity)."""
    mods = ordered_modalities(modalities)
    stats = row_statistics(wide, key, mods, uniform=True, tiles=tiles, retrieval=False)
    one = stats.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"pot_{m}").alias(f"pot_{m}") for m in mods])
    rows = [
        F.struct(F.lit(m).alias("modality"), uniformity_value(f"pot_{m}", "n").alias("uniformity"))
        for m in mods
    ]
    return one.select(F.explode(F.array(*rows)).alias("u")).select("u.*")


def alignment(wide: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """(pair, alignment): mean squared distance of an entity's two vectors. The
    vectors share a row, so this is a projection and one aggregate."""
    pair_list = pairs(modalities)
    one = wide.agg(
        *[F.avg(squared_distance(F.col(a), F.col(b))).alias(f"{a}_{b}") for a, b in pair_list]
    )
    rows = [
        F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_{b}").alias("alignment"))
        for a, b in pair_list
    ]
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def positive_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Squared distance of the same row in two separately stored modalities."""
    joined = left.select(key, F.col("vec").alias("_a")).join(
        right.select(key, F.col("vec").alias("_b")), key
    )
    return joined.select(key, squared_distance(F.col("_a"), F.col("_b")).alias("d2"))
