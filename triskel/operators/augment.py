"""Training-time corruption, random baselines and projections, all hash-seeded."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from triskel.functions.hashing import SPAN, hash32, hash32_second, py_hash32
from triskel.functions.vectors import unit
from triskel.operators.tiles import MAX_TASKS, rows_of

CORRUPTION_RATE = 0.4
BIT_DROPOUT = 0.1
BLOCK_BYTES = 1 << 24  # of vectors in a block of rows


def _cells(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which cells are there; a missing vector has none."""
    if column.null_count == 0 and column.flatten().null_count == 0:
        values = rows_of(column)
        if len(values) and values.shape[1] != width:
            raise ValueError(f"vectors have {values.shape[1]} components, not {width}")
        return values, np.ones(values.shape, bool)
    values, there = np.zeros((len(column), width)), np.zeros((len(column), width), bool)
    for i, row in enumerate(column.to_pylist()):
        for j, v in enumerate(row or []):
            if v is not None:
                values[i, j], there[i, j] = v, True
    return values, there


def _requests(positions: np.ndarray, width: int, rows: int, seed: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and donor of every cell to replace: the k features of least hash in each row."""
    out_row, out_feature, out_donor = [], [], []
    for at, position in enumerate(positions.tolist()):
        digests = [hashlib.md5(f"{seed}|{position}|{i}".encode()).hexdigest() for i in range(width)]
        first = sorted(range(width), key=lambda i: (digests[i][:8], i))[:k]
        out_row += [at] * len(first)
        out_feature += first
        out_donor += [int(digests[i][8:16], 16) % rows for i in first]
    return np.array(out_row, np.int32), np.array(out_feature, np.int32), np.array(out_donor, np.int64)


_BUNDLE = "_of int, _by int, _row array<int>, _feature array<int>"


def corrupt_marginals(
    df: DataFrame,
    position: str,
    vec: str,
    width: int,
    rows: int,
    seed: int,
    rate: float = CORRUPTION_RATE,
    block: int | None = None,
) -> DataFrame:
    """Replaces floor(width*rate) features per row by the same feature of random rows.

    ``position`` is a dense 0-based row number below ``rows``. Rows come in blocks of ``block``
    positions (some 16 MB). A block asks another for all it needs in one row, and gets its values back
    in one row, so shuffled rows grow with pairs of blocks and not with cells; vectors travel
    to their block only. Donors are uniform, so no block is asked more than others.
    """
    k = math.floor(width * rate)
    block = block or max(1, BLOCK_BYTES // (8 * width))
    blocks = max(1, -(-rows // block))
    names, home = df.columns, F.floor(F.col(position) / block).cast("int")

    def ask(table: pa.Table) -> pa.Table:
        positions = np.sort(table.column("_p").to_numpy())
        by = int(positions[0] // block)
        row, feature, donor = _requests(positions, width, rows, seed, k)
        row = (positions[row] - by * block).astype(np.int32) if len(row) else row
        order = np.argsort(donor // block, kind="stable")
        row, feature, donor = row[order], feature[order], donor[order]
        of = donor // block
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        bounds = pa.array(np.append(starts, len(of)), pa.int32())
        lists = {n: pa.ListArray.from_arrays(bounds, pa.array(v, pa.int32())) for n, v in (("_row", row), ("_feature", feature), ("_at", donor - of * block))}
        return pa.table({"_of": pa.array(of[starts], pa.int32()), "_by": pa.array(np.full(len(starts), by), pa.int32()), **lists})

    def give(table: pa.Table, asked: pa.Table) -> pa.Table:
        places = table.column("_p").to_numpy()
        values, there = _cells(table.column("_v").combine_chunks(), width)
        if not len(places):
            return asked.select(["_of", "_by", "_row", "_feature"]).append_column("_value", pa.array([[]] * len(asked), pa.list_(pa.float64()))).slice(0, 0)
        line = np.full(block, -1)
        line[places - int(places[0] // block) * block] = np.arange(len(places))
        at, feature = (asked.column(n).combine_chunks() for n in ("_at", "_feature"))
        donor = line[at.flatten().to_numpy()]
        cell = feature.flatten().to_numpy()
        found = (donor >= 0) & there[donor, cell]
        drawn = pa.array(values[donor, cell], pa.float64(), mask=~found)
        bounds = np.append(0, np.cumsum(pc.list_value_length(at).to_numpy()))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), drawn)
        return asked.select(["_of", "_by", "_row", "_feature"]).append_column("_value", lists)

    def put(table: pa.Table, given: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select(names)
        values, there = (x.copy() for x in _cells(table.column(vec).combine_chunks(), width))
        place = table.column(position).to_numpy()
        line = np.full(block, -1)
        line[place - int(place[0] // block) * block] = np.arange(len(place))
        has = ~table.column(vec).is_null().to_numpy()
        if given.num_rows:
            row, feature, drawn = (given.column(n).combine_chunks().flatten() for n in ("_row", "_feature", "_value"))
            at, cell = line[row.to_numpy()], feature.to_numpy()
            values[at, cell] = drawn.fill_null(0.0).to_numpy()
            there[at, cell] = drawn.is_valid().to_numpy(zero_copy_only=False)
        bounds = np.append(0, np.cumsum(np.where(has, width, 0)))
        flat = pa.array(values[has].ravel(), pa.float64(), mask=~there[has].ravel())
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat, mask=pa.array(~has))
        return table.select(names).set_column(names.index(vec), vec, lists)

    tasks = min(blocks, MAX_TASKS)
    homed = df.withColumn("_of", home)
    asked = homed.select("_of", F.col(position).alias("_p")).groupBy("_of").applyInArrow(ask, f"{_BUNDLE}, _at array<int>")
    donors = homed.select("_of", F.col(position).alias("_p"), F.col(vec).alias("_v")).repartition(tasks, "_of").groupBy("_of")
    given = donors.cogroup(asked.groupBy("_of")).applyInArrow(give, f"{_BUNDLE}, _value array<double>")
    schema = StructType([StructField(f.name, ArrayType(DoubleType())) if f.name == vec else f for f in df.schema.fields])
    return homed.groupBy("_of").cogroup(given.groupBy("_by")).applyInArrow(put, schema)


def drop_bits(bits: Column, row: Column, seed: int, share: float = BIT_DROPOUT) -> Column:
    """Sparse fingerprint without floor(share) of its set bits."""
    ranked = F.sort_array(
        F.transform(bits, lambda b: F.struct(hash32(seed, row, b).alias("h"), b.alias("b")))
    )
    gone = F.floor(F.size(bits) * F.lit(share)).cast("int")
    kept = F.slice(ranked, gone + 1, F.greatest(F.size(bits), F.lit(1)))
    return F.sort_array(F.transform(kept, lambda s: s["b"]))


def gaussian(*parts) -> Column:
    """Standard normal from the two halves of one digest (Box and Muller 1958)."""
    u1 = (hash32(*parts) + 1.0) / F.lit(SPAN)
    u2 = hash32_second(*parts) / F.lit(SPAN)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def random_unit_vector(row: Column, modality: str, width: int, seed: int) -> Column:
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: gaussian(seed, modality, row, i)
    )
    return unit(draws)


def sign_matrix(width_in: int, width_out: int, modality: str, seed: int) -> np.ndarray:
    """±1 matrix (Achlioptas 2003), sized by the model and not by the data."""
    cells = (
        1.0 if py_hash32(seed, modality, i, j) % 2 == 0 else -1.0
        for i in range(width_in)
        for j in range(width_out)
    )
    return np.fromiter(cells, np.float64, width_in * width_out).reshape(width_in, width_out)


def random_projection(
    df: DataFrame, vec: str, modality: str, width_in: int, width_out: int, seed: int = 42
) -> DataFrame:
    """Projects ``vec`` to ``width_out`` dimensions, scaled by 1/sqrt(width_in), then
    L2-normalised. A narrow Arrow map: nothing is shuffled or exploded."""
    projection = sign_matrix(width_in, width_out, modality, seed) / math.sqrt(width_in)
    return map_vectors(df, vec, lambda x: x @ projection).withColumn(vec, unit(F.col(vec)))


def map_vectors(df: DataFrame, vec: str, function) -> DataFrame:
    """Applies a numpy function [n, D] -> [n, E] to a vector column batch by batch."""
    position = df.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            given = batch.column(position)
            there = given.is_valid().to_numpy(zero_copy_only=False)
            out = function(np.asarray(rows_of(given.drop_null()), np.float64)) if there.any() else np.zeros((0, 0))
            # A missing vector stays missing and takes no part.
            offsets = np.concatenate([[0], np.cumsum(there)]).astype(np.int32) * out.shape[1]
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel(), pa.float64()), mask=pa.array(~there))
            arrays = [column if i == position else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    schema = ", ".join(
        f"`{n}` {'array<double>' if n == vec else t}" for n, t in df.dtypes
    )
    return df.mapInArrow(run, schema)
