"""Folders of CSV files with unequal headers, as Python data sources.

Each source lays out its own partitions: files for headers and audits, byte ranges of
files for rows. Nothing about a file goes into the plan, and no job is run for a single file. Files are
listed by Spark and opened by pyarrow's file systems inside the tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pv
import pyarrow.fs as pf
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

SUFFIXES = (".csv", ".csv.gz")
RANGE_BYTES = 1 << 26
HEADERS = 32  # read in one task
# Bits of an ordinal for the place within a file: 4 TiB of bytes, 2 million files.
FILE_SHIFT = 42
# Texts that count as missing.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
HEADER = "file string, number int, size bigint, header array<string>"
AUDIT = "file string, readable boolean, n_rows bigint, n_numeric bigint, missing bigint, infinite bigint"


@dataclass
class Range(InputPartition):
    """Bytes of a file; ``start`` 0 and ``stop`` -1 for a file that cannot be split."""

    file: str
    number: int
    start: int
    stop: int


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def list_files(spark: SparkSession, folder: str, suffixes=SUFFIXES, deep: bool = True) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, and of its sub-folders if ``deep``, by suffix
    and path; empty if there is no such folder."""
    if not exists(spark, folder):
        return []
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    sizes = dict(found.select("path", "length").collect())  # contents are not read
    # Files of no bytes are in the listing but in no scan.
    known = {_bare(p) for p in sizes}
    paths = sizes | {p: 0 for p in map(unquote, found.inputFiles()) if _bare(p) not in known}
    top = folder.rstrip("/").rsplit("/", 1)[-1]
    ranked = [
        (rank, path, size)
        for path, size in paths.items()
        for rank, suffix in enumerate(suffixes)
        if path.endswith(suffix) and (deep or path.rsplit("/", 2)[-2] == top)
    ]
    return [(path, size) for _, path, size in sorted(ranked)]


def _bare(path: str) -> str:
    """A path without scheme, with one slash in front."""
    return "/" + path.partition(":")[2].lstrip("/") if ":" in path.split("/")[0] else path


def _open(path: str):
    """File system and bare path of a path with or without a scheme."""
    if path.startswith("file:"):
        return pf.LocalFileSystem(), _bare(path)
    return pf.FileSystem.from_uri(path) if "://" in path else (pf.LocalFileSystem(), path)


def write_bytes(path: str, data: bytes) -> None:
    fs, bare = _open(path)
    with fs.open_output_stream(bare) as out:
        out.write(data)


def _stream(path: str):
    fs, bare = _open(path)
    return fs.open_input_stream(bare, compression="gzip" if path.endswith(".gz") else None)


def _header(path: str) -> tuple[list[str], int]:
    """Names of the first line and its bytes; it may be longer than one read, and quoted names may hold a line end."""
    data, more = b"", b"x"
    with _stream(path) as f:
        while more:
            more = f.read(1 << 16)
            data += more
            line = _first_line(data)
            if line >= 0:
                data = data[:line]
                break
    if not data.strip():
        return [], len(data)
    names = pv.read_csv(pa.BufferReader(data.rstrip(b"\r\n") + b"\n"), pv.ReadOptions(block_size=len(data) + 2)).column_names
    return names, len(data)


def _batches(source, names: list[str], include: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of a source without header as texts, in batches; none if nothing is left in it."""
    convert = pv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), include_columns=include)
    try:
        yield from pv.open_csv(source, pv.ReadOptions(column_names=names), convert_options=convert)
    except pa.ArrowInvalid as empty:
        if "Empty CSV" not in str(empty):
            raise


def _first_line(data: bytes) -> int:
    """End of the first line outside quotes, or -1."""
    at = data.find(b"\n")
    while at >= 0 and data.count(b'"', 0, at) % 2:
        at = data.find(b"\n", at + 1)
    return at + 1 if at >= 0 else -1


class _Files(DataSource):
    """What the sources share: option ``files`` is JSON, made by ``load``."""

    def files(self) -> list[tuple[str, int]]:
        return [tuple(f) for f in json.loads(self.options["files"])]


class _Whole(DataSourceReader):
    def __init__(self, files):
        self.all = files

    def partitions(self) -> list[Range]:
        return [Range(p, i, 0, size) for i, (p, size) in enumerate(self.all)]


@dataclass
class Group(InputPartition):
    """Some files whose headers one task reads."""

    ranges: list[Range]


class HeaderSource(_Files):
    """(file, number, size, header): one row a file; no header if the file is empty or broken."""

    @classmethod
    def name(cls) -> str:
        return "triskel_csv_headers"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema):
        return _HeaderReader(self.files())


class _HeaderReader(_Whole):
    def partitions(self) -> list[Group]:
        ranges = super().partitions()
        return [Group(ranges[lo : lo + HEADERS]) for lo in range(0, len(ranges), HEADERS)]

    def read(self, group: Group) -> Iterator[tuple]:
        for part in group.ranges:
            try:
                header = _header(part.file)[0]
            except (OSError, pa.ArrowInvalid):
                header = []
            yield part.file, part.number, part.stop, header


class RowSource(_Files):
    """The columns of the schema asked for, with ``ordinal`` in (file, row) order.

    Doubles that do not parse are missing, as are texts that count as such. Plain files are cut
    into byte ranges at line ends, so a quoted text of these files must not hold a line end.
    """

    @classmethod
    def name(cls) -> str:
        return "triskel_csv_rows"

    def reader(self, schema):
        return _RowReader(self.files(), schema)


class _RowReader(DataSourceReader):
    def __init__(self, files, schema):
        self.all, self.wanted = files, to_arrow_schema(schema)

    def partitions(self) -> list[Range]:
        out = []
        for i, (path, size) in enumerate(self.all):
            step = max(size, 1) if path.endswith(".gz") else RANGE_BYTES
            out += [Range(path, i, lo, min(lo + step, size)) for lo in range(0, size, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        names, length = _header(part.file)
        if not names:
            return
        if part.file.endswith(".gz"):
            source = _stream(part.file)
            source.read(length)
        else:
            source = pa.BufferReader(_lines(part)[0 if part.start else length :])
        wanted = [n for n in self.wanted.names if n != "ordinal"]
        done = 0
        for batch in _batches(source, names, wanted):
            columns = {n: batch.column(n) for n in wanted}
            for n in wanted:
                kind = self.wanted.field(n).type
                columns[n] = _doubles(columns[n])[0] if pa.types.is_floating(kind) else _texts(columns[n])
            # A range holds no more rows than bytes, so the next one starts beyond its last.
            place = (part.number << FILE_SHIFT) + part.start + done
            columns["ordinal"] = pa.array(np.arange(place, place + batch.num_rows))
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in self.wanted], schema=self.wanted)


def _lines(part: Range) -> bytes:
    """The lines that begin in a byte range."""
    fs, bare = _open(part.file)
    with fs.open_input_file(bare) as f:
        lo = part.start
        if lo:
            lo = _line_end(f, lo - 1, part.stop)
        hi = _line_end(f, part.stop - 1, f.size())
        return f.read_at(hi - lo, lo) if hi > lo else b""


def _line_end(f, at: int, stop: int) -> int:
    """The place after the first line end from ``at`` on."""
    size = f.size()
    while at < size:
        found = f.read_at(min(1 << 16, size - at), at)
        end = found.find(b"\n")
        if end >= 0:
            return at + end + 1
        at += len(found)
    return size


def _texts(column: pa.Array) -> pa.Array:
    return pc.if_else(pc.is_in(column, pa.array(MISSING)), pa.scalar(None, pa.string()), column)


def _doubles(column: pa.Array) -> tuple[pa.Array, bool]:
    """Numbers of a text column, and whether all that is not missing is one."""
    texts = _texts(pc.utf8_trim_whitespace(column))
    try:
        return texts.cast(pa.float64()), True
    except pa.ArrowInvalid:
        sure = pc.match_substring_regex(texts, r"^[+-]?(?i:inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$")
        plain = pc.replace_substring_regex(pc.if_else(sure, texts, pa.scalar(None, pa.string())), r"^\+", "")
        return plain.cast(pa.float64()), bool(pc.all(pc.fill_null(sure, True)).as_py())


class AuditSource(_Files):
    """(file, readable, n_rows, n_numeric, missing, infinite): one row a file.

    A column is numeric if all its values that are not missing are numbers. A file that does not
    open, has no header or rows of unequal width is not readable and has no counts.
    """

    @classmethod
    def name(cls) -> str:
        return "triskel_csv_audit"

    def schema(self) -> str:
        return AUDIT

    def reader(self, schema):
        return _AuditReader(self.files())


class _AuditReader(_Whole):
    def read(self, part: Range) -> Iterator[tuple]:
        try:
            yield part.file, True, *self.counts(part.file)
        except (OSError, pa.ArrowInvalid):
            yield part.file, False, None, None, None, None

    @staticmethod
    def counts(path: str) -> tuple[int, int, int, int]:
        names, length = _header(path)
        if not names:
            raise pa.ArrowInvalid("no header")
        source = _stream(path)
        source.read(length)
        rows, numeric = 0, np.ones(len(names), bool)
        missing, infinite = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in _batches(source, [f"{i}" for i in range(len(names))]):  # names may repeat
            rows += batch.num_rows
            for i in np.flatnonzero(numeric):
                values, numbers = _doubles(batch.column(int(i)))
                numeric[i] = numbers
                there = values.drop_null().to_numpy()
                missing[i] += len(values) - len(there) + int(np.isnan(there).sum())
                infinite[i] += int(np.isinf(there).sum())
        return rows, int(numeric.sum()), int(missing[numeric].sum()), int(infinite[numeric].sum())


def load(spark: SparkSession, source: type[_Files], files: list[tuple[str, int]], schema: str | None = None) -> DataFrame:
    """A table of one of these sources over listed files."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("files", json.dumps(files))
    return (reader.schema(schema) if schema else reader).load()


def shared_columns(spark: SparkSession, files: list[tuple[str, int]]) -> list[str]:
    """Columns that every file has, from headers read in tasks."""
    headers = load(spark, HeaderSource, files)
    names = headers.select("number", F.explode(F.array_distinct("header")).alias("name"))
    return sorted(r["name"] for r in names.groupBy("name").count().where(F.col("count") == len(files)).collect())


def audit_folder(spark: SparkSession, folder: str) -> DataFrame:
    """One row of counts over all CSV files below a folder; files that cannot be read count
    as files and give nothing else. No row if there is no file."""
    files = list_files(spark, folder)
    if not files:
        return spark.createDataFrame([], "n_files bigint, total_rows bigint, n_numeric_columns bigint, nan_rate double, inf_count bigint")
    each = load(spark, AuditSource, files)
    cells = F.sum(F.col("n_rows") * F.col("n_numeric"))
    return each.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.max("n_numeric"), F.lit(0)).alias("n_numeric_columns"),
        F.coalesce(F.try_divide(F.sum("missing").cast("double"), cells), F.lit(0.0)).alias("nan_rate"),
        F.coalesce(F.sum("infinite"), F.lit(0)).alias("inf_count"),
    )
