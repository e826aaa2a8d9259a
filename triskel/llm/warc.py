"""Deterministic sharded WARC writer and its reader.

The order of records is (key, URI, payload digest). Exact counts of compressed-size
stand-ins over fixed bins of the key's range give the shards, so a shard's content
depends on the table only, not on how Spark partitioned it. A shard is one task: it sorts
its records (Spark's sort, which spills), streams one gzip member per record and starts a
new file when the compressed size reaches ``roll_bytes``. Files are written under
temporary names; the rows a *successful* attempt returns form the manifest, whose files
are then renamed. A lost executor leaves only temporary files, which the commit removes.

Payloads that occur more than once, and have at least ``revisit_bytes`` bytes, are stored
once, in the record with the largest key; the others become ``revisit`` records that refer
to it. Rows that repeat the key of that record are responses too, as no rule tells them
apart.

Defined results: a null payload is empty; a null URI is an empty one, and line breaks in
one are percent-encoded; a null key is
allowed, sorts first and loses ties; long payloads are streamed record by record; an
empty table gives an empty manifest. Only the named columns are read.

Records are written with the file systems of pyarrow (local, HDFS, S3, GCS), as Spark has
no writer for binary files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from triskel.session import materialise, shared_folder

ROLL_BYTES, SHARD_BYTES, REVISIT_BYTES, KEY_BINS = 16 << 20, 32 << 20, 1000, 4096
BROADCAST_HOLDERS = 500_000
# Record dates must not differ between runs.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, temp string, name string, bytes bigint, records bigint, sha1 string"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    """Hadoop writes file:/x, pyarrow wants file:///x."""
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _record(key, uri: str, payload: bytes | None, digest: str, size: int, kind: str, refers: str | None) -> bytes:
    """One WARC record with headers made anew from the row."""
    sha32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key}\n{uri}\n{digest}\n{kind}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Page-Key: {json.dumps(key)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha32}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Key: {refers}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roll:
    """The open file of a shard."""

    def __init__(self, folder: str, shard: int):
        self.fs, self.root = _open(folder)
        self.shard, self.part = shard, 0
        self.attempt = uuid.uuid4().hex
        self.done: list[tuple] = []
        self.out = None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.temp = f".tmp-{self.shard:05d}-{self.part:05d}-{self.attempt}"
            self.out = self.fs.open_output_stream(posixpath.join(self.root, self.temp), compression=None)
            self.size, self.count, self.sha1 = 0, 0, hashlib.sha1()
        member = gzip.compress(record, compresslevel=5, mtime=0)
        self.out.write(member)
        self.sha1.update(member)
        self.size += len(member)
        self.count += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"records-{self.shard:05d}-{self.part:05d}.warc.gz"
            self.done.append((self.shard, self.part, self.temp, name, self.size, self.count, self.sha1.hexdigest()))
            self.out, self.part = None, self.part + 1


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_MANIFEST_SCHEMA = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("temp", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha1", pa.string())])


def plan_shards(records: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[int, int, list[tuple[int, int]], int]:
    """Low end and width of the bins of the key's range, and (first shard, number of
    shards) of each bin and the number of all shards. Light bins in a row share a shard; a heavy bin has several,
    told apart by a hash of URI and payload. At most ``KEY_BINS`` rows reach the driver."""
    ends = records.agg(F.min("key"), F.max("key"), F.count("key")).first()
    low = int(ends[0] or 0)
    width = max(1, -(-(int(ends[1] or 0) - low + 1) // KEY_BINS))
    sizes = {r[0]: r[1] for r in records.groupBy(_bin(low, width).alias("b")).agg(F.sum(F.col("size") + 512)).collect()}
    bins: list[tuple[int, int]] = []
    shard, filled = 0, 0
    for b in range(KEY_BINS):
        size = int(sizes.get(b, 0))
        if size > shard_bytes:
            shard += filled > 0
            n = -(-size // shard_bytes)
            bins.append((shard, n))
            shard, filled = shard + n, 0
            continue
        if filled and filled + size > shard_bytes:
            shard, filled = shard + 1, 0
        bins.append((shard, 1))
        filled += size
    return low, width, bins, shard + (filled > 0)


def _bin(low: int, width: int):
    return F.coalesce(F.floor((F.col("key") - F.lit(low)) / F.lit(width)).cast("int"), F.lit(0))


def write_warc(df: DataFrame, folder: str, key_col: str, uri_col: str, payload_col: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes the archives to ``folder`` and returns the manifest, which is also there as
    ``manifest``. Digests, duplicates and shards are worked out by Spark's own functions;
    payloads are shuffled once, to their shard."""
    folder = _uri(folder)
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    records = df.select(F.col(key_col).cast("bigint").alias("key"), F.coalesce(F.col(uri_col), F.lit("")).alias("uri"), payload.alias("payload"))
    records = records.select("key", "uri", "payload", F.octet_length("payload").cast("bigint").alias("size"), F.sha1("payload").alias("digest"))
    # One row per distinct payload that occurs again: the rest needs no partner.
    holders = records.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("key").alias("holder"), F.count("*").alias("n")).where("n > 1").select("digest", "holder")
    holders = materialise(holders)
    if holders.count() <= BROADCAST_HOLDERS:  # else both sides are shuffled by digest
        holders = F.broadcast(holders)
    low, width, bins, n_shards = plan_shards(records, shard_bytes)
    # Folded to one constant each; thousands of literals would slow the planner.
    first_of, parts_of = (F.from_json(F.lit(json.dumps([b[i] for b in bins])), "array<int>") for i in (0, 1))
    key_bin = _bin(low, width)
    shard = first_of[key_bin] + F.pmod(F.xxhash64("uri", "digest"), parts_of[key_bin].cast("bigint")).cast("int")
    kind = F.when(F.col("holder") > F.coalesce(F.col("key"), F.lit(-(1 << 63))), "revisit").otherwise("response")
    routed = records.join(holders, "digest", "left").select("key", "uri", "payload", "size", "digest", kind.alias("kind"), F.col("holder").cast("string").alias("holder"), shard.alias("shard"))
    # A revisit needs no payload any more.
    routed = routed.withColumn("payload", F.when(F.col("kind") == "response", F.col("payload")))
    # A partition for each shard: no sampling job, no two shards in one task.
    routed = routed.repartitionById(max(1, n_shards), "shard")
    routed = routed.sortWithinPartitions("shard", "key", "uri", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, done = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key, uri, body, size, digest, kind, holder, shard = row
                if roll is None or roll.shard != shard:
                    if roll is not None:
                        roll.close()
                        done += roll.done
                    roll = _Roll(folder, shard)
                roll.add(_record(key, uri, body, digest, size, kind, holder))
                if roll.size >= roll_bytes:
                    roll.close()
        if roll is not None:
            roll.close()
            done += roll.done
        if done:
            yield _columns(done, _MANIFEST_SCHEMA)

    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    routed.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    manifest = df.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    _commit(manifest, folder)
    return manifest


def _commit(manifest: DataFrame, folder: str) -> None:
    """Gives the files of the manifest their names, in tasks; repeating it does no harm."""

    def rename(rows: Iterator[Row]) -> None:
        fs, root = _open(folder)
        for r in rows:
            temp, name = posixpath.join(root, r["temp"]), posixpath.join(root, r["name"])
            if fs.get_file_info(temp).type != pafs.FileType.NotFound:
                fs.move(temp, name)
            if fs.get_file_info(name).size != r["bytes"]:
                raise OSError(f"{name} does not have the size of its manifest row")

    manifest.foreachPartition(rename)
    fs, root = _open(folder)
    for info in fs.get_file_info(pafs.FileSelector(root)):  # left by attempts that failed
        if info.base_name.startswith(".tmp-"):
            fs.delete_file(info.path)


def _members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        while chunk:
            parts.append(unpack.decompress(chunk))
            if not unpack.eof:
                break
            yield b"".join(parts)
            chunk, parts, unpack = unpack.unused_data, [], zlib.decompressobj(31)
    if any(parts):
        raise EOFError("archive ends inside a record")


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"digest of record {headers['WARC-Record-ID']} differs")
    return headers, block


READ = "key bigint, uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in the manifest, each file streamed by one task.

    Digests of blocks are checked. ``payload`` is null for revisits, and everywhere if
    ``payloads`` is False. Sizes and digests are those of the full payload."""
    folder = _uri(folder)
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("name")
    schema = pa.schema([("key", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for member in _members(stream):
                        headers, block = _parse(member)
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind = headers["WARC-Type"]
                        if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"payload of record {headers['WARC-Record-ID']} differs")
                        refers = headers.get("WARC-Refers-To-Key")
                        keep = payloads and kind == "response"
                        rows.append((json.loads(headers["WARC-Page-Key"]), headers["WARC-Target-URI"], kind, size, digest, int(refers) if refers else None, body if keep else None))
                        held += 200 + (size if keep else 0)
                        if held >= 1 << 22:
                            yield _columns(rows, schema)
                            rows, held = [], 0
                yield _columns(rows, schema)

    # A file is a task's unit of work: one row of the manifest a partition, as far as there are cores.
    return files.repartition(spark.sparkContext.defaultParallelism * 4, "name").mapInArrow(run, READ)


def scratch_archive(spark: SparkSession) -> str:
    """A fresh folder for archives in the shared checkpoint folder."""
    return _uri(shared_folder(spark)) + "-warc"
