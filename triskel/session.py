"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema


def build_session(app: str = "triskel", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for.

    AQE re-plans joins and splits skewed partitions at run time. BLAS is pinned
    to one thread per Python worker, since Spark already runs one worker per core.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A fresh sub-folder of the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` names storage every executor can reach; on a cluster it
    must be set. Only a session without executors of its own (``local[..]``) may leave
    it out, as tests do: driver and workers then share the machine's temporary folder,
    which is made once and goes when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/triskel-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write once, read back: cuts lineage through storage that outlives an executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of driver-side rows as a local relation: no job, no shuffle."""
    fields = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    data = pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
    return spark.createDataFrame(data, fields)
