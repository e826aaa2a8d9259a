"""The corpus pipeline: from documents to packed windows.

Each stage works on all documents the one before it kept, and its decisions take effect:
texts in no language go, one document of each class of near duplicates stays, documents
that hold a benchmark item go, secrets are masked, and the rest is packed. All stages but
the last return the columns of their input.

Defined results: a null text has no language and goes in the first stage; null ids stay
until packing; of rows that share an id the first in order of their columns stays; an
empty table gives no window; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triskel.llm import decontaminate, langid, minhash, packing, secrets
from triskel.session import materialise

# A text is rejected if it has no letter or if no language is likelier than this.
LEAST_SCORE = 0.3
BROADCAST_IDS = 2_000_000


def _held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from those with a ``lang``."""
    learned = docs.where(~F.coalesce(_held_out("doc_id"), F.lit(False)))
    model = langid.fit_language_model(learned, "text", "lang")
    scored = langid.predict_language(docs, model, "text", "__language", "__score")
    return scored.where((F.col("__language") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among ``ids`` (written, distinct)."""
    if ids.count() <= BROADCAST_IDS:  # else Spark shuffles the documents
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class."""
    classes = minhash.near_duplicates(docs, "doc_id", "text")
    kept = _without(docs, materialise(classes.where("doc_id <> class_id").select("doc_id").distinct()))
    repeated = materialise(docs.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy(*docs.columns)
    same = kept.join(repeated, "doc_id", "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return _without(kept, repeated).unionByName(same.select(*docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    blocks = decontaminate.fit_passages(docs, "text", benchmark, "item_id", "text")
    return decontaminate.find_leaks(docs, "text", blocks, "__leaks").where(F.size("__leaks") == 0).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked and n_chars counted anew."""
    return secrets.mask_secrets(docs, "text", "n_chars")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the windows."""
    import public_tokenizers

    pieces = packing.pack_documents(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("packing", pack_windows),
]

# Models are trained along the way, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
