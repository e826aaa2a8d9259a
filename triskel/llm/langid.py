"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams (1 to 3) of the lower-case text, with runs of anything but
letters taken as one blank; values are TF-IDF, scaled to length one. Document frequencies
come from *all* training rows, one distributed pass with a partial sum per task. Weights
are fitted by follow-the-regularised-leader with an elastic-net penalty on a bounded
sample: ``FIT_ROWS`` rows (expected number), drawn by a hash of their place, dealt to ``FIT_SHARDS``
tasks whose weights are averaged. A fifth of the sample takes no part in the fit and sets
the temperature that calibrates the probabilities.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without
any training row every text is; ties go to the language that sorts first; repeated rows
count as rows; whole texts are read, however long; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from triskel.llm.text import LETTER, classes, code_points, slices, texts_of

BUCKETS = 1 << 16
FIT_ROWS, FIT_SHARDS, EPOCHS = 16384, 8, 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 2e-4, 1e-5
UNKNOWN = "und"


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each text, their bounds, and whether a text has a letter."""
    codes, bounds = code_points([f" {t.lower()} " for t in texts])
    letters = classes()[codes] == LETTER
    has = np.add.reduceat(letters, bounds[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    # A blank stands for a whole run of what is no letter.
    kept = letters.copy()
    kept[1:] |= letters[:-1]
    kept[bounds[:-1]] = True
    chars = np.where(letters, codes, 32)[kept].astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
    out = np.empty(3 * len(chars), np.uint16)
    hashed = np.zeros(len(chars), np.uint32)
    owner_end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(chars))
    for n in range(3):
        shifted = np.zeros(len(chars), np.uint32)
        shifted[: len(chars) - n] = chars[n:]
        shifted[at + n >= owner_end] = 0  # past the end of the text
        hashed = (hashed ^ shifted) * np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        out[n::3] = (hashed * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)
    return out, 3 * bounds, has


def _counts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and how often each occurs."""
    if len(grams) > 4096:
        dense = np.bincount(grams, minlength=BUCKETS)
        at = np.flatnonzero(dense)
        return at, dense[at].astype(np.float32)
    ordered = np.sort(grams, kind="stable")
    at = np.flatnonzero(np.diff(ordered, prepend=-1, append=BUCKETS).astype(bool)) if len(ordered) else np.zeros(0, np.int64)
    return ordered[at[:-1]].astype(np.int64), np.diff(at).astype(np.float32)


def _document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and for each bucket the rows that have it: a partial sum per task,
    then 65,536 rows at most for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                grams, bounds, _ = _grams(texts_of(part, "text"))
                total += len(bounds) - 1
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    seen[_counts(grams[a:b])[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], ["bucket", "n"])

    frequency = np.zeros(BUCKETS + 1, np.int64)
    counted = rows.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    frequency[counted["bucket"]] = counted["n"]
    return int(frequency[-1]), frequency[:-1]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        grams, bounds, has = _grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for i in np.flatnonzero(has):
            at, value = _features(grams[bounds[i] : bounds[i + 1]], self.idf)
            out[i] = value @ self.weights[at] + self.bias
        return out, has

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _features(grams: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = _counts(grams)
    value = n * idf[at]
    norm = float(np.sqrt(value @ value))
    return at, value / norm if norm else value


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights after ``EPOCHS`` passes; the bias has the last row and no penalty."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
        shrunk[-1] = zi[-1]
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(EPOCHS):
        for at, value, label in rows:
            at, value = np.append(at, BUCKETS), np.append(value, 1.0)
            w = weights(at)
            p = value @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[label] -= 1.0
            gradient = value[:, None] * p[None, :]
            squared = gradient * gradient
            before = n[at]
            z[at] += gradient - (np.sqrt(before + squared) - np.sqrt(before)) / alpha * w
            n[at] = before + squared
    final = weights(np.arange(BUCKETS + 1))
    return final[:-1], final[-1]


def fit_language_model(rows: DataFrame, text_col: str, lang_col: str, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """A model of all languages in ``rows``; rows with a null language or text teach nothing."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    per_language = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages, total = sorted(per_language), sum(per_language.values())
    k = len(languages)
    count, frequency = _document_frequencies(rows) if k else (0, np.zeros(BUCKETS, np.int64))
    idf = (np.log((1.0 + count) / (1.0 + frequency)) + 1.0).astype(np.float32)
    model = LanguageModel(languages, idf, np.zeros((BUCKETS, k), np.float32), np.zeros(k))
    if k < 2:
        return model
    # Rows are drawn one by one, copies of a text too: half by size, half in equal shares.
    share = [min(1.0, max(fit_rows / total, fit_rows / (k * per_language[x])) / 2) if total > fit_rows else 1.0 for x in languages]
    number = {x: i for i, x in enumerate(languages)}
    label = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30) < F.array(*[F.lit(x) for x in share])[label.cast("int")]
    sample = rows.where(drawn)
    if total > FIT_SHARDS:
        # Equal texts are dealt by a running number of their task, not to one shard.
        sample = sample.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(FIT_SHARDS)).cast("int")).repartitionById(FIT_SHARDS, "shard").drop("shard")
    settings = (k, ALPHA, BETA, L1, L2)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, check, texts_held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                grams, bounds, has = _grams(texts_of(part, "text"))
                for i, lang in enumerate(part.column("lang").to_pylist()):
                    if has[i]:
                        at, value = _features(grams[bounds[i] : bounds[i + 1]], idf)
                        kept = check if texts_held % 5 == 4 else fit
                        kept.append((at.astype(np.uint16), value.astype(np.float32), number[lang]))
                        texts_held += 1
        # Neighbours in a file may be copies of one text; a fixed shuffle parts them.
        order = np.random.default_rng(0).permutation(len(fit))
        fit = [(fit[i][0].astype(np.int64), *fit[i][1:]) for i in order]
        weights, bias = _ftrl(fit, *settings)
        held = [(value @ weights[at.astype(np.int64)] + bias, label) for at, value, label in check]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([weights.astype(np.float32).tobytes()], pa.binary()),
                pa.array([bias.tobytes()], pa.binary()),
                pa.array([np.array([h[0] for h in held], np.float64).tobytes()], pa.binary()),
                pa.array([np.array([h[1] for h in held], np.int64).tobytes()], pa.binary()),
                pa.array([len(fit)], pa.int64()),
            ],
            ["weights", "bias", "logits", "labels", "n"],
        )

    parts = sample.mapInArrow(train, "weights binary, bias binary, logits binary, labels binary, n bigint").collect()
    used = [p for p in parts if p["n"]]
    if not used:
        return model
    model.weights = np.mean([np.frombuffer(p["weights"], np.float32).reshape(BUCKETS, k) for p in used], axis=0).astype(np.float32)
    model.bias = np.mean([np.frombuffer(p["bias"]) for p in used], axis=0)
    logits = np.concatenate([np.frombuffer(p["logits"]).reshape(-1, k) for p in used])
    labels = np.concatenate([np.frombuffer(p["labels"], np.int64) for p in used])
    model.temperature = _temperature(logits, labels)
    return model


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of a fixed grid under which the held-out labels are likeliest."""
    if not len(labels):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.geomspace(0.02, 20, 121):
        z = logits / t
        top = z.max(axis=1)
        loss = float(np.mean(np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(labels)), labels]))
        best = min(best, (loss, float(t)))
    return best[1]


def predict_language(df: DataFrame, model: LanguageModel, text_col: str, lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """All columns of ``df`` and two more: the likeliest language and its probability."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 65,536 rows, a column a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                texts = texts_of(part, text_col)
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if m.languages:
                    logits, has = m.logits(texts)
                    p = m.probabilities(logits)
                    best = p.argmax(axis=1)
                    score = np.where(has, p[np.arange(len(texts)), best], 0.0)
                    lang = [m.languages[j] if h else UNKNOWN for j, h in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, lang_col, score_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())]))
