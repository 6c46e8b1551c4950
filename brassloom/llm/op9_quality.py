"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The text of every document is read once and becomes about thirty statistics
(lengths, repetition, capitals, shares of kinds of characters). After they are
centred and scaled, random Fourier features approximate a Gaussian kernel over
them. Every partition adds up its part of the normal equations; Spark adds the
parts, the driver gets sums of a size that depends on the number of features
only, and solves the ridge regression. Scores of labelled rows that were kept
out of the fit are counted in bins; isotonic regression over the bins turns raw
scores into probabilities.

Labels: rows with quality 0 or 1; a document with several labels counts with
their mean. Edge cases: null text is the empty text, which has statistics of its
own and gets a score like any other. Documents without labels are scored only.
Without any labels every score is 0.5. Null doc_id: the row has no label and is
scored. Repeated rows are scored alike. Further columns are ignored by the
query; ``score_documents`` keeps them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brassloom.llm.common import FEW_IDS, fold, save, ship, small_batches, table

FEATURES = 160
RIDGE = 1e-3
BINS = 1000
#: Score from which a document is kept.
THRESHOLD = 0.3

_SIGNS = "!?.,;:|*#%&$@/\\-_\"'()[]{}<>=+~^`"
_DIGIT, _UPPER, _LOWER, _OTHER = range(48, 58), range(65, 91), range(97, 123), range(128, 256)
NAMES = [
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "repeats", "capital_words", "log_lines", "distinct_lines", "line_words",
    "digits", "upper", "lower", "beyond_ascii", "white", "control", "ends", "exclaims", "bars", "marks", "currency", "brackets", "quotes", "slashes", "signs", "sentence_words",
]


def statistics(text: str) -> list[float]:
    """The numbers in NAMES for a whole text."""
    words, lines = text.split(), text.split("\n")
    n, nw, nl = len(text), len(words), len(lines)
    seen = Counter(words)
    b = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    total = max(int(b.sum()), 1)
    share = lambda codes: float(sum(b[c] for c in codes)) / total
    of = lambda signs: share(map(ord, signs))
    most = max(seen.values(), default=0)
    return [
        np.log1p(n), np.log1p(nw), n / max(nw, 1) if nw else 0.0, len(seen) / max(nw, 1), most / max(nw, 1), sum(map(eq, words, islice(words, 1, None))) / max(nw, 1),
        sum(map(str.isupper, words)) / max(nw, 1), np.log1p(nl), len(set(lines)) / nl, np.log1p(nw / nl),
        share(_DIGIT), share(_UPPER), share(_LOWER), share(_OTHER), of(" \t\n\r\v\f"), share([*range(9), *range(14, 32), 127]), of("."), of("!?"), of("|"), of("*#%&~^"), of("$"), of("()[]{}<>"), of("\"'`"), of("/\\:@_=+"), of(_SIGNS),
        np.log1p(nw / (1 + b[46] + b[33] + b[63])),
    ]


def extract(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and ``stats`` (array of double) of each document's text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [statistics(x or "") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "stats"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{fields + ', ' if fields else ''}stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    phase: np.ndarray
    direction: np.ndarray
    weight: np.ndarray
    knots: np.ndarray  # raw scores and the probabilities at them; between two knots the line
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, the scaled statistics themselves and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.direction + self.phase)
        return np.hstack([z, x, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weight, -1, 2)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels) if len(self.knots) else np.full(len(stats), 0.5)


def isotonic(value: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the rising steps closest to target, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for v, t, w in zip(value, target, weight):
        blocks.append([t * w, w, v * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _stats_of(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(NAMES)) if len(batch) else np.empty((0, len(NAMES)))


def fit(stats: DataFrame, fit_rows: Column, calibration_rows: Column, seed: int = 11) -> Model:
    """stats: rows with stats and y (0 to 1; null: no label)."""
    spark = stats.sparkSession
    ship(spark)
    known = stats.where(F.col("y").isNotNull())
    moments = known.where(fit_rows).agg(*[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(len(NAMES))], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(len(NAMES))]).first()
    rng, d = np.random.default_rng(seed), len(NAMES)
    width = FEATURES + d + 1
    model = Model(np.zeros(d), np.ones(d), rng.uniform(0, 2 * np.pi, FEATURES), rng.normal(0, 1 / np.sqrt(2 * d), (d, FEATURES)), np.zeros(width), np.empty(0), np.empty(0))
    if moments is None or moments["m0"] is None:
        return model
    model.mean = np.array([moments[f"m{i}"] for i in range(d)])
    model.scale = np.array([moments[f"s{i}"] if moments[f"s{i}"] > 1e-9 else 1.0 for i in range(d)])
    upper = np.triu_indices(width)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = np.zeros((width, width)), np.zeros(width), 0
        for batch in small_batches(batches):
            z = model.features(_stats_of(batch))
            a += z.T @ z
            b += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
            n += len(batch)
        if n:
            values = np.concatenate([a[upper], b, [n]])
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part)), pa.int32()), pa.array(part)], names=["i", "v"])

    sums = known.where(fit_rows).select("stats", "y").mapInArrow(equations, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    values = np.zeros(len(upper[0]) + width + 1)
    values[sums["i"].to_numpy()] = sums["v"].to_numpy()
    a, n = np.zeros((width, width)), max(values[-1], 1.0)
    a[upper] = values[: len(upper[0])]
    a = a + a.T - np.diag(np.diag(a))
    model.weight = np.linalg.solve(a / n + RIDGE * np.eye(width), values[len(upper[0]) : -1] / n)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_stats_of(batch))), batch.column(1)], names=["raw", "y"])

    def binned(rows: Column) -> list:
        at = F.floor((F.col("raw") + 1) * (BINS / 3))
        return known.where(rows).select("stats", "y").mapInArrow(raw, "raw double, y double").groupBy(at.alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()

    bins = binned(calibration_rows) or binned(fit_rows)
    model.knots, model.levels = isotonic(*(np.array([r[k] for r in bins], float) for k in ("raw", "y", "n")))
    return model


def score_stats(stats: DataFrame, model: Model) -> DataFrame:
    """stats with score and predicted in place of the column stats."""
    spark = stats.sparkSession
    sent = spark.sparkContext.broadcast(model)
    keep = [c for c in stats.columns if c not in ("stats", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            score = sent.value.score(_stats_of(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep)
    return stats.select("stats", *keep).mapInArrow(run, f"{fields}, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    return _scored(docs, labels, [])


def _scored(docs: DataFrame, labels: DataFrame, more: list[str]) -> DataFrame:
    """The same with further columns of docs.

    Learned from labels of documents whose crc32(doc_id) mod 5 is not 0: remainder 4 calibrates, 1 to 3 fit.
    """
    rest = fold(F.col("doc_id"), 5)
    stats = save(extract(docs, ["doc_id", *more]), "quality-stats")
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (rest != 0)).groupBy(F.col("doc_id").alias("of")).agg(F.avg("quality").alias("y"))
    known = stats.join(marks, stats.doc_id == marks.of).select("stats", "doc_id", "y")
    model = fit(known, rest.isin(1, 2, 3), rest == 4)
    return score_stats(stats.withColumn("held_out", rest == 0), model)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps. Scores are joined back by doc_id and a hash of the text, which equal rows share."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rejected = save(_scored(docs.withColumn("_key", key), labels, ["_key"]).where("predicted = 0").select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).distinct(), "quality-rejected")
    few = rejected.count() <= FEW_IDS
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))
    return docs.withColumn("_key", key).join(F.broadcast(rejected) if few else rejected, same, "left_anti").select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
