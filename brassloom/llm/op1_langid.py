"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of all its letter n-grams (two to four
letters of a word, its ends marked), hashed into a fixed number of buckets; a
linear softmax over the average gives the languages' probabilities. Embeddings
and softmax are trained together by stochastic gradient descent in numpy, on a
bounded sample (``SAMPLE`` documents of at most ``LONGEST`` code points in all, an
equal share of each language, so that rare ones are learned as well, but no less than
``EACH``; chosen by a hash of id and text). The ``LANGUAGES`` most frequent values of
lang are learned; a bound of the model, not of the documents that it reads. A second sample sets the temperature that makes probabilities honest,
and the least probability at which a prediction is accepted.

As the average and the softmax are linear, embeddings and weights are multiplied
once before prediction: each n-gram then adds one number per language.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is
every text if nothing could be learned. Whole texts are read, in slices, so that
a very long one needs no more memory. Each row is predicted from its text alone.
Labelled rows without a doc_id are drawn by their texts; repeated ones are learned once.
Further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brassloom.llm.common import fold, ship, small_batches, table

BUCKETS = 1 << 16
WIDTH = 16
EPOCHS = 4
#: Documents that are learned from, and as many code points at most in each; a quarter of them serves calibration.
SAMPLE, LONGEST = 4000, 20_000
#: Documents that a language gets of the sample at least, and languages that are learned, the most frequent ones: a bucket has a number for each, 52 MB for 200, which go to every worker.
EACH, LANGUAGES = 20, 200
#: Share of wrong predictions that may be among the accepted ones.
ERRORS = 0.01
SLICE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, slice by slice."""
    for at in range(0, len(text), SLICE):
        # A slice also gets what n-grams over its end need; a character before its start marks whether a word began.
        part = text[max(at - 1, 0) : at + SLICE + 3].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.zeros(len(codes) + 2, np.uint32)
        c[1:-1] = np.where(_letters()[codes], codes, 0)
        a, b = c[:-1], c[1:]
        h = (a * np.uint32(0x9E3779B1) ^ b) * np.uint32(0x85EBCA6B)
        found = [h[(a != 0) | (b != 0)]]
        if len(c) > 2:
            h = (h[:-1] ^ c[2:]) * np.uint32(0xC2B2AE35)
            inner = c[1:-1] != 0
            found.append(h[inner])
            if len(c) > 3:
                h = (h[:-1] ^ c[3:]) * np.uint32(0x27D4EB2F)
                found.append(h[inner[:-1] & inner[1:]])
        yield np.concatenate(found) >> np.uint32(16)


@dataclass
class Model:
    """langs in code point order; votes: what each bucket adds for each of them."""

    langs: list[str]
    votes: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        """None if the text has no letter."""
        total, n = np.zeros(len(self.langs)), 0
        for g in grams(text):
            total += self.votes[g].sum(0, dtype=np.float64)
            n += len(g)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if text and self.langs else None
        if z is None:
            return "und", 0.0
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Fit on three quarters of the texts, calibrate on the rest."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng, bags = np.random.default_rng(seed), []
    for text in texts:
        ids, counts = np.unique(np.concatenate([*grams(text), np.empty(0, np.uint32)]), return_counts=True)
        bags.append((ids, (counts / max(counts.sum(), 1)).astype(np.float32)))
    y = np.searchsorted(names, langs)
    order = rng.permutation(len(texts))
    held = order[: len(order) // 4] if len(order) >= 20 else order
    learn = order[len(order) // 4 :] if len(order) >= 20 else order
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, k = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            ids, weight = bags[i]
            rate = np.float32(2.0 * (1 - k / steps))
            k += 1
            if not len(ids):
                continue
            rows = emb[ids]
            mean = weight @ rows
            slope = _softmax(mean @ out + bias)
            slope[y[i]] -= 1
            back = out @ slope
            out -= rate * np.outer(mean, slope)
            bias -= np.float32(0.1) * rate * slope
            # Each bucket's share of the average is small, so its step is scaled up; the factor keeps long texts stable.
            emb[ids] = rows - rate * np.outer(weight * np.float32(20), back)
    model = Model(names, emb @ out, bias.astype(np.float64))
    _calibrate(model, [texts[i] for i in held], y[held])
    return model


def _calibrate(model: Model, texts: list[str], y: np.ndarray) -> None:
    """Set the temperature of least loss, and the least score at which few enough of the accepted are wrong."""
    z = [(model.logits(t), k) for t, k in zip(texts, y)]
    z, y = np.array([a for a, _ in z if a is not None]), np.array([k for a, k in z if a is not None], int)
    if not len(z):
        return
    loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.05, 20, 121)}
    model.temperature = float(min(loss, key=loss.get))
    p = _softmax(z / model.temperature)
    score, wrong = p.max(1), p.argmax(1) != y
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(wrong[order]) <= ERRORS * np.arange(1, len(y) + 1)
    model.accept = float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


def fit(labelled: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Train on a bounded sample of labelled (doc_id, text, lang); which rows it takes depends on the rows alone, not on their order."""
    # Rows without an id are told apart by their texts; equal rows are one.
    key = F.xxhash64("doc_id", "text")
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    if not counts:
        return train([], [])
    share = max(EACH, sample // len(counts))
    # The hash lets through little more than a language's share, so that tasks don't send many texts each.
    parts = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, int(min(1.0, 1.5 * share / r.n) * (1 << 30)))])
    drawn = known.where(F.pmod(key, F.lit(1 << 30)) < F.coalesce(parts[F.col("lang")], F.lit(0))).select(key.alias("key"), "text", "lang")
    drawn = drawn.groupBy("lang", "key").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))
    rows = drawn.withColumn("_n", nth).where(F.col("_n") <= share).orderBy("key", "text").collect()
    return train([r.text for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and accepted (false where the calibrated score is too low to be trusted)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS rows, whatever the input
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    at = kept.index(text)
    names = [c for c in kept if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in small_batches(batches):
            found = [m.predict(x) for x in batch.column(at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([a for a, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([a != "und" and s >= m.accept for a, s in found], pa.bool_())],
                names=[*names, "lang_pred", "score", "accepted"],
            )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*kept).mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
