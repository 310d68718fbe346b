"""Quality classification by naive Bayes support vectors.

A text is the set of its n-grams: triples of bytes, and runs of one to four word shapes. A word's shape tells
whether it repeats the word before, holds symbols or digits, and begins or is written in capitals; words themselves
are left out, as rare ones say little about quality. Each n-gram's indicator is scaled by its log-count ratio between the classes, vectors
are brought to unit length, and a linear model with hinge loss is fitted by dual coordinate descent. A sigmoid,
fitted to margins of texts that the model had not seen, turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.llm.byte_cnn import held_out
from spendscope.llm.byte_hash import joined, mix, word_hashes, words_of
from spendscope.llm.common import least_hashed, map_arrow, table

BITS = 18  # n-grams are hashed to so many bits
TRAIN_DOCS = 5000  # the bound of the training sample
THRESHOLD = 0.3
SHAPES = 4
COMMON = np.frombuffer(b".,;:'- \t\r\n", np.uint8)  # marks that ordinary prose has
BATCH_BYTES = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ngram_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct hashed n-grams of each text; none for null and empty texts."""
    batch: list[bytes] = []
    size = 0
    seen = np.zeros(1 << BITS, bool)
    for text in texts:
        raw = (text or "").encode()
        if batch and size + len(raw) > BATCH_BYTES:
            yield from _sets(batch, seen)
            batch, size = [], 0
        batch.append(raw)
        size += len(raw)
    yield from _sets(batch, seen)


def _sets(texts: list[bytes], seen: np.ndarray) -> Iterator[np.ndarray]:
    buffer, offsets = joined(texts)
    lower = np.frombuffer(buffer.translate(_LOWER), np.uint8).astype(np.uint64)
    triples = _bucket(mix(lower[:-2] | lower[1:-1] << np.uint64(8) | lower[2:] << np.uint64(16)))
    start, end = words_of(buffer)
    first = np.searchsorted(start, offsets)
    shape = word_shapes(buffer, start, end, first)
    runs, run = [], np.zeros(len(shape), np.uint64)
    for n in range(SHAPES):
        run = run[: max(0, len(shape) - n)] * np.uint64(64) + shape[n:] + np.uint64(1)
        runs.append(_bucket(mix(run + np.uint64(n + 1 << 48))))
    for i, raw in enumerate(texts):
        a, b = first[i], first[i + 1]
        seen[triples[offsets[i] : offsets[i] + max(0, len(raw) - 2)]] = True
        for n in range(SHAPES):
            seen[runs[n][a : max(a, b - n)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def word_shapes(buffer: bytes, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number below 32 for each word: repeats the one before in its text, symbol, digit, capital, all capitals."""
    data = np.frombuffer(buffer, np.uint8)
    hashes = word_hashes(buffer, start, end)
    again = np.zeros(len(start), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[first < len(start)]] = False

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[end] - sums[start]

    capital = (data >= 65) & (data <= 90)
    letters = capital | ((data >= 97) & (data <= 122)) | (data >= 128)
    digits = (data >= 48) & (data <= 57)
    symbols = count(~letters & ~digits & ~np.isin(data, COMMON)) > 0
    capitals = count(capital)
    flags = [again, symbols, count(digits) > 0, capital[start] if len(start) else capitals > 0, (capitals > 1) & (capitals >= count(letters & (data < 128)))]
    return sum(f.astype(np.uint64) << np.uint64(k) for k, f in enumerate(flags))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class NbSvm:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        length = float(np.sqrt((r * r).sum()))
        return self.bias + (float((r * self.weight[found]).sum()) / length if length else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def log_count_ratio(sets: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BITS), alpha)
    for found, label in zip(sets, labels, strict=True):
        counts[label, found] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def fit_margins(sets: list[np.ndarray], labels: np.ndarray, cost: float = 4.0, rounds: int = 8, seed: int = 5) -> NbSvm:
    """Dual coordinate descent for the hinge loss."""
    ratio = log_count_ratio(sets, labels)
    rows = []
    for found in sets:
        r = ratio[found]
        length = np.sqrt((r * r).sum())
        rows.append(r / length if length else r)
    sign = np.where(labels == 1, 1.0, -1.0)
    alpha, weight, bias = np.zeros(len(sets)), np.zeros(1 << BITS), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(sets)):
            found, x = sets[i], rows[i]
            gradient = sign[i] * (weight[found] @ x + bias) - 1
            size = float(x @ x) + 1
            new = min(max(alpha[i] - gradient / size, 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weight[found] += step * x
                bias += step
                alpha[i] = new
    return NbSvm(ratio, weight, bias)


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps on smoothed targets."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        h = np.array([[(w * margins * margins).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -2, 2), shift - np.clip(step[1], -2, 2)
    return float(slope), float(shift)


def train(sets: list[np.ndarray], labels: np.ndarray) -> NbSvm:
    """The model of all rows; its sigmoid from margins across two halves."""
    half = np.arange(len(sets)) % 2
    margins = np.zeros(len(sets))
    for part in (0, 1):
        inside, outside = np.flatnonzero(half == part), np.flatnonzero(half != part)
        if len(set(labels[inside].tolist())) < 2:
            inside = np.arange(len(sets))
        model = fit_margins([sets[i] for i in inside], labels[inside])
        margins[outside] = [model.margin(sets[i]) for i in outside]
    model = fit_margins(sets, labels)
    model.slope, model.shift = fit_sigmoid(margins, labels)
    return model


def training_sample(df: DataFrame, labels: DataFrame, text: str, label: str, doc_id: str, docs: int) -> tuple[list[np.ndarray], np.ndarray]:
    """n-grams and labels of at most ``docs`` labelled documents that are not held out, least by a hash of the id.

    Documents are joined with a chosen set of at most that many ids, so it can be broadcast.
    Of rows with the same id one is taken, that with the least hash of the text.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id), 5, 0))
    chosen = least_hashed(known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("label")), "doc_id", docs)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s.astype(np.int32) for s in ngram_sets(batch.column("text").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "label", "grams"]
        )

    found = map_arrow(
        rows.select("doc_id", F.col("label").cast("int").alias("label"), "text"), make,
        f"doc_id {df.schema[doc_id].dataType.simpleString()}, label int, grams array<int>",
    ).toArrow().sort_by("doc_id")
    grams = found["grams"].combine_chunks()
    if isinstance(grams, pa.ChunkedArray):
        grams = grams.chunk(0) if grams.num_chunks else pa.array([], pa.list_(pa.int32()))
    values, at = grams.values.to_numpy(), grams.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)][:docs], found["label"].to_numpy().astype(np.int64)[:docs]


def score_quality(
    df: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", doc_id: str = "doc_id",
    docs: int = TRAIN_DOCS, keep: tuple[str, ...] = (), model: NbSvm | None = None,
) -> DataFrame:
    """doc_id, held_out, score, predicted (and the ``keep`` columns), one row for each row of ``df``.

    Trains on a bounded sample of the labelled documents unless a model is given; of a document with several labels
    the least counts. Without labels of both classes every score is the share of ones, or 0.5. Null and empty texts
    have no n-grams and get the score of the model's bias. A null doc_id is not held out.
    """
    share = 0.5
    if model is None:
        sets, known = training_sample(df, labels, text, label, doc_id, docs)
        if len(set(known.tolist())) == 2:
            model = train(sets, known)
        elif len(known):
            share = float(known.mean())
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 2 ** BITS weights and ratios, whatever the data
    kept = df.select(
        F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), 5, 0).alias("held_out"), F.col(text).alias("text"),
        *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
    )

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        fitted = sent.value
        scores = [fitted.score(s) if fitted else share for s in ngram_sets(batch.column("text").to_pylist())]
        columns = {n: batch.column(n) for n in ("doc_id", "held_out", *(f"k{i}" for i in range(len(keep))))}
        columns |= {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    types = [df.schema[c].dataType.simpleString() for c in (doc_id, *keep)]
    schema = ", ".join([f"doc_id {types[0]}, held_out boolean", *(f"k{i} {t}" for i, t in enumerate(types[1:])), "score double, predicted int"])
    return map_arrow(kept, make, schema).toDF(doc_id, "held_out", *keep, "score", "predicted")


def op7_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
