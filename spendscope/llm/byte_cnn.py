"""Language identification by a convolutional network over bytes, trained and applied in numpy.

A text's lower-case UTF-8 bytes are cut into windows of fixed length. Filters of several widths slide over a window;
as bytes are one-hot, a filter's response is a sum of table rows, one for each byte under it. Each filter's largest
response in the window, rectified, goes to a softmax layer. A document's scores are the mean of its windows' by
their lengths, so the whole text counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendscope.llm.common import map_arrow, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
TRAIN_DOCS = 3000  # the bound of the training sample
TRAIN_CHARS = 2048  # of each document in it, from two places anywhere in its text
BATCH = 32
UNKNOWN = "und"


@dataclass
class ByteCnn:
    labels: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, filters)
    bias: np.ndarray  # (widths, filters)
    dense: np.ndarray  # (widths * filters, labels)
    offset: np.ndarray  # (labels,)

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator, filters: int = FILTERS) -> ByteCnn:
        tables = [rng.normal(0, 0.3 / w**0.5, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
        hidden = len(WIDTHS) * filters
        dense = rng.normal(0, hidden**-0.5, (hidden, len(labels))).astype(np.float32)
        return cls(labels, tables, np.zeros((len(WIDTHS), filters), np.float32), dense, np.zeros(len(labels), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.dense, self.offset]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest response of each filter in each window, and where it is."""
        best, places = [], []
        for table_, bias in zip(self.tables, self.bias, strict=True):
            n = windows.shape[1] - len(table_) + 1
            response = table_[0][windows[:, :n]]
            for k in range(1, len(table_)):
                response += table_[k][windows[:, k : k + n]]
            place = response.argmax(axis=1)
            best.append(np.take_along_axis(response, place[:, None], axis=1)[:, 0] + bias)
            places.append(place)
        return np.concatenate(best, axis=1), places

    def highest(self, windows: np.ndarray) -> np.ndarray:
        """As ``pooled``, without the places."""
        best = []
        for table_, bias in zip(self.tables, self.bias, strict=True):
            n = windows.shape[1] - len(table_) + 1
            response = table_[0].take(windows[:, :n], axis=0)
            for k in range(1, len(table_)):
                response += table_[k].take(windows[:, k : k + n], axis=0)
            best.append(response.max(axis=1) + bias)
        return np.concatenate(best, axis=1)

    def chances(self, windows: np.ndarray) -> np.ndarray:
        out = [softmax(np.maximum(self.highest(windows[i : i + BATCH]), 0) @ self.dense + self.offset) for i in range(0, len(windows), BATCH)]
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)

    def gradients(self, windows: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        pooled, places = self.pooled(windows)
        hidden = np.maximum(pooled, 0)
        error = softmax(hidden @ self.dense + self.offset)
        error[np.arange(len(wanted)), wanted] -= 1
        error /= len(wanted)
        back = (error @ self.dense.T) * (pooled > 0)
        grads, filters = [], self.bias.shape[1]
        rows = np.arange(len(windows))[:, None]
        for k, (table_, place) in enumerate(zip(self.tables, places, strict=True)):
            part, grad = back[:, k * filters : (k + 1) * filters], np.zeros_like(table_)
            for at in range(len(table_)):
                np.add.at(grad[at], (windows[rows, place + at], np.arange(filters)[None, :]), part)
            grads.append(grad)
        return [*grads, back.sum(axis=0).reshape(self.bias.shape), hidden.T @ error, error.sum(axis=0)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: str, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last padded with zeros, and their lengths in bytes."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    n = -(-len(raw) // window)
    padded = np.zeros(n * window, np.uint8)
    padded[: len(raw)] = raw
    lengths = np.full(n, window)
    if n:
        lengths[-1] = len(raw) - (n - 1) * window
    return padded.reshape(n, window), lengths


def examples(texts: list[str], labels: list[int], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows to learn from: up to two whole ones of a text, and one cut short, as short texts are."""
    x, y = [], []
    for text, label in zip(texts, labels, strict=True):
        windows, lengths = windows_of(text)
        chosen = [0] if len(windows) < 2 else [0, int(rng.integers(1, len(windows)))]
        for k in chosen:
            x.append(windows[k])
            y.append(label)
        short = windows[chosen[-1]].copy()
        short[int(rng.integers(12, 64)) :] = 0
        if lengths[chosen[-1]] >= 12:
            x.append(short)
            y.append(label)
    return np.stack(x), np.array(y)


def train(texts: list[str], langs: list[str], epochs: int = 8, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Adam on the cross-entropy; labels weigh as often as they occur."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    x, y = examples(texts, [labels.index(v) for v in langs], rng)
    model = ByteCnn.fresh(labels, rng)
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    step, total = 0, epochs * -(-len(x) // 64)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            part = order[at : at + 64]
            step += 1
            now = rate * (1 - 0.9 * step / total)
            for p, g, m, v in zip(model.parameters(), model.gradients(x[part], y[part]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def training_sample(df: DataFrame, text: str, lang: str, doc_id: str, docs: int, chars: int) -> tuple[list[str], list[str]]:
    """At most ``docs`` labelled texts that are not held out, least by a hash of the id.

    Every language has an equal share of them, or all its rows if these are fewer; of more languages than ``docs`` the
    most frequent ones are learned. Of texts longer than ``chars`` two stretches of half that length are taken, which
    begin at hashed places of the whole text.
    """
    known = df.where(F.col(lang).isNotNull() & ~held_out(F.col(doc_id), 4, 2)).select(
        F.xxhash64(F.col(doc_id), F.lit(29)).alias("at"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    ).where(F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(docs).collect()
    if not counts:
        return [], []
    share = max(1, docs // len(counts))
    # all but some twice the wanted rows are left out by their hash where they are read
    most = {r["lang"]: int(min(2**63 - 1, -(2**63) + 2 * (share + 8) * 2**64 // r["count"])) for r in counts}
    bound = F.create_map(*[x for k, v in most.items() for x in (F.lit(k), F.lit(v))])
    few = known.where(F.col("at") <= F.element_at(bound, F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))
    half, n = chars // 2, F.length("text")
    stretch = lambda k: F.substring("text", 1 + F.pmod(F.xxhash64("at", F.lit(k)), n - half + 1).cast("int"), F.lit(half))
    cut = F.when(n <= chars, F.col("text")).otherwise(F.concat(stretch(1), stretch(2)))
    rows = few.select("at", "lang", cut.alias("text")).withColumn("place", place).where(F.col("place") <= share).orderBy("lang", "place").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify_language(
    df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs: int = TRAIN_DOCS,
    chars: int = TRAIN_CHARS, keep: tuple[str, ...] = (), model: ByteCnn | None = None,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and the ``keep`` columns), one row for each row of ``df``.

    Trains on a bounded sample of the labelled rows unless a model is given. Texts that are null or have no letter
    are "und" with score 0, as is everything where there is nothing to learn from. Repeated rows get the same
    prediction. A null doc_id is not held out.
    """
    if model is None:
        texts, langs = training_sample(df, text, lang, doc_id, docs, chars)
        model = train(texts, langs) if texts else None
    kept = df.select(
        F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), 4, 2).alias("held_out"), F.col(text).alias("text"),
        *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
    )

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = [], []
        for value in batch.column("text").to_pylist():
            if model is None or not value or not any(map(str.isalpha, value)):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            windows, lengths = windows_of(value)
            mean = lengths @ model.chances(windows) / lengths.sum()
            best = int(mean.argmax())
            names.append(model.labels[best])
            scores.append(min(1.0, float(mean[best])))
        columns = {n: batch.column(n) for n in ("doc_id", "held_out", *(f"k{i}" for i in range(len(keep))))}
        columns |= {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    types = [df.schema[c].dataType.simpleString() for c in (doc_id, *keep)]
    schema = ", ".join([f"doc_id {types[0]}, held_out boolean", *(f"k{i} {t}" for i, t in enumerate(types[1:])), "lang_pred string, score double"])
    return map_arrow(kept, make, schema).toDF(doc_id, "held_out", *keep, "lang_pred", "score")


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
