"""A quality classifier over learned subword embeddings, trained by stochastic gradient descent in NumPy.

A document's features are hashed words, hashed character n-grams inside words (a blank marks each word's ends)
and a mark for every word that repeats the one before it. Each bucket has a learned vector; a document is
the mean of its features' vectors, and a softmax over two classes gives the score. Since that mean is linear,
scoring needs one number per bucket: the vector's product with the difference of the two output rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from qualitylab.llm.shared import arrow_texts, values, word_hashes

#: log2 of the buckets of words, and of those of n-grams; sizes of the n-grams in characters (code points).
BITS, GRAMS = 17, (3, 4)
BUCKETS = (2 << BITS) + 1
#: Labelled rows that training may use, those with the smallest hashes of their ids; epochs, rate, width.
MAX_ROWS, EPOCHS, RATE, WIDTH, SEED = 4096, 4, 0.5, 16, 7


def features(text: str | None) -> np.ndarray:
    """Bucket of every feature of a text, with repetitions."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.empty(0, np.int64)
    hashed = word_hashes(words)
    out = [(hashed >> np.uint64(64 - BITS)).astype(np.int64)]
    spaced = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    raw = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = raw == 32
    for n in GRAMS:
        size = len(raw) - n + 1
        if size < 1:
            continue
        value, inside = np.zeros(size, np.uint32), np.ones(size, bool)
        for i in range(n):
            value = value * np.uint32(0x01000193) + raw[i:i + size]
            if 0 < i < n - 1:
                inside &= ~blank[i:i + size]
        value = value[inside] * np.uint32(0x9E3779B1) + np.uint32(n)
        out.append((value >> np.uint32(32 - BITS)).astype(np.int64) + (1 << BITS))
    out.append(np.full(int((hashed[1:] == hashed[:-1]).sum()), BUCKETS - 1))
    return np.concatenate(out)


def counted_features(text: Column) -> Column:
    """The distinct features of each text and how often each occurs."""

    @arrow_udf("struct<buckets:array<int>,counts:array<int>>")
    def counted(texts: pa.Array) -> pa.Array:
        rows = []
        for t in values(texts):
            buckets, counts = np.unique(features(t), return_counts=True)
            rows.append({"buckets": buckets, "counts": counts})
        return pa.array(rows, pa.struct([("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))

    return counted(text)


def int_lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a column of integer lists as views of its buffers, without a Python object for each number."""
    out = []
    for chunk in column.chunks:
        ends, numbers = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [numbers[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


@dataclass(frozen=True)
class Model:
    """What scoring needs: one weight per bucket, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Probability of label 1; a text without words has the bias alone."""
        found = features(text)
        mean = float(self.weights[found].mean()) if len(found) else 0.0
        return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE,
          width: int = WIDTH, seed: int = SEED) -> Model:
    """Fit the embeddings and the softmax layer to (buckets, counts, label) rows, in a seeded random order.
    Without rows of both labels every text scores the share of label 1 (0.5 without rows)."""
    labels = [y for _, _, y in rows]
    share = (sum(labels) + 1) / (len(labels) + 2)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    chance = np.random.default_rng(seed)
    vectors = (chance.random((BUCKETS, width), np.float32) - np.float32(0.5)) / np.float32(width)
    output = np.zeros((2, width), np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in chance.permutation(len(rows)):
            buckets, counts, label = rows[i]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            if not len(buckets):
                continue
            part = (counts / counts.sum()).astype(np.float32)
            mean = part @ vectors[buckets]
            logits = output @ mean + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = error @ output
            output -= step * np.outer(error, mean)
            bias -= step * np.float32(0.1) * error
            vectors[buckets] -= step * np.float32(len(buckets) ** 0.5) * part[:, None] * back
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; null ids have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def held_out(id_col: str) -> Column:
    """Rows that training never sees."""
    return F.coalesce(remainder(id_col) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = MAX_ROWS, **how) -> Model:
    """Train on the labelled documents outside the held-out part.

    At most ``max_rows`` ids are used (those with the smallest hashes), so the driver receives at most that
    many feature lists. Labels other than 0 and 1, null ids and null texts are left out; an id with several
    labels has the lowest, one with several texts the first of them in order.
    """
    arrow_texts(docs)
    usable = labels.filter(F.col(label_col).isin(0, 1) & (remainder(id_col) != 2))
    chosen = (usable.groupBy(id_col).agg(F.min(label_col).alias("label_"))
              .orderBy(F.xxhash64(id_col), id_col).limit(max_rows))
    texts = (docs.select(id_col, F.col(text_col).alias("text_")).filter(F.col("text_").isNotNull())
             .join(F.broadcast(chosen), id_col)  # max_rows short rows
             .groupBy(id_col, "label_").agg(F.min("text_").alias("text_")))
    found = texts.select(id_col, "label_", counted_features(F.col("text_")).alias("f")).toArrow()
    buckets, counts = (int_lists(pc.struct_field(found["f"], part)) for part in ("buckets", "counts"))
    ids, marks = found[id_col].to_pylist(), found["label_"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: str(ids[i]))
    return train([(buckets[i], counts[i], marks[i]) for i in order], **how)


def quality_score(text: Column, model: Model, spark) -> Column:
    """``model``'s score of each text, null and empty ones included."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([shared.value.score(t) for t in values(column)], pa.float64())

    return scored(text)


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id",
               text_col: str = "text", **how) -> DataFrame:
    """One row for each row of ``docs``: id, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts have no features and get the score of the bias. Repeated rows score alike. Only id
    and text are read; without usable labels every score is 0.5.
    """
    model = fit(docs, labels, id_col, text_col, **how)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"),
                         quality_score(F.col(text_col), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text",
                   **how) -> DataFrame:
    """The rows of ``docs``, unchanged, that score at least ``threshold``."""
    model = fit(docs, labels, text_col=text_col, **how)
    return docs.filter(quality_score(F.col(text_col), model, docs.sparkSession) >= threshold)
