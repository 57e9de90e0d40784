"""TF-IDF over n-grams as long ``(id, term, weight)`` rows, and truncated SVD on top.

Weights: sublinear ``1 + ln tf``, smooth ``ln((1+n)/(1+df)) + 1``, unit row length.

Without ``max_features`` fitting reads the text once and shuffles per-term sums: each row
sorts its own n-grams, so that the first of equal neighbours marks one document. With it,
most n-grams are too rare to be kept: ``ngrams`` counts only those that can be (two reads, at
most three), exactly. Transforming reads the text once more and shuffles the vocabulary's
terms of each document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from qualitylab.functions import fixed, text
from qualitylab.functions.text import let
from qualitylab.operators import ngrams as grams
from qualitylab.session import pin

BROADCAST_TERMS = 200_000  # a vocabulary of at most this many rows may be broadcast
LITERAL_TERMS = 5_000  # and one of at most this many may be a literal set
BLOCK_ROWS = 512  # rows of a dense block inside a Python worker
MAX_WIDTH = 8_192  # columns of a Gram matrix: 512 MB on the driver and in a task


def words(column: Column, stop_words: Sequence[str] = tuple(fixed.STOP_WORDS)) -> Column:
    """Normalised words of two letters or more without stop words."""
    stops = [word.strip() for word in stop_words]
    return text.tokenize(text.letters_only(column), stops, min_length=2)


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams of ``low`` to ``high`` words, joined by a blank."""

    def longer(grams: Column, ws: Column, size: int) -> Column:
        """Grams of ``size - 1`` words, each extended by the word after it."""
        many = F.greatest(F.size(ws) - size + 1, F.lit(0))
        return F.zip_with(
            F.slice(grams, 1, many), F.slice(ws, F.lit(size), many),
            lambda gram, word: F.concat(gram, F.lit(" "), word),
        )

    def climb(grams: Column, ws: Column, size: int) -> Column:
        """Grams of ``size`` words and of every size above, in one array."""
        if size == high:
            return grams
        above = let(longer(grams, ws, size + 1), lambda more: climb(more, ws, size + 1))
        return F.concat(grams, above) if size >= low else above

    return let(tokens, lambda ws: climb(ws, ws, 1))


def _term_counts(terms: Column) -> Column:
    """Array of ``(term, tf)`` of one row: equal terms are neighbours after sorting."""

    def runs(ordered: Column) -> Column:
        marked = F.transform(
            ordered,
            lambda t, i: F.when(
                F.coalesce(F.get(ordered, i - 1) != t, F.lit(True)),
                F.struct(t.alias("term"), i.alias("at")),
            ),
        )
        return let(
            F.array_compact(marked),
            lambda starts: F.transform(
                starts,
                lambda s, j: F.struct(
                    s["term"].alias("term"),
                    (F.coalesce(F.get(starts, j + 1)["at"], F.size(ordered)) - s["at"]).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(terms), runs)


@dataclass
class TfIdf:
    """Settings of a vectoriser; ``fit`` gives the vocabulary, ``transform`` the weights."""

    ngram_range: tuple[int, int] = (1, 1)
    max_features: int | None = None
    min_df: int = 1
    max_df: float = 1.0
    sublinear: bool = True
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS)

    def terms(self, column: str) -> Column:
        return ngrams(words(F.col(column), self.stop_words), *self.ngram_range)

    def _stops(self) -> list[str]:
        return [word.strip() for word in self.stop_words]

    def fit(self, df: DataFrame, column: str) -> DataFrame:
        """Vocabulary ``(term, index, df, total_tf, idf)``, indexed alphabetically.

        Terms outside the document-frequency limits go first, then all but the
        ``max_features`` most frequent (ties alphabetical).
        """
        rows = df.agg(F.count(F.lit(1))).first()[0]

        def allowed(counts: DataFrame) -> DataFrame:
            counts = counts.withColumn("_rows", F.lit(rows))
            return counts.where((F.col("df") >= self.min_df) & (F.col("df") <= self.max_df * F.col("_rows")))

        if self.max_features is None:
            kept = allowed(df.select(F.inline(_term_counts(self.terms(column)))).groupBy("term").agg(
                F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf")
            ))
        else:
            cleaned = df.select(text.letters_only(F.col(column)).alias("cleaned"))
            counts = grams.leading(cleaned, self.ngram_range, self._stops(), allowed, self.max_features)
            kept = allowed(counts).orderBy(F.desc("total_tf"), "term").limit(self.max_features)
        idf = F.log((1 + F.col("_rows")) / (1 + F.col("df"))) + 1
        chosen = kept.select("term", "df", "total_tf", idf.alias("idf"))
        from qualitylab.operators import ordering

        return ordering.with_running_sum(chosen, ["term"], None, "index")

    def transform(self, df: DataFrame, column: str, vocabulary: DataFrame, key: str = "id") -> DataFrame:
        """Rows ``(key, term, index, weight)`` of terms in the vocabulary."""
        if self.max_features is not None and self.max_features <= LITERAL_TERMS:
            return self._transform_few(df, column, vocabulary, key)
        if self.max_features is not None and self.max_features <= BROADCAST_TERMS:
            vocabulary = F.broadcast(vocabulary)  # at most max_features rows
        counts = df.select(key, F.inline(_term_counts(self.terms(column))))
        tf = 1 + F.log("tf") if self.sublinear else F.col("tf").cast("double")
        raw = counts.join(vocabulary, "term").select(
            key, F.struct("index", "term", (tf * F.col("idf")).alias("w")).alias("e")
        )
        # All terms of a row sit in one partition, so lists are complete before the shuffle.
        lists = raw.groupBy(key).agg(F.collect_list("e").alias("es")).withColumn(
            "length", F.sqrt(F.aggregate("es", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
        )
        return lists.select(key, "length", F.inline("es")).select(
            key, "term", "index", (F.col("w") / F.col("length")).alias("weight")
        )

    def _transform_few(self, df: DataFrame, column: str, vocabulary: DataFrame, key: str) -> DataFrame:
        """The same with a vocabulary that every task holds: a document's terms leave a task as one row."""
        known = vocabulary.select("term", "index", "idf").orderBy("index").collect()  # at most LITERAL_TERMS rows
        if not known:
            kind = dict(df.dtypes)[key]
            return df.sparkSession.createDataFrame([], f"{key} {kind}, term string, index bigint, weight double")
        cleaned = df.select(key, text.letters_only(F.col(column)).alias("cleaned"))
        found = grams.known(cleaned, key, [(row["term"], row["idf"]) for row in known], self._stops(), self.sublinear)
        lists = found.groupBy(key).agg(F.flatten(F.collect_list("es")).alias("es")).withColumn(
            "length", F.sqrt(F.aggregate("es", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
        )
        term, index = F.lit([row["term"] for row in known]), F.lit([row["index"] for row in known]).cast("array<bigint>")
        return lists.select(key, "length", F.inline("es")).select(
            key, F.get(term, F.col("place")).alias("term"), F.get(index, F.col("place")).alias("index"),
            (F.col("w") / F.col("length")).alias("weight"),
        )


PROMPT_TFIDF = dict(ngram_range=(1, 2), max_features=500, min_df=2, max_df=0.9)
RESPONSE_TFIDF = dict(ngram_range=(1, 3), max_features=1000, min_df=2, max_df=0.85)
BIGRAM_TFIDF = dict(ngram_range=(2, 2), max_features=200, min_df=2)
TRIGRAM_TFIDF = dict(ngram_range=(3, 3), max_features=100, min_df=2)


def top_terms(weights: DataFrame, n: int = 15) -> DataFrame:
    """Terms with the largest summed weight."""
    return weights.groupBy("term").agg(F.sum("weight").alias("total")).orderBy(
        F.desc("total"), "term"
    ).limit(n)


def hstack(blocks: Sequence[tuple[DataFrame, int]], key: str = "id") -> DataFrame:
    """Put sparse blocks side by side: block indices are shifted by the widths before."""
    shift, parts = 0, []
    for weights, width in blocks:
        parts.append(weights.select(key, (F.col("index") + shift).alias("index"), "weight"))
        shift += width
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def to_rows(weights: DataFrame, width: int, key: str = "id", all_keys: DataFrame | None = None) -> DataFrame:
    """One sparse row per key: sorted ``indices`` and their ``values`` (at most ``width``)."""
    rows = weights.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("_e")
    )
    if all_keys is not None:
        rows = all_keys.select(key).join(rows, key, "left")
    entries = F.coalesce("_e", F.array().cast("array<struct<index:bigint,weight:double>>"))
    return rows.select(
        key, F.lit(width).alias("width"),
        F.transform(entries, lambda e: e["index"].cast("int")).alias("indices"),
        F.transform(entries, lambda e: e["weight"]).alias("values"),
    )


def _dense_blocks(indices: pa.Array, values: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sparse rows as dense blocks of at most BLOCK_ROWS rows; a block lives no longer than its product."""
    counts = pc.fill_null(pc.list_value_length(indices), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    places, numbers = (a.flatten().to_numpy(zero_copy_only=False) for a in (indices, values))
    ends = np.concatenate([[0], np.cumsum(counts)])
    for first in range(0, len(counts), BLOCK_ROWS):
        last = min(first + BLOCK_ROWS, len(counts))
        cells = slice(ends[first], ends[last])
        block = np.zeros((last - first, width))
        block[np.repeat(np.arange(last - first), counts[first:last]), places[cells]] = numbers[cells]
        yield block


@dataclass
class TruncatedSvd:
    """Right singular vectors (``width`` × ``k``) of an uncentred matrix."""

    vectors: np.ndarray
    singular_values: np.ndarray

    def transform(self, rows: DataFrame, name: str = "svd") -> DataFrame:
        """Add the projection as an array column; the factor goes to the tasks once, and a block of rows is one matrix product."""
        shared = rows.sparkSession.sparkContext.broadcast(self.vectors)

        @arrow_udf("array<double>")
        def project(indices: pa.Array, values: pa.Array) -> pa.Array:
            factor = shared.value
            width, k = factor.shape
            parts = [block @ factor for block in _dense_blocks(indices, values, width)]
            flat = np.concatenate(parts).ravel() if parts else np.empty(0)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(indices) + 1) * k, pa.int32()), pa.array(flat))

        return rows.withColumn(name, project("indices", "values"))


def gram_rows(rows: DataFrame, width: int) -> DataFrame:
    """``(index, products)``: row by row the sums of products of a sparse matrix's columns, for columns with an entry.

    Every task sums the products of its own rows; what it sends on is one row of ``width`` numbers for each column
    that it met, and these are summed by index in as many tasks as there are partitions. Rows without entries add nothing.
    """
    if width > MAX_WIDTH:
        raise ValueError(f"{width} columns: the Gram matrix takes {MAX_WIDTH} at most, set max_features")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for block in _dense_blocks(batch["indices"], batch["values"], width):
                total += block.T @ block
        met = np.flatnonzero(total.diagonal())
        for some in np.array_split(met, -(-len(met) // BLOCK_ROWS) or 1):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * width, pa.int32()), pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), lists], ["index", "part"])

    parts = rows.select("indices", "values").mapInArrow(summed, "index int, part array<double>")
    return parts.groupBy("index").agg(Summarizer.sum(array_to_vector("part")).alias("products")).select(
        "index", vector_to_array("products").alias("products"))


def fit_svd(rows: DataFrame, width: int, k: int = 100) -> TruncatedSvd:
    """Truncated SVD of sparse rows from their Gram matrix: one pass over the rows.

    The driver receives ``width`` rows of ``width`` numbers, and ``width`` is bounded by ``max_features`` and MAX_WIDTH.
    Signs are arbitrary; the largest entry of each vector is made positive.
    """
    gram = np.zeros((width, width))
    for row in gram_rows(rows, width).collect():
        gram[row["index"]] = row["products"]
    values, v = np.linalg.eigh(gram)
    best = np.argsort(values)[::-1][: min(k, width)]
    v = v[:, best]
    signs = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return TruncatedSvd(v * np.where(signs == 0, 1, signs), np.sqrt(np.maximum(values[best], 0)))


def explained_variance(projected: DataFrame, weights: DataFrame, k: int, name: str = "svd") -> DataFrame:
    """``(component, ratio, cumulative)``: variance of each component over the total variance.

    ``projected`` has one row per matrix row; zero entries of ``weights`` are implied.
    """
    from pyspark.sql import Window as W

    n = projected.agg(F.count(F.lit(1))).scalar()
    per_term = weights.groupBy("index").agg(
        F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q")
    ).withColumn("n", n)
    total = per_term.agg(F.sum(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2)).scalar()
    parts = projected.select(F.posexplode(name).alias("component", "x")).groupBy("component").agg(
        F.var_pop("x").alias("v")
    )
    upto = W.orderBy("component").rowsBetween(W.unboundedPreceding, W.currentRow)  # k rows
    return parts.withColumn("ratio", F.col("v") / total).select(
        "component", "ratio", F.sum("ratio").over(upto).alias("cumulative")
    )


def fit_and_project(
    df: DataFrame, column: str, settings: TfIdf, k: int = 100, key: str = "id"
) -> tuple[DataFrame, DataFrame, TruncatedSvd]:
    """Vocabulary, projected rows and factor of one text column."""
    vocabulary = pin(settings.fit(df, column))
    width = vocabulary.count()
    weights = settings.transform(df, column, vocabulary, key)
    rows = pin(to_rows(weights, width, key, df))
    factor = fit_svd(rows, width, k)
    return vocabulary, factor.transform(rows).select(key, "svd"), factor
