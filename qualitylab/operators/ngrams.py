"""Counts of word n-grams in blocks of rows inside tasks, for vocabularies of bounded size.

Most n-grams of a corpus are rare, and shuffling each of them to keep a thousand costs many times the text. ``leading``
reads the text twice. The first time every n-gram is added to one of BUCKETS counters, whose size does not
hang on the corpus: a counter is at least the count of any n-gram in it. The second time only n-grams in the largest
counters are counted by their text. When the last place of the vocabulary has at least the count of the smallest counter
taken, no n-gram left out can belong to it; otherwise that place's count says which counters are needed, and these are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitylab.session import pin

BITS = 21
BUCKETS = 1 << BITS  # counters: 16 MB in a task and on the driver
SLICE = 1 << 13  # counters of a shuffled row
BLOCK_BYTES = 4 << 20  # text taken at once inside a task; one longer row is taken alone
FIRST_TAKEN, LEAST_TAKEN = 20, 20_000  # counters taken first: for each place of the vocabulary, and at least
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _blocks(texts: pa.Array, stops: Sequence[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, pa.Array]]:
    """For blocks of rows of cleaned text: their slice, the row (in the block) and code of each word, and the words by code.

    Stop words and words of one letter are left out."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
        lists = pc.split_pattern(texts.slice(start, end - start), " ")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        usable = pc.greater_equal(pc.utf8_length(words), 2).to_numpy(zero_copy_only=False)
        usable &= ~pc.is_in(words, value_set=pa.array(list(stops), words.type)).to_numpy(zero_copy_only=False)
        kept = usable[codes] if len(codes) else np.zeros(0, bool)
        yield slice(start, end), np.repeat(np.arange(end - start), sizes)[kept], codes[kept], words
        start = end


def _placed(rows: np.ndarray, codes: np.ndarray, words: pa.Array, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first words, counters) of all n-grams of a block."""
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)
    own = hashes[codes]
    at, chained = np.arange(len(codes)), own
    for size in range(1, high + 1):
        if size > 1:
            inside = at + size - 1 < len(rows)
            at, chained = at[inside], chained[inside]
            same = rows[at] == rows[at + size - 1]
            at = at[same]
            chained = (chained[same] ^ (chained[same] >> np.uint64(29))) * _MIX + own[at + size - 1]
        if size >= low:
            yield size, at, ((chained * _FACTOR) >> np.uint64(64 - BITS)).astype(np.int64)


def _counters(cleaned: DataFrame, sizes: tuple[int, int], stops: Sequence[str]) -> np.ndarray:
    """The counters of the whole column ``cleaned``, BUCKETS numbers."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, rows, codes, words in _blocks(batch["cleaned"], stops):
                for _, _, buckets in _placed(rows, codes, words, *sizes):
                    total += np.bincount(buckets, minlength=BUCKETS)
        yield from _slices({i: total[i * SLICE:(i + 1) * SLICE] for i in range(BUCKETS // SLICE)})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, held in zip(batch["slice"].to_pylist(), batch["held"].to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(held, np.int64)
        yield from _slices(total)

    schema = "slice int, held binary"
    parts = cleaned.mapInArrow(added, schema).repartition("slice").mapInArrow(summed, schema)
    out = np.zeros(BUCKETS, np.int64)
    for row in parts.collect():  # BUCKETS numbers, whatever the rows
        out[row["slice"] * SLICE:(row["slice"] + 1) * SLICE] = np.frombuffer(row["held"], np.int64)
    return out


def _slices(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    filled = {i: held for i, held in total.items() if held.any()}
    yield pa.RecordBatch.from_pydict({"slice": pa.array(list(filled), pa.int32()),
                                      "held": pa.array([held.tobytes() for held in filled.values()], pa.binary())})


def _counts(cleaned: DataFrame, sizes: tuple[int, int], stops: Sequence[str], taken: np.ndarray) -> DataFrame:
    """``(term, df, total_tf)`` of all n-grams whose counter is ``taken``."""
    shared = cleaned.sparkSession.sparkContext.broadcast(np.packbits(taken))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for _, rows, codes, words in _blocks(batch["cleaned"], stops):
                for size, at, buckets in _placed(rows, codes, words, *sizes):
                    at = at[wanted[buckets]]
                    if not len(at):
                        continue
                    gram = codes[at]
                    for i in range(1, size):  # a number for every pair of shorter n-gram and next word
                        gram = np.unique(gram, return_inverse=True)[1] * len(words) + codes[at + i]
                    _, first, gram = np.unique(gram, return_index=True, return_inverse=True)
                    pair, tf = np.unique(rows[at] * len(first) + gram, return_counts=True)
                    gram = pair % len(first)
                    term = [words.take(pa.array(codes[at[first] + i])) for i in range(size)]
                    yield pa.RecordBatch.from_arrays([
                        pc.binary_join_element_wise(*term, " ") if size > 1 else term[0],
                        pa.array(np.bincount(gram, minlength=len(first)), pa.int64()),
                        pa.array(np.bincount(gram, weights=tf, minlength=len(first)).astype(np.int64)),
                    ], ["term", "df", "total_tf"])

    return cleaned.mapInArrow(counted, "term string, df bigint, total_tf bigint").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))


def leading(
    cleaned: DataFrame, sizes: tuple[int, int], stops: Sequence[str], allowed: Callable[[DataFrame], DataFrame], places: int,
) -> DataFrame:
    """``(term, df, total_tf)`` of n-grams of the column ``cleaned``, exact, with all that are among the ``places`` most frequent
    ``allowed`` ones (ties included)."""
    held = _counters(cleaned, sizes, stops)
    first = min(BUCKETS, max(FIRST_TAKEN * places, LEAST_TAKEN))
    least = max(1, int(np.partition(held, BUCKETS - first)[BUCKETS - first]))
    counts = pin(_counts(cleaned, sizes, stops, held >= least))
    best = allowed(counts).orderBy(F.desc("total_tf")).limit(places)
    found, last = best.agg(F.count(F.lit(1)), F.min("total_tf")).first()
    needed = max(1, last) if found == places and places else 1
    # Every n-gram that was not counted has fewer than ``least`` occurrences.
    return counts if needed >= least else pin(_counts(cleaned, sizes, stops, held >= needed))


def known(cleaned: DataFrame, key: str, terms: Sequence[tuple[str, float]], stops: Sequence[str], sublinear: bool) -> DataFrame:
    """``(key, es)`` with ``es`` a list of (place in ``terms``, weight before scaling) for each row of ``(key, cleaned)`` that has any."""
    split = [term.split(" ") for term, _ in terms]
    vocabulary = sorted({word for term in split for word in term})
    code = {word: i for i, word in enumerate(vocabulary)}
    # Step by step: the numbers of known beginnings of n words, and the term that such a beginning is, or -1.
    steps, numbers = [], [code[term[0]] for term in split]
    for size in range(1, max(map(len, split)) + 1):
        if size > 1:
            longer = [i for i, term in enumerate(split) if len(term) >= size]
            values = {i: numbers[i] * len(vocabulary) + code[split[i][size - 1]] for i in longer}
            table = np.unique(np.array(list(values.values()), np.int64))
            for i, value in values.items():
                numbers[i] = int(np.searchsorted(table, value))
        else:
            table = np.arange(len(vocabulary))
        place = np.full(len(table), -1, np.int64)
        for i, term in enumerate(split):
            if len(term) == size:
                place[numbers[i]] = i
        steps.append((table, place))
    shared = cleaned.sparkSession.sparkContext.broadcast((vocabulary, steps, np.array([idf for _, idf in terms])))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, steps, idf = shared.value
        for batch in batches:
            for part, rows, codes, words in _blocks(batch["cleaned"], stops):
                looked = pc.index_in(words, value_set=pa.array(vocabulary, words.type))
                own = pc.fill_null(looked, -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
                at = np.flatnonzero(own >= 0)
                number, pairs = own[at], []
                for size, (table, place) in enumerate(steps, start=1):
                    if size > 1:
                        inside = at + size - 1 < len(rows)
                        at, number = at[inside], number[inside]
                        inside = (rows[at] == rows[at + size - 1]) & (own[at + size - 1] >= 0)
                        at, number = at[inside], number[inside] * len(vocabulary) + own[at[inside] + size - 1]
                        spot = np.minimum(np.searchsorted(table, number), len(table) - 1)
                        hit = table[spot] == number
                        at, number = at[hit], spot[hit]
                    term = place[number]
                    pairs.append(rows[at[term >= 0]] * len(idf) + term[term >= 0])
                pair, tf = np.unique(np.concatenate(pairs), return_counts=True)
                row, term = np.divmod(pair, len(idf))
                weight = ((1 + np.log(tf)) if sublinear else tf.astype(float)) * idf[term]
                some, counts = np.unique(row, return_counts=True)
                es = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(term, pa.int32()), pa.array(weight)], ["place", "w"]),
                )
                yield pa.RecordBatch.from_arrays([batch[key].slice(part.start, part.stop - part.start).take(pa.array(some)), es], [key, "es"])

    return cleaned.mapInArrow(found, f"`{key}` {dict(cleaned.dtypes)[key]}, es array<struct<place:int,w:double>>")
