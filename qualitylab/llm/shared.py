"""What the operators of this package share: written tables, and hashes of words in NumPy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitylab.session import scratch_path

#: Bytes hashed at a time; a longer single word makes its own, longer run.
RUN = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Odd multipliers of a window's first, second, ... word.
_PLACES = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


#: Rows of one Arrow batch for a Python worker: texts may be long, and a worker holds a batch in and one out.
BATCH_ROWS = 500


def arrow_texts(docs: DataFrame) -> DataFrame:
    """``docs``, after lowering the session's Arrow batch to BATCH_ROWS rows where it is larger, so that a Python
    worker's memory does not grow with the length of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(key)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(key, str(BATCH_ROWS))
    return docs


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the session's shared folder: later stages read its files, so a lost
    executor costs no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, *used: str) -> str:
    """``name``, lengthened until no used name equals it."""
    taken = {u.lower() for u in used}
    while name.lower() in taken:
        name += "_"
    return name


def values(column: pa.Array, at_once: int = 256) -> Iterator:
    """The Python values of an Arrow column, turned a few at a time so that a batch of long texts stays small."""
    for start in range(0, len(column), at_once):
        yield from column.slice(start, at_once).to_pylist()


def words_in(text: Column) -> Column:
    """Number of runs of characters other than blank and ``\\t`` to ``\\r``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a fixed bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, factor: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        step = np.full(max(n, RUN), factor, dtype=np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind][:n]


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    starts, out, first = ends - lengths, np.empty(len(words), np.uint64), 0
    every = np.frombuffer(b"".join(words), np.uint8)
    while first < len(words):
        at = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, at + RUN, "right")))
        run = every[at:ends[last - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(run) + 1, np.uint64)
        np.cumsum(run * _power("up", _BASE, len(run)), out=sums[1:])
        s, e = starts[first:last] - at, ends[first:last] - at
        out[first:last] = (sums[e] - sums[s]) * _power("down", _INVERSE, len(run) + 1)[s]
        first = last
    return mixed(out ^ (lengths.astype(np.uint64) * _BASE))


def strong_hashes(words: Sequence[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process: every (byte, place) is spread on its own before the sum, so that no
    arrangement of bytes collides by its structure."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    starts, out, first = ends - lengths, np.empty(len(words), np.uint64), 0
    every = np.frombuffer(b"".join(words), np.uint8)
    while first < len(words):
        at = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, at + RUN // 8, "right")))
        s, e = starts[first:last] - at, ends[first:last] - at
        place = (np.arange(e[-1]) - np.repeat(s, e - s)).astype(np.uint64)
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(mixed(((place << np.uint64(8)) | every[at:ends[last - 1]]) + _BASE), out=sums[1:])
        out[first:last] = sums[e] - sums[s]
        first = last
    return mixed(out ^ (lengths.astype(np.uint64) * _BASE))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words, from the words' hashes; none if there are fewer."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = hashes[:n] * _PLACES[0]
    for i in range(1, width):
        out += hashes[i:i + n] * _PLACES[i % 64] ^ np.uint64(i // 64)
    return mixed(out + np.uint64(width))


def covered(n: int, starts: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` places lie in any of the runs that begin at ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + widths, -1)
    return np.cumsum(edges[:-1]) > 0
