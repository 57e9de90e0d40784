"""Benchmark passages in training text, found by a broadcast hash set of word windows.

A benchmark text's windows are its runs of ``width`` words (all its words, if it has fewer). The set
holds a 64-bit hash of each, sorted, and the items' words once: a document's windows are hashed as they pass,
and every hit is compared word by word before it counts. The set is broadcast in blocks of bounded size;
a larger benchmark takes more blocks, one scan of the documents for each, one block in memory at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from qualitylab.llm.shared import LOWER, arrow_texts, covered, fresh, values, window_hashes, word_hashes, written

WIDTH = 10
#: Bytes of benchmark text whose windows are broadcast at once; they take about sixteen times as much memory.
BLOCK_BYTES = 8 << 20
#: Lower case, and a blank for every ASCII character that is neither letter nor digit.
_NORMAL = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in LOWER)
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_HITS = ("struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>")


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class Windows:
    """The windows of a block of benchmark items: a sorted array of 64-bit hashes for each width, and each item's words once.

    Equal windows share one entry, which names the items that hold them; different windows of one hash are neighbours.
    """

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        self.names: list[str] = []
        self.texts: list[bytes] = []
        self.starts: list[np.ndarray] = []
        hashes: dict[int, list[np.ndarray]] = {}
        places: dict[int, list[tuple[int, int]]] = {}
        for name, text in dict.fromkeys(items):
            words = normal_words(text)
            k = min(width, len(words))
            if name is None or not k:
                continue
            found = window_hashes(word_hashes(words), k)
            hashes.setdefault(k, []).append(found)
            places.setdefault(k, []).append((len(self.names), len(found)))
            self.names.append(str(name))
            self.texts.append(b" ".join(words))
            self.starts.append(np.cumsum([0, *(len(w) + 1 for w in words)]).astype(np.int32))
        #: width -> hashes, item and place of one holder, where its items begin and end in the list of items, and that list.
        self.tables = {k: self._table(k, np.concatenate(found), places[k]) for k, found in hashes.items()}

    def _table(self, k: int, hashes: np.ndarray, places: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        item = np.repeat(np.array([i for i, _ in places], np.int32), [n for _, n in places])
        at = np.concatenate([np.arange(n, dtype=np.int32) for _, n in places])
        order = np.argsort(hashes, kind="stable")
        hashes, item, at = hashes[order], item[order], at[order]
        firsts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        sizes = np.diff(np.append(firsts, len(hashes)))
        chosen, members = [firsts[sizes == 1]], [item[firsts[sizes == 1]]]
        counts = [np.ones(len(chosen[0]), np.int32)]
        for first, size in zip(firsts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            same: dict[bytes, list[int]] = {}
            for i in range(first, first + size):
                same.setdefault(self.words(int(item[i]), int(at[i]), k), []).append(i)
            for group in same.values():
                holders = np.unique(item[group])
                chosen.append(np.array(group[:1]))
                counts.append(np.array([len(holders)], np.int32))
                members.append(holders)
        chosen, ends = np.concatenate(chosen), np.cumsum(np.concatenate(counts), dtype=np.int32)
        order = np.argsort(hashes[chosen], kind="stable")
        chosen, starts = chosen[order], np.concatenate([[0], ends[:-1]]).astype(np.int32)[order]
        return hashes[chosen], item[chosen], at[chosen], starts, ends[order], np.concatenate(members)

    def words(self, item: int, at: int, k: int) -> bytes:
        """``k`` words of an item from its ``at``-th on, joined by blanks."""
        starts = self.starts[item]
        return self.texts[item][starts[at]:starts[at + k] - 1]

    def hits(self, words: list[bytes]) -> tuple[list[int], list[int], list[str]]:
        """Starts and ends of the windows in ``words``, each compared word by word, and the names of their items, sorted."""
        hashed = word_hashes(words)
        starts, ends, items = [], [], set()
        for k, (wanted, item, place, first, last, members) in self.tables.items():
            found = window_hashes(hashed, k)
            at = np.searchsorted(wanted, found)
            at[at == len(wanted)] = 0
            for i in np.flatnonzero(wanted[at] == found).tolist():
                own, j = b" ".join(words[i:i + k]), int(at[i])
                while j < len(wanted) and wanted[j] == found[i]:
                    if self.words(int(item[j]), int(place[j]), k) == own:
                        starts.append(i)
                        ends.append(i + k)
                        items.update(members[first[j]:last[j]].tolist())
                        break
                    j += 1
        return starts, ends, sorted({self.names[i] for i in items})


def _scan(text: Column, shared) -> Column:
    """Hits of each text among the broadcast ``shared`` windows."""

    @arrow_udf(_HITS)
    def hits(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = shared.value
        for column in columns:
            rows = []
            for text in values(column):
                words = normal_words(text)
                starts, ends, items = windows.hits(words)
                rows.append({"n_words": len(words), "starts": starts, "ends": ends, "items": items})
            yield pa.array(rows, pa.struct([
                ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
                ("items", pa.list_(pa.string()))]))

    return hits(text)


def _cut(text: Column, starts: Column, ends: Column) -> Column:
    """Number of words in any run from ``starts`` to ``ends``, and the text without those runs of words."""

    @arrow_udf("struct<n_hit:bigint,kept:string>")
    def cut(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = []
        for t, s, e in zip(values(text), values(starts), values(ends), strict=True):
            if not s:
                rows.append({"n_hit": 0, "kept": t})
                continue
            places = [m.span() for m in _WORD.finditer(t)]
            hit = np.zeros(len(places) + 2, bool)
            hit[1:-1] = covered(len(places), np.array(s), np.array(e) - np.array(s))
            edges = np.flatnonzero(hit[1:] != hit[:-1])
            out, at = [], 0
            for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                out.append(t[at:places[first][0]])
                at = places[last - 1][1]
            rows.append({"n_hit": int(hit.sum()), "kept": "".join([*out, t[at:]])})
        return pa.array(rows, pa.struct([("n_hit", pa.int64()), ("kept", pa.string())]))

    return cut(text, starts, ends)


def benchmark_blocks(benchmark: DataFrame, blocks: int, id_col: str, text_col: str) -> Iterator[list]:
    """The benchmark's rows in ``blocks`` parts of about equal size, each collected when it is asked for."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield [(r.item, r.text) for r in part.collect()]


def _hits_by_block(docs: DataFrame, blocks: Iterator[list], width: int, text_col: str, name: str) -> DataFrame:
    """``docs``, written once with row numbers, with the hits of all blocks in ``name``. A block's windows are built,
    broadcast, used for one scan and given back before the next block is read; what a scan writes are a row's number and hits."""
    spark = docs.sparkSession
    row = fresh("row", name, *docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    scans = None
    for i, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(Windows(block, width))
        scanned = rows.select(row, _scan(F.col(text_col), shared).alias("h")).select(row, "h.*")
        # the first scan keeps rows without hits for their numbers of words
        found = written(scanned if i == 0 else scanned.filter(F.size("starts") > 0), "hits")
        shared.destroy()
        scans = found if scans is None else scans.union(found)
    merged = scans.groupBy(row).agg(F.max("n_words").alias("n_words"), *[
        F.flatten(F.collect_list(part)).alias(part) for part in ("starts", "ends", "items")])  # a row has at most one entry a block
    return rows.join(merged.select(row, F.struct("n_words", "starts", "ends", "items").alias(name)), row).drop(row)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, name: str, width: int = WIDTH,
                   block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """``docs`` with a column ``name`` of ``n_words``, ``n_hit``, ``items`` (sorted as strings) and ``kept``,
    the text without its hit runs of words. A benchmark of one block takes one scan and nothing else."""
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = benchmark_blocks(benchmark, -(-total // block_bytes) or 1, item_col, item_text)
    arrow_texts(docs)
    if total <= block_bytes:
        shared = docs.sparkSession.sparkContext.broadcast(Windows(next(blocks), width))
        scanned = docs.withColumn(name, _scan(F.col(text_col), shared))
    else:
        scanned = _hits_by_block(docs, blocks, width, text_col, name)
    hits = F.col(name)
    cut = _cut(F.col(text_col), hits["starts"], hits["ends"])
    return scanned.withColumn(name, F.struct(
        hits["n_words"].alias("n_words"), cut["n_hit"].alias("n_hit"),
        F.array_sort(F.array_distinct(hits["items"])).alias("items"), cut["kept"].alias("kept")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_words``, ``n_hit``, ``items`` and ``kept`` (the text without
    the hit words; null stays null).

    Null and empty texts have no words and no hits. Benchmark rows with a null id, a null text or no word
    are no items; repeated ones count once. Repeated documents are judged one by one; columns other than
    id and text are not read. An empty benchmark hits nothing.
    """
    text = how.get("text_col", "text")
    name = fresh("hits", id_col, text)
    return benchmark_hits(docs.select(id_col, text), benchmark, name, **how).select(id_col, f"{name}.*")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", max_hit: float = 0.0,
                      **how) -> DataFrame:
    """``docs``, same columns, without benchmark passages: ``remove='documents'`` drops every document of
    which more than ``max_hit`` of the words are hit, ``remove='spans'`` only cuts the hit words out."""
    text = how.get("text_col", "text")
    name = fresh("hits", *docs.columns)
    found = benchmark_hits(docs, benchmark, name, **how)
    if remove == "spans":
        return found.select(*[F.col(f"{name}.kept").alias(c) if c == text else F.col(c) for c in docs.columns])
    if remove != "documents":
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    return found.filter(F.col(f"{name}.n_hit") <= max_hit * F.col(f"{name}.n_words")).select(*docs.columns)
