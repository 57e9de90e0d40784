"""Token counts by a public byte-level BPE tokenizer, without keeping the tokens.

Every text is cut where a word ends before a blank or line break, and a piece that is still long (text without
blanks) where letters or digits end. The tokenizer's own pattern never joins what is on both sides of such a place,
so the counts of the pieces add up to that of the text. Only a single run of letters, digits or symbols stays whole.
Short pieces that a process has met are not encoded again; new ones go to the tokenizer in batches of bounded bytes,
and what is remembered is bounded in bytes. Only lengths leave the function.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from qualitylab.llm.shared import arrow_texts, values

#: UTF-8 bytes of new pieces in one call of the tokenizer, and of the pieces that a process remembers (each is counted with what
#: its entry takes besides).
BATCH_BYTES, REMEMBERED, ENTRY = 1 << 18, 64 << 20, 100
#: Characters from which a piece is cut further and not remembered.
LONG = 256

#: A blank after white space, or at an end: here cutting at each blank would not be safe.
_UNEVEN = re.compile(r"\s |^ | $")
_PIECE = re.compile(r"\s*\S+|\s+")
#: Special strings are one token and never cut.
_SPECIAL = re.compile(r"(<\|endoftext\|>)")
#: A run of letters or digits with the symbols before it. What follows a run is never joined to it; letters after an apostrophe are.
_RUN = regex.compile(r"[^\p{L}\p{N}]*(?:\p{L}+|\p{N}+)|[^\p{L}\p{N}]+")


def safe_pieces(text: str) -> list[str]:
    """Cut ``text`` where white space follows another character; joined again they give ``text``."""
    return _PIECE.findall(text)


def short_pieces(piece: str) -> list[str]:
    """Cut a long piece at its special strings and after its runs of letters and digits."""
    return [run for part in _SPECIAL.split(piece) if part for run in ([part] if _SPECIAL.match(part) else _RUN.findall(part))]


def n_bytes(piece: str) -> int:
    return len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))


def batches(pieces: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of pieces with at most ``limit`` bytes together (a longer piece stands alone)."""
    out, size = [], 0
    for piece in pieces:
        own = n_bytes(piece)
        if out and size + own > limit:
            yield out
            out, size = [], 0
        out.append(piece)
        size += own
    if out:
        yield out


class Counter:
    """Counts tokens; ``encode`` maps a list of strings to their numbers of tokens."""

    def __init__(self, encode: Callable[[list[str]], list[int]], remembered: int = REMEMBERED):
        self.encode, self.remembered, self.size = encode, remembered, 0
        #: Tokens of pieces as they stand, and of words with one blank before them.
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _encoded(self, parts: list[str]) -> Iterator[tuple[str, int]]:
        for batch in batches(parts):
            yield from zip(batch, self.encode(batch), strict=True)

    def _total(self, parts: list[str], known: dict[str, int], before: str) -> int:
        new = set(parts).difference(known)
        if not new:
            return sum(map(known.__getitem__, parts))
        rest = 0
        if any(len(part) > LONG for part in new):
            cut = [run for part in parts if len(part) > LONG for run in short_pieces(before + part)]
            rest = sum(n for _, n in self._encoded([run for run in cut if len(run) > LONG]))
            rest += self._total([run for run in cut if len(run) <= LONG], self.pieces, "")
            parts = [part for part in parts if len(part) <= LONG]
            new = set(parts).difference(known)
        # A text's own pieces are needed together, so they may go beyond the bound until the next text.
        if self.size > self.remembered:
            self.pieces.clear()
            self.words.clear()
            self.size, new = 0, set(parts)
        for part, n in self._encoded([before + part for part in new]):
            known[part[len(before):]] = n
            self.size += n_bytes(part) + ENTRY
        return rest + sum(map(known.__getitem__, parts))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if _UNEVEN.search(text):
            return self._total(safe_pieces(text), self.pieces, "")
        words = text.split(" ")
        return self._total([words.pop(0)], self.pieces, "") + self._total(words, self.words, " ")


#: One counter for each tokenizer in a Python worker, kept for its next tasks.
_counters: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    """This process's counter for one of the public tokenizer files."""
    if name not in _counters:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(public_tokenizers.path(name))
        loaded.no_truncation()
        loaded.no_padding()
        _counters[name] = Counter(lambda batch: [len(x) for x in loaded.encode_batch_fast(batch, add_special_tokens=False)])
    return _counters[name]


def n_tokens(text: Column, tokenizer: str = "byte_bpe_50k.json") -> Column:
    """Tokens of each text by the named file; null and empty texts have none."""

    @arrow_udf("long")
    def lengths(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(tokenizer).count
        for column in columns:
            yield pa.array(map(count, values(column)), pa.int64())

    return lengths(text)


def token_counts(docs: DataFrame, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    Null and empty texts count 0 bytes and 0 tokens. Ids may be null or repeat: rows are counted one by
    one. Other columns are not read, whatever their names. An empty table gives an empty table.
    """
    counted = arrow_texts(docs).select(
        F.col(id_col),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        n_tokens(F.col(text_col), tokenizer).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
