"""Quality rules as a ledger: each rule is evaluated once, and policies are masks over its failure bits.

``ledger`` reads the text once and keeps, per document, the measurements and one bit per failed rule.
A policy names a version and the rules that reject; applying one, comparing two or leaving a rule out
(``ablations``) works on the bits alone, never on the text again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from qualitylab.llm.shared import arrow_texts, covered, strong_hashes, values, window_hashes

SYMBOLS = b"#*$%&|<>"
REPEAT_WIDTH = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Failure conditions over the measurements, in bit order. A new rule goes to the end: bits keep their meaning.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version, and the rules of which any failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICY = Policy("v1", tuple(RULES))


def repeated_windows(words: list[bytes], width: int = REPEAT_WIDTH) -> np.ndarray:
    """Where the windows begin that occur twice or more. Hashes find them; the words themselves are then compared."""
    _, which, times = np.unique(window_hashes(strong_hashes(words), width), return_inverse=True, return_counts=True)
    likely = np.flatnonzero(times[which] > 1).tolist()
    number = {w: i for i, w in enumerate({w for at in likely for w in words[at:at + width]})}
    windows = [tuple(number[w] for w in words[at:at + width]) for at in likely]
    found = Counter(windows)
    return np.array([at for at, w in zip(likely, windows, strict=True) if found[w] > 1], np.int64)


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    repeated = repeated_windows(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words), int(((joined & 0xC0) != 0x80).sum()), len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), int(covered(len(words), repeated, REPEAT_WIDTH).sum()),
    )


def measures(text: Column) -> Column:
    """MEASURES of each text, as a struct."""

    @arrow_udf(f"struct<{','.join(f'{m}:bigint' for m in MEASURES)}>")
    def measured(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = np.array([measure(t) for t in values(column)], np.int64).reshape(-1, len(MEASURES))
            yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], names=list(MEASURES))

    return measured(text)


def failures() -> Column:
    """The bits of all failed rules, over columns named as in MEASURES."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out.cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, the MEASURES and ``failed`` (bit i: rule i fails).

    Null and empty texts measure 0 everywhere and so fail ``few_words`` alone. Ids may be null or repeat;
    other columns are not read. An empty table gives an empty ledger.
    """
    measured = arrow_texts(docs).select(F.col(id_col), measures(F.col(text_col)).alias("m" if id_col != "m" else "m_"))
    return measured.select(id_col, f"{measured.columns[1]}.*").withColumn("failed", failures())


def passes(policy: Policy) -> Column:
    """Whether ``policy`` keeps a row of a ledger."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(book: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """For each rule of ``policy``: documents that fail it (``failing``), that fail nothing else in the policy
    and so would be kept without it (``only``), and all documents kept with it (``kept``).

    The ledger is first counted by its bits, at most 2^rules rows, whatever its size.
    """
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(1 << list(RULES).index(rule)).cast("long").alias("bit"))
        for rule in policy.rules]))
    zero = F.lit(0).cast("long")
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(zero)).alias("failing"),
             F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(zero)).alias("only"),
             F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(zero)).alias("kept"))
        .withColumn("policy", F.lit(policy.version))
    )
