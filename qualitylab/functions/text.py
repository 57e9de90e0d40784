"""Text clean-up and tokenising as plain Spark expressions (no Python workers)."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from qualitylab.functions import fixed

# White space as Unicode text knows it, written out so that it does not hang on a
# regex engine's idea of \s.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
OTHER_SPACES = "".join(
    c for c in map(chr, range(1, sys.maxunicode + 1)) if c.isspace() and c != " "
)
# A word character and its two edges.
WORD = r"[\p{L}\p{N}_]"
WORD_START = rf"(?<!{WORD})"
WORD_END = rf"(?!{WORD})"
NON_ASCII = r"[^\x00-\x7F]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside higher-order functions Spark re-evaluates an outer expression for every
    element; binding it as a lambda variable avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache(maxsize=1)
def _ascii_folding() -> tuple[str, str, str]:
    """Compatibility decomposition to ASCII, derived from the Unicode database.

    Returns characters with a one-letter ASCII form, those letters, and a JSON object of
    the characters whose ASCII form is longer (``½`` -> ``12``, ``…`` -> ``...``).
    """
    single, letters, longer = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single.append(char)
            letters.append(plain)
        elif plain:
            longer[char] = plain
    return "".join(single), "".join(letters), json.dumps(longer, ensure_ascii=False)


def fold_to_ascii(text: Column) -> Column:
    """NFKD-normalise and drop what is not ASCII.

    Decomposition works code point by code point, so a one-to-one ``translate`` handles
    nearly all letters; only text that still holds other characters is cut around them.
    """
    single, letters, longer = _ascii_folding()
    chars = "".join(json.loads(longer))
    special = rf"[[^\x00-\x7F]&&[{chars}]]"
    pieces = F.lit(rf"{special}|(?:[\x00-\x7F]|[^{chars}])+")
    table = F.from_json(F.lit(longer), "map<string,string>")

    def expand(rest: Column) -> Column:
        return F.array_join(
            F.transform(
                F.regexp_extract_all(rest, pieces, 0),
                lambda piece: F.when(
                    (F.char_length(piece) == 1) & piece.rlike(NON_ASCII),
                    F.coalesce(table[piece], piece),
                ).otherwise(piece),
            ),
            "",
        )

    folded = let(
        F.translate(text, single, letters),
        lambda rest: F.when(
            rest.rlike(NON_ASCII),
            F.regexp_replace(
                F.when(rest.rlike(special), expand(rest)).otherwise(rest), NON_ASCII + "+", ""
            ),
        ).otherwise(rest),
    )
    return F.when(text.rlike(NON_ASCII), folded).otherwise(text)


def strip_tags(text: Column) -> Column:
    """Replace every HTML tag by a blank."""
    return F.regexp_replace(text, r"<[^>]+>", " ")


def expand_contractions(text: Column, table: Sequence[tuple[str, str]] = tuple(fixed.CONTRACTIONS)) -> Column:
    """Replace short forms in table order; case matters."""
    for short, full in table:
        text = F.replace(text, F.lit(short), F.lit(full))
    return text


def drop_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}+", " ")


def drop_punctuation(text: Column) -> Column:
    """Of folded text keep letters, digits, ``_`` and ``. ! ? '``; blank the rest.

    ``translate`` is several times faster here than a regex class of many ranges.
    """
    kept = "_.!?'"
    other = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c in kept))
    return F.translate(text, other, " " * len(other))


def squeeze(text: Column) -> Column:
    """Make every run of white space one blank, and trim."""
    return F.trim(F.regexp_replace(text, f"{SPACES}+", " "))


def single_blanks(text: Column) -> Column:
    """The same for text whose only white space is the blank."""
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def clean(text: Column, remove_numbers: bool = False) -> Column:
    """Whole clean-up; null and empty give ``""``. Words end up one blank apart."""
    out = F.lower(expand_contractions(strip_tags(fold_to_ascii(text))))
    if remove_numbers:
        out = drop_digits(out)
    return F.coalesce(single_blanks(drop_punctuation(out)), F.lit(""))


def split_words(text: Column) -> Column:
    """Words between white space, no empties; null stays null."""
    blanks = F.translate(text, OTHER_SPACES, " " * len(OTHER_SPACES))
    return F.array_remove(F.split(blanks, " ", -1), "")


def tokenize(
    cleaned: Column,
    stop_words: Sequence[str] | None = None,
    extra_stop_words: Sequence[str] = (),
    min_length: int = 2,
) -> Column:
    """Tokens of cleaned text: stop words and short words dropped.

    Pass ``stop_words=[]`` to keep every word.
    """
    stops = list(fixed.STOP_WORDS if stop_words is None else stop_words) + list(extra_stop_words)
    words = F.split(cleaned, " ")
    if not stops:
        return F.filter(words, lambda word: F.char_length(word) >= min_length)
    return F.filter(
        words, lambda word: (F.char_length(word) >= min_length) & ~word.isin(stops)
    )


def letters_only(text: Column) -> Column:
    """Normaliser in front of TF-IDF: lower case, ``a-z`` words one blank apart."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(text, rf"^{SPACES}+|{SPACES}+$", "")


def sentences(text: Column) -> Column:
    """Sentences: cut at white space that follows ``. ! ?``."""
    return F.split(text, rf"(?<=[.!?]){SPACES}+", -1)


def keyword_candidates(text: Column, min_length: int = 4) -> Column:
    """Lower-cased ASCII words of at least ``min_length`` letters standing alone."""
    pattern = rf"{WORD_START}[a-zA-Z]{{{min_length},}}{WORD_END}"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def split_list(text: Column, separator: str = "|") -> Column:
    """A delimited list held in one string."""
    return F.split(text, "[" + ("\\" if separator in "\\^]" else "") + separator + "]", -1)


def token_count(text: Column) -> Column:
    """Number of words between white space; null counts 0."""
    return F.coalesce(F.size(split_words(text)), F.lit(0))


def contains_stem(text: Column, stems: Sequence[str]) -> Column:
    """1 when a word starts with one of ``stems`` (any case), else 0; null gives 0."""
    pattern = rf"(?iu){WORD_START}(?:{'|'.join(stems)})"
    return F.coalesce(text.rlike(pattern).cast("int"), F.lit(0))
