"""Registry of queries over the shared tables, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from qualitylab.functions import fixed

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        """Decorator: register a query, and its SQL when given."""

        def keep(query: Query) -> Query:
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return keep


# --- SQL fragments shared by the oracles ------------------------------------------------
SPACE = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
         r"\x{202f}\x{205f}\x{3000}]")
WORD = r"[\p{L}\p{N}_]"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def words_sql(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '{SPACE}+'), lambda w: w <> '')"


def fold_sql(column: str) -> str:
    return f"regexp_replace(strip_accents({column}), '[^[:ascii:]]', '', 'g')"


def contractions_sql(column: str) -> str:
    for short, full in fixed.CONTRACTIONS:
        column = f"replace({column}, {quote(short)}, {quote(full)})"
    return column


def clean_sql(column: str) -> str:
    tags = f"regexp_replace({fold_sql(column)}, '<[^>]+>', ' ', 'g')"
    kept = f"regexp_replace(lower({contractions_sql(tags)}), '[^a-z0-9_.!?'']+', ' ', 'g')"
    return f"trim(regexp_replace({kept}, ' +', ' ', 'g'))"


def letters_sql(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '[^a-z]+', ' ', 'g'))"


def tokens_sql(cleaned: str, stops=None) -> str:
    stops = fixed.STOP_WORDS if stops is None else stops
    return (f"list_filter(string_split({cleaned}, ' '), "
            f"lambda w: length(w) >= 2 AND NOT list_contains({sql_list(stops)}, w))")


# --- the draws of augmentation, in SQL ------------------------------------------------------
def root_sql(key: str, seed: int, *what: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {key}, {', '.join(quote(str(w)) for w in (seed, *what))})), 1, 7) AS BIGINT)"


def drawn_sql(start: str, i: str) -> str:
    x = f"(({start} + ({i} + 1) * 48271) % 2147483647)"
    y = f"(({x} * {x} + {start}) % 2147483647)"
    return f"(({y} * {y} + {x}) % 2147483647)"


def uniform_sql(start: str, i: str) -> str:
    return f"(({drawn_sql(start, i)} + 0.5) / CAST(2147483647 AS DOUBLE))"


def synonyms_sql(rows: str, n: int, synonyms: dict[str, list[str]], name: str = "syn") -> str:
    """Tables ending in ``name`` (id, text): ``rows`` (id, key, text) with ``n`` words swapped."""
    usable = {w: [o for o in options if o.lower() != w] for w, options in synonyms.items() if len(w) > 3}
    table = ", ".join(f"({quote(w)}, {sql_list(o)})" for w, o in usable.items())
    return f"""
{name}_w AS (SELECT id, key, text, {words_sql('text')} AS w, {root_sql('key', 42, 'synonym')} AS r FROM {rows}),
{name}_t AS (SELECT id, key, r, unnest(w) AS word, unnest(range(len(w))) AS i FROM {name}_w WHERE len(w) > 1),
{name}_o(word, options) AS (VALUES {table}),
{name}_s AS (SELECT t.key, i, options[1 + {drawn_sql('(r + 1)', 'i')} % len(options)] AS other,
             row_number() OVER (PARTITION BY t.key ORDER BY {drawn_sql('r', 'i')}, i) AS k FROM {name}_t AS t JOIN {name}_o AS o ON lower(t.word) = o.word),
{name}_j AS (SELECT t.key, string_agg(coalesce(other, t.word), ' ' ORDER BY t.i) AS text
             FROM {name}_t AS t LEFT JOIN (SELECT * FROM {name}_s WHERE k <= {n}) AS s ON s.key = t.key AND s.i = t.i GROUP BY t.key),
{name} AS (SELECT id, key, coalesce(j.text, w.text) AS text FROM {name}_w AS w LEFT JOIN {name}_j AS j USING (key))"""


def deletion_sql(rows: str, p: float, name: str = "del") -> str:
    """The same for words dropped with probability ``p``."""
    return f"""
{name}_w AS (SELECT id, key, text, {words_sql('text')} AS w, {root_sql('key', 42, 'drop')} AS r FROM {rows}),
{name}_k AS (SELECT *, list_filter(w, lambda x, i: {uniform_sql('r', '(i - 1)')} > {p}) AS k FROM {name}_w),
{name} AS (SELECT id, key, CASE WHEN text IS NULL OR len(w) <= 3 THEN text WHEN len(k) = 0 THEN w[-1] ELSE array_to_string(k, ' ') END AS text FROM {name}_k)"""


def swaps_sql(rows: str, n: int, name: str = "swp") -> str:
    """The same for ``n`` swaps of neighbours."""
    out = f"""
{name}_0 AS (SELECT id, key, text, {words_sql('text')} AS w, {root_sql('key', 42, 'swap')} AS r FROM {rows}),"""
    for step in range(n):
        out += f"""
{name}_p{step} AS (SELECT *, CASE WHEN len(w) >= {2 * (step + 1)} THEN 1 + {drawn_sql('r', str(step))} % greatest(len(w) - 1, 1) END AS spot FROM {name}_{step}),
{name}_{step + 1} AS (SELECT id, key, text, CASE WHEN spot IS NULL THEN w ELSE list_concat(list_concat(w[:spot - 1], [w[spot + 1], w[spot]]), w[spot + 2:]) END AS w, r FROM {name}_p{step}),"""
    return out + f"""
{name} AS (SELECT id, key, CASE WHEN text IS NULL OR len(w) < 2 THEN text ELSE array_to_string(w, ' ') END AS text FROM {name}_{n})"""
