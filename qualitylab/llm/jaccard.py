"""Exact set join of documents by the Jaccard similarity of their word shingles, and its components.

Sets are indexed by the shingles of their prefix, the part that two similar sets must share, in one global order: by
hash, but frequent shingles last, so that a passage of many documents seldom makes a list. Lists are skipped by
blocks: one bit per size block tells a set whether a list holds any set of a size that could match. Inside
a list, size, position and a parity bitmap bound the overlap before a pair is formed.

Answers are derived from those of similar sets. First every set is compared only with two leaders of each
of its lists, the set that shares most of its prefix and one drawn by hash, the same for like lists. Sets that prove connected so share their
answers: from then on only pairs across different components are formed, so a large group of near copies costs
one comparison or a few for each member instead of one for each pair. What is formed is verified exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.window import Window

from qualitylab.llm.shared import LOWER, arrow_texts, fresh, strong_hashes, values, window_hashes, written

SHINGLE, PERCENT = 4, 85
#: A shingle in more prefixes than this goes last; how many such shingles are sent to the tasks at most (the most
#: frequent; the order only decides the speed); how much more than the prefix is kept to replace them.
FREQUENT, MAX_FREQUENT, SPARE = 64, 200_000, 1.5
#: Bits of a set's parity map, and ids that may be broadcast to pick the documents to verify.
BITS, MAX_PICKED = 512, 2_000_000
#: Rounds of new leaders at most (what they leave is formed pair by pair), and shingles ahead that tell whether a pair met before.
TURNS, BEFORE = 2, 8
#: Draws of leaders. Lists of one draw that hold the same sets have the same leader, so a group of copies makes a few pairs for each
#: member, however many lists it shares.
DRAWS = 3


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words are one shingle, no words none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    return np.unique(window_hashes(strong_hashes(words), min(shingle, len(words)))) if words else np.empty(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    """How many first elements of a set of ``n`` every similar set meets: n - ceil(percent n / 100) + 1."""
    return n - -(-percent * n // 100) + 1 if n else 0


def set_key(values: np.ndarray) -> int:
    """64 bits that stand for the whole set (two of N different sets collide with chance N^2 / 2^65)."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity_map(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit i: whether an odd number of elements falls on i. Two maps differ in no more bits than the sets in elements."""
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_map(found: np.ndarray) -> np.ndarray:
    """A parity map for a set of over 2 * BITS elements, with about as many bits, a power of two; smaller sets need none."""
    return parity_map(found, 1 << (len(found).bit_length() - 1)) if len(found) > 2 * BITS else np.empty(0, np.int64)


def is_frequent(values_: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which shingles have their upper 32 bits among ``frequent`` (sorted)."""
    upper = (values_ >> np.uint64(32)).astype(np.int64)
    return frequent[np.minimum(np.searchsorted(frequent, upper), len(frequent) - 1)] == upper


def indexed_sets(text: Column, percent: int, shingle: int, frequent: np.ndarray | None = None) -> Column:
    """``n``, ``key``, ``map``, ``wide`` and ``prefix`` of each text's set. With ``frequent`` the prefix is in the index's order; without,
    it holds the smallest hashes, SPARE times the prefix."""
    kind = pa.struct([("n", pa.int64()), ("key", pa.int64()), ("map", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64())),
                      ("prefix", pa.list_(pa.int64()))])

    @arrow_udf("struct<n:bigint,key:bigint,map:array<bigint>,wide:array<bigint>,prefix:array<bigint>>")
    def indexed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = []
            for t in values(column):
                found = shingle_set(t, shingle)
                p = prefix_length(len(found), percent)
                if frequent is None:
                    first = found[:math.ceil(SPARE * p)].copy()
                else:
                    late = is_frequent(found, frequent)
                    first = np.concatenate([found[~late][:p], found[late][:p]])[:p]
                rows.append({"n": len(found), "key": set_key(found), "map": parity_map(found, BITS), "wide": wide_map(found),
                             "prefix": first.view(np.int64)})
            yield pa.array(rows, kind)

    return indexed(text)


def reordered(prefix: Column, n: Column, frequent: np.ndarray, percent: int) -> Column:
    """The prefix in the index's order out of a longer one by hash; null if that one was not long enough."""

    @arrow_udf("array<bigint>")
    def chosen(prefixes: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = []
        for hashes, n in zip(values(prefixes), values(sizes), strict=True):
            found, p = np.array(hashes, np.int64).view(np.uint64), prefix_length(n, percent)
            late = is_frequent(found, frequent) if p else np.empty(0, bool)
            rest = found[~late][:p]
            if len(rest) < p and len(found) == n:
                rest = np.concatenate([rest, found[late]])[:p]
            rows.append(rest.view(np.int64) if len(rest) == p else None)
        return pa.array(rows, pa.list_(pa.int64()))

    return chosen(prefix, n)


def frequent_shingles(sets: DataFrame, percent: int) -> np.ndarray:
    """Upper halves of the shingles that are in more than FREQUENT prefixes, sorted; at most MAX_FREQUENT."""
    p = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    upper = F.explode(F.transform(F.slice("prefix", F.lit(1), p.cast("int")), lambda h: F.shiftrightunsigned(h, 32)))
    counted = sets.filter("n > 0").select(upper.alias("s")).groupBy("s").count()
    top = counted.filter(F.col("count") > FREQUENT).orderBy(F.desc("count"), "s").limit(MAX_FREQUENT).select("s")
    return np.sort(np.array([r.s for r in top.collect()], np.int64))


def prefixes(docs: DataFrame, sets: DataFrame, percent: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``key``, ``n`` and ``prefix`` of all sets, frequent shingles last. Where the stored part of a set holds too few others, the
    text is read again."""
    frequent = frequent_shingles(sets, percent)
    sets = sets.filter("n > 0")
    if not len(frequent):
        p = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        return sets.select("key", "n", F.slice("prefix", F.lit(1), p.cast("int")).alias("prefix"))
    ordered = written(sets.select("row_", "key", "n", reordered(F.col("prefix"), F.col("n"), frequent, percent).alias("prefix")), "prefixes")
    short = ordered.filter("prefix IS NULL").groupBy("key").agg(F.min("row_").alias("row_"))
    again = texts_of(docs, short.select("row_"), id_col, text_col).select(indexed_sets(F.col("text_"), percent, shingle, frequent).alias("s"))
    again = written(again.select("s.key", "s.n", "s.prefix"), "again")  # else the join's filter on the key reads every text
    again = again.join(short.select("key"), "key", "left_semi")
    return ordered.filter("prefix IS NOT NULL").select("key", "n", "prefix").union(again.select("key", "n", "prefix"))


def row_key(id_col: str, text_col: str) -> Column:
    """What a row is read again by, null ids included. Rows that share it have equal texts, but for chance, and then
    only more is read."""
    return F.xxhash64(id_col, text_col)


def texts_of(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``text_`` of the documents with these row keys."""
    picked = written(keys, "picked")
    if picked.count() <= MAX_PICKED:
        picked = F.broadcast(picked)  # at most MAX_PICKED keys; more take Spark's own join
    return docs.select(row_key(id_col, text_col).alias("row_"), F.col(text_col).alias("text_")).join(picked, "row_", "left_semi").select("text_")


def size_block(n: Column, percent: int) -> Column:
    """Number of a size's block, up to 62. A block spans a factor a little above the one that similar sets' sizes can differ
    by, so sets that can match are in the same or neighbouring blocks."""
    width = -math.log(percent / 100 - 0.01)
    return F.least(F.floor(F.log(n) / width), F.lit(62)).cast("int")


def shared_postings(sets: DataFrame, percent: int) -> DataFrame:
    """(``token``, ``key``, ``n``, ``at``) of the prefix shingles in lists where the set has anything to meet."""
    postings = sets.select("key", "n", F.posexplode("prefix").alias("at", "token")).repartition("token")
    block, one = size_block(F.col("n"), percent), F.lit(1).cast("long")
    lists = postings.groupBy("token").agg(
        F.count("*").alias("held"), F.min("key").alias("low"), F.max("key").alias("high"), F.max("at").alias("last"),
        F.bit_or(F.call_function("shiftleft", one, block)).alias("blocks")).filter("low <> high AND last >= 0")
    near = F.call_function("shiftleft", F.lit(5).cast("long"), block)  # the blocks below and above, one up
    meets = (F.call_function("shiftleft", F.col("blocks"), F.lit(1)).bitwiseAND(near) != 0) | (F.col("held") > F.bit_count("blocks"))
    return (postings.join(lists, "token").filter(meets).groupBy("token", "key").agg(F.first("n").alias("n"), F.first("at").alias("at")))


def sizes_fit(x: str, y: str, percent: int) -> Column:
    """Whether sizes and positions leave room for a similar pair; a true pair always passes."""
    nx, ny, ax, ay = (F.col(f"{side}.{part}") for part in ("n", "at") for side in (x, y))
    apart = F.abs(ax - ay) + F.abs((nx - ax) - (ny - ay))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (apart * (100 + percent) <= (nx + ny) * (100 - percent))


def maps_fit(x: str, y: str, percent: int) -> Column:
    """Whether the parity maps do: elements in one set only are at most (nx + ny) (100 - percent) / (100 + percent)."""
    bits = [F.bit_count(F.col(f"{x}.map")[i].bitwiseXOR(F.col(f"{y}.map")[i])) for i in range(BITS // 64)]
    return sum(bits[1:], bits[0]) * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent)


def wide_maps_fit(x: str, y: str, percent: int) -> Column:
    """The same for the wide maps; one twice as long as the other is first folded onto itself."""
    a, b = F.col(f"{x}.wide"), F.col(f"{y}.wide")
    short = F.least(F.size(a), F.size(b))
    either = lambda p, q: p.bitwiseXOR(q)
    a, b = (F.when(F.size(m) > short, F.zip_with(F.slice(m, F.lit(1), short), F.slice(m, short + 1, short), either)).otherwise(m) for m in (a, b))
    differing = F.aggregate(F.zip_with(a, b, either), F.lit(0), lambda total, word: total + F.bit_count(word))
    return (short == 0) | (differing * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent))


def joined_fit(pairs: DataFrame, maps: DataFrame, part: str, fit) -> DataFrame:
    """The pairs whose ``part`` of the maps fit."""
    x, y = (maps.select(F.col("key").alias(end), F.struct("n", part).alias(end * 2)) for end in ("x", "y"))
    return pairs.join(x, "x").join(y, "y").filter(fit).select("x", "y")


def chance(turn: int = 0) -> Column:
    """By which a set is drawn as a list's leader: of the set and the list's draw, not of the list itself."""
    return F.xxhash64(F.lit(turn), F.pmod("token", F.lit(DRAWS)), "key")


def led_pairs(postings: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Each set with the two leaders of each of its lists, where bounds allow."""
    nodes = postings.groupBy("key").agg((F.count("*") / F.max(100 + (100 - percent) * F.col("n"))).alias("central"))
    own = F.struct("key", "n", "at")
    leaders = postings.join(nodes, "key").groupBy("token").agg(
        F.max(F.struct("central", "key", own.alias("set"))).alias("most"),
        F.max(F.struct(chance().alias("chance"), own.alias("set"))).alias("drawn"))
    met = (postings.select("token", own.alias("s")).join(leaders, "token")
           .select("s", F.explode(F.array("most.set", "drawn.set")).alias("l")))
    return bounded_pairs(met.filter(F.col("s.key") != F.col("l.key")), maps, percent)


def bounded_pairs(met: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The different pairs of sets ``s`` and leaders ``l`` that the bounds allow."""
    pairs = met.filter(sizes_fit("s", "l", percent)).select(F.least("s.key", "l.key").alias("x"), F.greatest("s.key", "l.key").alias("y"))
    return joined_fit(pairs.distinct(), maps, "map", maps_fit("xx", "yy", percent))


def open_postings(postings: DataFrame, known: DataFrame) -> DataFrame:
    """``postings`` with each set's ``label``, the component it is known to be in, of lists that hold two components or more."""
    rows = postings.join(known, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return rows.join(mixed.select("token"), "token", "left_semi")


def newly_led_pairs(rows: DataFrame, maps: DataFrame, tested: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each set of an open list with a leader from the component that holds most of the list, drawn anew each turn; pairs ``tested``
    before are left out."""
    own = F.struct("key", "n", "at")
    drawn = F.struct(chance(turn + 1).alias("chance"), own.alias("set"))
    parts = rows.groupBy("token", "label").agg(F.count("*").alias("held"), F.max(drawn).alias("drawn"))
    leaders = parts.groupBy("token").agg(F.max(F.struct("held", "drawn", "label")).alias("l"))
    met = rows.select("token", "label", own.alias("s")).join(leaders, "token").filter(F.col("label") != F.col("l.label"))
    return bounded_pairs(met.select("s", F.col("l.drawn.set").alias("l")), maps, percent).join(tested, ["x", "y"], "left_anti")


def crossing_pairs(rows: DataFrame, maps: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs of one open list whose sets are not known to be connected, where bounds allow. A pair is formed where it first meets: not
    where the sets share one of the BEFORE shingles that each has ahead of the list's own, for there it was formed."""
    ahead = Window.partitionBy("key").orderBy("at").rowsBetween(-BEFORE, -1)
    rows = rows.withColumn("before", F.collect_list("token").over(ahead)).join(maps.select("key", "map"), "key")
    x, y = (rows.select("token", F.struct("key", "n", "at", "map", "label", "before").alias(end)) for end in ("x", "y"))
    unlike = (F.col("x.key") < F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
    first = ~F.arrays_overlap("x.before", "y.before")
    met = x.join(y, (x["token"] == y["token"]) & unlike & sizes_fit("x", "y", percent) & first & maps_fit("x", "y", percent))
    return met.select(F.col("x.key").alias("x"), F.col("y.key").alias("y")).distinct().join(tested, ["x", "y"], "left_anti")


def linked(docs: DataFrame, sets: DataFrame, maps: DataFrame, pairs: DataFrame, held: DataFrame | None, percent: int, shingle: int,
           id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The pairs of keys whose sets are similar, found by intersecting the sets themselves; and ``held``, the sets read for it, with those
    of earlier rounds, which are not read again."""
    close = written(joined_fit(pairs, maps, "wide", wide_maps_fit("xx", "yy", percent)), "close")
    ends = close.select(F.explode(F.array("x", "y")).alias("key")).distinct()
    if held is not None:
        ends = ends.join(held.select("key"), "key", "left_anti")
    picked = sets.select("key", "row_").join(ends, "key", "left_semi").groupBy("key").agg(F.min("row_").alias("row_"))

    @arrow_udf("struct<key:bigint,set:binary>")
    def whole(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = (shingle_set(t, shingle) for t in values(column))
            yield pa.array([{"key": set_key(v), "set": v.tobytes()} for v in found], pa.struct([("key", pa.int64()), ("set", pa.binary())]))

    @arrow_udf("boolean")
    def similar(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(values(xs), values(ys), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    new = texts_of(docs, picked.select("row_"), id_col, text_col).select(whole("text_").alias("w"))
    new = written(new.groupBy("w.key").agg(F.first("w.set").alias("set")), "held")  # else the joins' filters on the key read every text
    held = new if held is None else held.union(new)
    found = (close.join(held.select(F.col("key").alias("x"), F.col("set").alias("of_x")), "x")
             .join(held.select(F.col("key").alias("y"), F.col("set").alias("of_y")), "y"))
    return found.filter(similar("of_x", "of_y")).select("x", "y"), held


def rooted(labels: DataFrame) -> DataFrame:
    """``labels``, each replaced by the label of its label until nothing changes; paths shrink by half each time."""
    while True:
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("next"))
        new = written(labels.join(jump, "label").select("key", F.col("label").alias("old"), F.col("next").alias("label")), "labels")
        if new.filter("label <> old").isEmpty():
            return labels
        labels = new.select("key", "label")


def relinked(links: DataFrame, groups: DataFrame) -> DataFrame:
    """The different links between the labels that ``groups`` gives the ends of ``links``; an end without one stands for itself."""
    for end in ("x", "y"):
        links = links.join(groups.select(F.col("key").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
    x, y = F.coalesce("of_x", "x"), F.coalesce("of_y", "y")
    return links.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).filter("x <> y").distinct()


def relabelled(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """``groups`` with each label replaced by its own among ``labels``, where it has one."""
    jump = labels.select(F.col("key").alias("label"), F.col("label").alias("next"))
    return groups.join(jump, "label", "left").select("key", F.coalesce("next", "label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """``key`` and ``label``, the smallest key that it reaches by ``links`` (x, y).

    Each round, a key takes the smallest key around it and then what that leads to; the links between those
    are the next round's. A key that leads to itself has others under it, so each round leaves half of the keys or
    fewer, and it ends when no link is left. Every round is a written table.
    """
    groups = None
    while True:
        both = links.union(links.select("y", "x")).toDF("key", "other")
        labels = rooted(written(both.groupBy("key").agg(F.least("key", F.min("other")).alias("label")), "labels"))
        groups = labels if groups is None else written(relabelled(groups, labels), "labels")
        links = written(relinked(links, labels), "links")
        if links.isEmpty():
            return groups


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``groups`` and more ``links`` together; only links between different components are followed."""
    labels = components(written(relinked(links, groups), "links"))
    new = labels.join(groups.select("key"), "key", "left_anti")
    return written(relabelled(groups, labels).union(new), "labels")


def grouped(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``id_``, ``row_`` (the row key), ``n`` and ``label`` (a key of its component; null for an empty set) of every row."""
    how = (percent, shingle, id_col, text_col)
    sets = written(arrow_texts(docs).select(F.col(id_col).alias("id_"), row_key(id_col, text_col).alias("row_"),
                                            indexed_sets(F.col(text_col), percent, shingle).alias("s"))
                   .select("id_", "row_", "s.*"), "sets")
    postings = written(shared_postings(prefixes(docs, sets, *how), percent), "postings")
    maps = written(sets.select("key", "n", "map", "wide").join(postings.select("key").distinct(), "key", "left_semi")
                   .groupBy("key").agg(F.first("n").alias("n"), F.first("map").alias("map"), F.first("wide").alias("wide")), "maps")
    tested = pairs = written(led_pairs(postings, maps, percent), "led")
    found, held = linked(docs, sets, maps, pairs, None, *how)
    groups = components(written(found, "links"))
    for turn in range(TURNS):
        rows = written(open_postings(postings, groups), "open")
        pairs = written(newly_led_pairs(rows, maps, tested, percent, turn), "led")
        found, held = linked(docs, sets, maps, pairs, held, *how)
        more = written(found, "links")
        tested = tested.union(pairs)
        if more.isEmpty():
            break
        groups = merged(groups, more)
    pairs = written(crossing_pairs(written(open_postings(postings, groups), "open"), maps, tested, percent), "crossing")
    groups = merged(groups, linked(docs, sets, maps, pairs, held, *how)[0])
    labels = groups.select("key", F.col("label").alias("led"))
    rows = sets.select("id_", "row_", "n", "key").join(labels, "key", "left")
    return written(rows.select("id_", "row_", "n", F.when(F.col("n") > 0, F.coalesce("led", "key")).alias("label")), "groups")


def similar_sets(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id that its set reaches by links.

    Sets link when 100 * intersection >= ``percent`` * union. Null, empty and blank texts have an empty set, link with nothing
    and are their own component. Equal sets link, also those of repeated rows; rows that share an id but not their set link only as
    their sets do. A null id is never a component's id: such rows show the smallest id of theirs, or null. Only id
    and text are read.
    """
    rows = grouped(docs, percent, shingle, id_col, text_col)
    ids = rows.filter("n > 0").groupBy("label").agg(F.min("id_").alias("component_id"))
    full = rows.filter("n > 0").join(ids, "label").select("id_", "n", "component_id")
    empty = rows.filter("n = 0").select("id_", "n", F.col("id_").alias("component_id"))
    return full.union(empty).select(F.col("id_").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, same columns, with one document of each component: the one with the smallest id (null ids last), and one of the
    rows that repeat it. Rows with an empty set stay."""
    rows = grouped(docs, percent, shingle, id_col, text_col).filter("n > 0")
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("id_").isNull().alias("unnamed"), "id_", "row_")).alias("best"))
    times = rows.groupBy("label", "id_", "row_").agg(F.count("*").alias("times")).join(best, "label")
    is_best = F.col("id_").eqNullSafe(F.col("best.id_")) & (F.col("row_") == F.col("best.row_"))
    gone = written(times.filter(~is_best | (F.col("times") > 1)).select("id_", "row_", is_best.alias("repeated")), "gone")
    row = fresh("row_", *docs.columns)
    keyed = docs.withColumn(row, row_key(id_col, text_col))
    same = (keyed[row] == gone["row_"]) & keyed[id_col].eqNullSafe(gone["id_"])
    alone = keyed.join(gone, same, "left_anti").select(*docs.columns)
    repeats = keyed.join(gone.filter("repeated"), same, "left_semi").groupBy(id_col, row)
    one = repeats.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("one")).select("one.*")
    return alone.union(one)
