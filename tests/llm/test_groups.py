"""Set joins and rules on rows that tempt them: null ids, repeated rows, words that hash alike by their structure."""

import random

from qualitylab.llm import jaccard, rules

SCHEMA = "doc_id long, text string, row_ string"


def words(seed, n):
    chance = random.Random(seed)
    return [f"w{chance.randrange(10**6)}" for _ in range(n)]


def twins(n=1024):
    """The Thue-Morse word and its complement: polynomial hashes modulo 2^64 cannot tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_near_copies_under_null_ids_link_others(spark):
    base = words(1, 200)
    near = [*base[:100], "other", *base[101:]]
    rows = [(5, " ".join(base), "a"), (None, " ".join(near), "b"), (9, " ".join([*near[:30], "more", *near[31:]]), "c"), (None, " ".join(words(2, 50)), "d")]
    found = jaccard.similar_sets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == [("5", "5"), ("9", "5"), ("None", "5"), ("None", "None")]


def test_one_of_each_leaves_one_row_of_repeated_rows(spark):
    base, other = " ".join(words(1, 80)), " ".join(words(2, 80))
    rows = [(3, base, "a"), (3, base, "a"), (3, base, "b"), (7, base, "c"), (None, base, "d"), (None, other, "e"), (None, other, "e"),
            (1, "", "f"), (1, "", "f"), (2, None, "g"), (None, " \n", "h"), (8, "One two", "i")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r.doc_id), r.text or "", r.row_) for r in kept.collect())
    assert [f[:2] for f in found] == sorted([("3", base), ("None", other), ("1", ""), ("1", ""), ("2", ""), ("None", " \n"), ("8", "One two")])
    assert all(r in {(str(a), b or "", c) for a, b, c in rows} for r in found)
    assert kept.exceptAll(docs).isEmpty()


def test_words_that_hash_alike_by_structure(spark):
    one, two = twins()
    text = " ".join(["a b c d", one, "e f g h a b c d", two, "e f g h"])
    assert rules.measure(text)[rules.MEASURES.index("n_repeat_words")] == 0
    assert rules.repeated_windows(("x y z u v x y z u v").encode().split()).tolist() == [0, 5]
    left, right = (" ".join([*words(4, 3), word, *words(5, 3)]) for word in (one, two))
    assert len(set(jaccard.shingle_set(left)) & set(jaccard.shingle_set(right))) == 0


def test_hashes_do_not_depend_on_what_stands_around():
    from qualitylab.llm.shared import RUN, strong_hashes

    some = [b"x" * n for n in (1, 7, 5000)] + [b"\xff\x00", b"abc"]
    alone = [int(strong_hashes([w])[0]) for w in some]
    long = b"y" * (RUN // 8 + 3)
    assert strong_hashes([long, *some, long])[1:-1].tolist() == alone and len(set(alone)) == len(some)


def test_leader_rounds_find_chains_and_leave_nothing(spark, monkeypatch):
    """A long chain of texts, each similar to the next only, inside lists that all of them share."""
    base, rows = words(6, 120), []
    chain = list(base)
    for i in range(60):
        chain[(7 * i) % 100] = f"step{i}"
        rows.append((i, " ".join(chain), ""))
    rows += [(100 + i, " ".join([*base[100:], *words(50 + i, 90)]), "") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sets = [set(jaccard.shingle_set(t).tolist()) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    want = {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}
    for turns in (0, 2):
        monkeypatch.setattr(jaccard, "TURNS", turns)
        assert {r.doc_id: r.component_id for r in jaccard.similar_sets(docs).collect()} == want


def test_components_follow_each_link_once(spark, monkeypatch):
    """A path, a star, a group in which all are linked and a pair: the links are read in the first round, later rounds have what is left."""
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(200 + i, 200 + j) for i in range(20) for j in range(i + 1, 20)] + [(300, 7000)]
    rounds, real = [], jaccard.written

    def counted(df, label):
        out = real(df, label)
        rounds.extend([out.count()] if label == "links" else [])
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    frame = spark.createDataFrame(links, "x long, y long")
    first = jaccard.components(frame)
    want = {k: 0 for k in range(41)} | {100 + i: 100 for i in range(31)} | {200 + i: 200 for i in range(20)} | {300: 300, 7000: 300}
    assert {r.key: r.label for r in first.collect()} == want
    assert rounds == [0]
    more = spark.createDataFrame([(40, 7000), (205, 119), (219, 101), (9000, 8000), (9000, 8000), (3, 1)], "x long, y long")
    want |= {300: 0, 7000: 0, 9000: 8000, 8000: 8000} | {200 + i: 100 for i in range(20)}
    assert {r.key: r.label for r in jaccard.merged(first, more).collect()} == want
    assert jaccard.components(frame.limit(0)).count() == 0
    zigzag = spark.createDataFrame([(50, 1), (1, 40), (40, 2), (2, 30), (30, 3)], "x long, y long")
    assert {r.label for r in jaccard.components(zigzag).collect()} == {1}


def test_a_group_that_shares_its_lists_has_few_leaders(spark):
    """All 50 sets are in the same 40 lists: each meets the leaders of the draws, not one of each list."""
    postings = spark.createDataFrame([(t, k, 200, t) for t in range(40) for k in range(50)], "token long, key long, n long, at int")
    maps = spark.createDataFrame([(k, 200, [0] * (jaccard.BITS // 64)) for k in range(50)], "key long, n long, map array<long>")
    assert 0 < jaccard.led_pairs(postings, maps, 80).count() <= 50 * (jaccard.DRAWS + 1)
