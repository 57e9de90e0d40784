"""Path templates against plain level-by-level rules, and paths of any depth."""

import random

from pyspark.sql import functions as F

from qualitylab.llm import urls


def plain(shapes, least):
    """(host, shape) -> template and start branch, one level after the other."""
    template = {key: list(key[1]) for key in shapes}
    for level in range(max((len(s) for _, s in shapes), default=0)):
        count = {}
        for (host, shape), n in shapes.items():
            t = template[host, shape]
            if len(t) > level:
                node = host, tuple(t[:level]), t[level]
                count[node] = count.get(node, 0) + n
        for host, shape in shapes:
            t = template[host, shape]
            if len(t) > level and t[level] != urls.WILD and count[host, tuple(t[:level]), t[level]] < least:
                t[level] = urls.WILD
    return {key: tuple(t) for key, t in template.items()}


def plain_branches(rows, z):
    """Template -> branch, by moving nodes up one segment after the other."""
    branch = {(r.host, tuple(r.template)): tuple(r.template) for r in rows}
    for level in range(max(map(len, branch.values()), default=0), 0, -1):
        sums = {}
        for r in rows:
            b = branch[r.host, tuple(r.template)]
            if len(b) == level:
                n, g = sums.get((r.host, b), (0, 0))
                sums[r.host, b] = n + r.labelled, g + r.good
        for (host, b), (n, g) in sums.items():
            near = [x for (h, c), x in sums.items() if h == host and c[:-1] == b[:-1]]
            if n:
                share = sum(x[1] for x in near) / sum(x[0] for x in near)
                if abs(g / n - share) > z * (share * (1 - share) / n) ** 0.5:
                    continue
            branch |= {key: b[:-1] for key, own in branch.items() if key[0] == host and own == b}
    return branch


def test_templates_by_plain_levels(spark):
    chance = random.Random(4)
    shapes = {}
    for _ in range(400):
        host = chance.choice(["a", "b", "c"])
        path = tuple(chance.choice(["x", "y", "*", f"r{chance.randrange(30)}"]) for _ in range(chance.randrange(0, 7)))
        shapes[host, path] = chance.choice([1, 1, 2, 7])
    shapes["d", tuple("pqrstuvw")] = 20
    marks = {key: (k := chance.randrange(n + 1), k if key[1][:1] == ("x",) else chance.randrange(k + 1)) for key, n in shapes.items()}
    table = spark.createDataFrame([(h, list(s), n, *marks[h, s]) for (h, s), n in shapes.items()],
                                  "host string, shape array<string>, n long, labelled long, good long")
    for least in (1, 5, 40):
        rows = urls.generalised(table, least).cache()
        found = rows.collect()
        assert len(found) == len(shapes)
        assert {(r.host, tuple(r["shape"])): tuple(r.template) for r in found} == plain(shapes, least)
        want = plain_branches(found, 1.0)
        got = {(r.host, tuple(r.template)): tuple(r.branch) for r in urls.merged_branches(rows, 1.0).collect()}
        assert got == want and len(set(got.values())) > 5 - 3 * (least == 40)
    assert urls.generalised(table.limit(0)).count() == 0


def test_very_deep_paths_take_few_rounds(spark, monkeypatch):
    rounds, kept = [], urls.written
    monkeypatch.setattr(urls, "written", lambda df, label: rounds.append(label) or kept(df, label))
    deep = "/".join("ab"[i % 2] * 3 for i in range(1000))
    pages = [f"http://trap.net/{deep}/{i}/{'z/' * (i % 3)}" for i in range(20)] + [f"http://trap.net/{deep}"] * 9 + [f"http://one.net/{deep}?{i}" for i in range(9)]
    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(30)], "page_id long, good boolean")
    assert urls.judged_urls(table, labels).filter(F.col("verdict").isNotNull()).count() == len(pages)
    assert rounds.count("generalised") <= 8
