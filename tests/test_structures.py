"""Places along chains, merges in order, containment, rules over ranges: each against a plain version."""

import random

import pytest

from accolade.operators import matching as M
from accolade.operators import rounds as R


def test_places_along_chains(spark):
    r = random.Random(5)
    names = [f"n{i}" for i in range(300)]
    links = [(k, n, r.choice([None, "gone", *names])) for k in ("a", None, "b") for n in names]
    links += [("ring", f"x{i}", f"x{(i + 1) % 7}") for i in range(7)] + [("self", "y", "y"), ("a", None, "n1")]
    starts = [("a", "n0"), ("a", "n1"), (None, "n5"), ("b", "n9"), ("ring", "x3"), ("self", "y"), ("b", "gone"), ("ring", "x3")]
    to = {(k, n): t for k, n, t in links if n}
    want = {}
    for k, n in starts:
        place, seen = 0, set()
        while (k, n) in to and n not in seen:
            want[k, n] = min(place, want.get((k, n), place))
            seen.add(n)
            n, place = to[k, n], place + 1
    got = R.list_ranks(spark.createDataFrame(links, "k string, n string, t string"), spark.createDataFrame(starts, "k string, n string"), "n", "t", ["k"]).collect()
    assert len(got) == len(want) and {(x["k"], x["n"]): x["place"] for x in got} == want
    none = R.list_ranks(spark.createDataFrame([], "n int, t int"), spark.createDataFrame([(1,)], "n int"), "n", "t")
    assert none.columns == ["n", "place"] and none.count() == 0


def test_a_long_chain_and_a_ring(spark):
    n = 100_000
    links = spark.range(n).selectExpr("id * 7919 % 100000 AS page", "CASE WHEN id < 99999 THEN (id + 1) * 7919 % 100000 END AS next")
    ring = spark.range(1000).selectExpr("id + 200000 AS page", "(id + 1) % 1000 + 200000 AS next")
    got = R.list_ranks(links.union(ring), spark.createDataFrame([(0,), (200500,)], "page long"), "page", "next")
    wrong = got.selectExpr("CASE WHEN page < 200000 THEN place * 7919 % 100000 = page ELSE (place + 500) % 1000 + 200000 = page END AS ok").where("not ok").count()
    assert (got.count(), wrong) == (n + 1000, 0)


def greedy(records):
    taken, out = {}, set()
    for g, o, keys in sorted(records, key=lambda x: (x[1] is not None, x[1])):
        have, keys = taken.setdefault(g, set()), {k for k in keys or [] if k is not None}
        if not have & keys:
            have |= keys
            out.add((g, o))
    return out


@pytest.mark.parametrize("local", [20_000, 12, 0])
def test_merge_in_order(spark, local):
    r = random.Random(local)
    records = [(r.choice(["g", "h", None]), i, r.choice([None, [], [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(6)) for _ in range(r.randint(1, 4))]])) for i in range(250)]
    # A chain in which every record meets the one before: each other one is taken.
    records += [("chain", i, [f"c{i}", f"c{i + 1}", None]) for i in range(30)]
    df = spark.createDataFrame(records, "g string, o int, keys array<string>").repartition(3)
    got = R.first_fit(df.withColumn("_x", df["o"]), ["g"], ["o"], "keys", local)
    assert got.columns == ["g", "o", "keys", "_x"]
    assert {(x["g"], x["o"]) for x in got.collect()} == greedy(records) and got.count() == len(greedy(records))
    assert R.first_fit(df.limit(0), ["g"], ["o"], "keys").count() == 0


def test_merge_of_a_hot_group(spark):
    """One title of 10^5 records: most share one key, the others stand alone or in pairs."""
    df = spark.range(100_000).selectExpr("1 AS g", "id AS o", "CASE WHEN id % 3 > 0 THEN array('all', concat('u', id)) ELSE array(concat('p', id div 6)) END AS keys")
    got = R.first_fit(df, ["g"], ["o"], "keys", 10_000).select("o").collect()
    assert {x["o"] for x in got} == {1} | {i for i in range(0, 100_000, 6)}


def test_merge_of_many_small_groups(spark, monkeypatch):
    """Groups cost no call each: a task walks its groups in one pass."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    def called(*_):
        raise AssertionError("a call for each group")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", called)
    df = spark.range(90_000).selectExpr("nullif(id % 30000, 7) AS g", "id AS o", "array(concat('k', id div 60000), null) AS keys").repartition(3)
    got = R.first_fit(df, ["g"], ["o"], "keys").select("o").collect()
    assert sorted(x["o"] for x in got) == sorted([*range(30_000), *range(60_000, 90_000)])


@pytest.mark.parametrize("share", [10_000, 3])
def test_containment(spark, share):
    r = random.Random(share)
    pick = lambda n: r.choice([None, [r.choice([None, *"abcdefghij"]) for _ in range(r.randint(0, n))], ["a"]])
    queries, records = [(i, pick(8)) for i in range(80)] + [(3, ["a", "b"])], [(i, pick(4)) for i in range(150)] + [(7, ["b"]), (None, ["c"])]
    members = lambda x: {m for m in x or [] if m is not None}
    want = {(q, n) for q, a in queries for n, h in records if members(h) and members(h) <= members(a)}
    got = M.containment_join(spark.createDataFrame(queries, "q int, m array<string>"), spark.createDataFrame(records, "n int, m array<string>"), "q", "n", "m", "m", share).collect()
    assert {tuple(x) for x in got} == want
    assert M.containment_join(spark.createDataFrame([], "q int, m array<string>"), spark.createDataFrame(records, "n int, m array<string>"), "q", "n", "m", "m").count() == 0


def test_containment_sends_each_query_once(spark):
    """A query's array goes to the sets that are left, not to each of its members."""
    queries = spark.range(40).selectExpr("id AS q", "sequence(id, id + 300) AS m")
    records = spark.range(400).selectExpr("id AS n", "array(id, id + id % 3) AS m")
    found = M.containment_join(queries, records, "q", "n", "m", "m")
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    sent = [above for above, line in zip(plan, plan[1:]) if "Generate explode(_asked" in line]
    assert sent and not any("_asked" in x for x in sent)
    assert {tuple(x) for x in found.collect()} == {(q, n) for q in range(40) for n in range(400) if q <= n and n + n % 3 <= q + 300}


def _rules(spark, rows):
    return spark.createDataFrame(rows, "award string, category string, a int, b int, name string")


def _holds(rule, award, category, y):
    w, c, a, b, _ = rule
    return w == award and c in (None, category) and (a is None or y is not None and y >= a) and (b is None or y is not None and y <= b)


def test_rules_over_ranges(spark):
    r = random.Random(3)
    rows = []
    for award in ("p", "q"):
        for category in ("x", "y"):
            at = r.randint(-50, 0)
            while at < 300:
                end = at + r.choice([0, 0, 1, 5, 40])
                rows.append((award, category, None if not rows else at, end, f"{award}{category}{at}"))
                at = end + r.choice([1, 1, 3, 20])
    rows += [("r", None, None, 10, "r0"), ("r", None, 11, 11, "r1"), ("r", None, 12, None, "r2"), ("s", "x", None, None, "s0"), ("t", None, None, -5, "t0"), ("t", "x", -4, None, "t1")]
    table = M.rules_table(_rules(spark, rows), ["award", "category"], "a", "b", ["category"])
    points = [(r.choice("pqrstu"), r.choice(["x", "y", "z", None]), r.choice([None, *range(-80, 380)])) for _ in range(600)] + [(None, "x", 3)]
    got = M.with_rule(spark.createDataFrame(points, "award string, category string, y int"), table, "y").collect()
    assert len(got) == len(points)
    for x in got:
        want = [rule[4] for rule in rows if _holds(rule, x["award"], x["category"], x["y"])]
        assert ([x["rule"]["name"]] if x["rule"] else []) == want, x
    empty = M.with_rule(spark.createDataFrame(points, "award string, category string, y int"), M.rules_table(_rules(spark, []), ["award", "category"], "a", "b", ["category"]), "y")
    assert empty.where("rule is not null").count() == 0 and empty.count() == len(points)


def test_many_exclusive_rules_are_walked(spark, monkeypatch):
    """Numbers are not multiplied by levels: one row for each, and the rules of a key may be long, short, open or none."""
    monkeypatch.setattr(M, "WALKED_RULES", 3)
    r, rows = random.Random(8), []
    for award in ("p", None, "q"):
        at = r.randint(-50, 0)
        while at < 400:
            end = at + r.choice([0, 0, 1, 5, 40, 150])
            rows.append((award, "x", at, end, f"{award}{at}"))
            at = end + r.choice([1, 1, 3, 20])
    rows += [("r", "x", None, 10, "r0"), ("r", "x", 12, None, "r2"), ("s", "x", None, None, "s0"), ("t", "x", -4, None, "t1")]
    table = M.rules_table(_rules(spark, rows), ["award"], "a", "b")
    points = [(r.choice(["p", "q", "r", "s", "t", "u", None]), r.choice([None, *range(-80, 480)])) for _ in range(900)]
    asked = spark.createDataFrame(points, "award string, y int")
    got = M.with_rule(asked, table, "y").collect()
    assert len(got) == len(points)
    for x in got:
        want = [rule[4] for rule in rows if rule[0] == x["award"] and (rule[2] is None or x["y"] is not None and x["y"] >= rule[2]) and (rule[3] is None or x["y"] is not None and x["y"] <= rule[3])]
        assert ([x["rule"]["name"]] if x["rule"] else []) == want, x
    assert table.blocks.count() <= 3 * len(rows)
    with pytest.raises(ValueError, match="overlap"):
        M.rules_table(_rules(spark, [*rows, ("p", "x", 390, 391, "late"), ("p", "x", 391, 395, "later")]), ["award"], "a", "b")


@pytest.mark.parametrize(("one", "other", "clash"), [
    (("p", "x", 1, 5), ("p", "x", 5, 9), True), (("p", "x", 1, 5), ("p", "x", 6, 9), False), (("p", "x", 1, 500), ("p", "x", 77, 78), True), (("p", "x", None, 5), ("p", "x", None, 2), True),
    (("p", None, 1, 5), ("p", "x", 3, 9), True), (("p", "x", 1, 5), ("p", None, 3, 3), True), (("p", "x", 1, 5), ("p", "y", 3, 3), False), (("p", None, 1, 5), ("q", "x", 3, 3), False), (("p", None, None, None), ("p", "x", 3, 3), True),
])
def test_rules_that_overlap(spark, one, other, clash):
    rows = [(*one, "one"), (*other, "other"), ("z", "x", 0, 1, "far"), ("z", "x", 900, 1000, "off")]
    build = lambda: M.rules_table(_rules(spark, rows), ["award", "category"], "a", "b", ["category"])
    if clash:
        with pytest.raises(ValueError, match="overlap"):
            build()
    else:
        build()
    with pytest.raises(ValueError, match="before it begins"):
        M.rules_table(_rules(spark, [("p", "x", 5, 1, "n")]), ["award", "category"], "a", "b")
