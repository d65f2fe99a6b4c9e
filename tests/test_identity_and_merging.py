import random

from pyspark.sql import functions as F

from tidewatch.operators import identity, ledger, merging, ranking


def test_components_against_union_find(spark, rows):
    rnd = random.Random(3)
    links = [(rnd.randrange(60), f"v{rnd.randrange(45)}") for _ in range(80)] + [(i, "hot") for i in range(100, 140)] + [(None, "v1"), (5, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for n, v in links:
        if n is not None and v is not None:
            parent[find(("n", n))] = find(("v", v))
    groups = {}
    nodes = {n for n, v in links if n is not None and v is not None}
    for n in nodes:
        groups.setdefault(find(("n", n)), []).append(n)
    expected = sorted(((n, min(g)) for g in groups.values() for n in g), key=repr)
    got = identity.components(spark.createDataFrame(links, "n bigint, v string"), "n", "v")
    assert rows(got) == expected


def test_lookup_prefers_the_key_and_the_first_entry(spark):
    items = spark.createDataFrame([(1, "k1", ["a"]), (2, "zz", ["b", ""]), (3, None, ["q"])], "tw_row bigint, key string, own array<string>")
    entries = spark.createDataFrame([("k1", ["b"], 2), ("k0", ["b"], 1), ("k2", None, 3)], "entry string, urls array<string>, o int")
    got = {r.tw_row: (r.matched_key, r.matched_by) for r in identity.lookup(items, entries, "key", "entry", "own", "urls", "o").collect()}
    assert got == {1: ("k1", "key"), 2: ("k0", "alias"), 3: (None, None)}


def test_fold_against_a_loop(spark):
    rnd = random.Random(5)
    data = [(i, f"s{i % 2}", rnd.choice(["u1", "u2", "u3", None]), rnd.choice(["long title one", "long title two", None])) for i in range(60)]
    expected = {}
    for s in ("s0", "s1"):
        by_url, by_title = {}, {}
        for i, scope, u, t in data:
            if scope != s:
                continue
            if u is not None and u in by_url:
                expected[i] = by_url[u]
            elif t is not None and t in by_title:
                expected[i] = by_title[t]
            else:
                expected[i] = i
                if u is not None:
                    by_url[u] = i
                if t is not None:
                    by_title.setdefault(t, i)
    df = spark.createDataFrame(data, "i bigint, s string, u string, t string")
    got = {r.i: r.kept_order for r in merging.fold_titles(df, "s", "u", "t", "i", F.lit(True)).collect()}
    assert got == expected


def test_keep_merge_and_recent(spark, rows):
    df = spark.createDataFrame([("k", 1, "", ["b"]), ("k", 2, "x", None), ("k", 3, "yy", ["a", "b"]), ("l", 4, None, [])], "key string, o int, v string, m array<string>")
    assert rows(merging.keep_first(df.select("key", "o", "v"), "key", "o")) == [("k", 1, ""), ("l", 4, None)]
    assert rows(merging.keep_last(df.select("key", "o", "v"), "key", "o")) == [("k", 3, "yy"), ("l", 4, None)]
    assert rows(merging.merge(df, "key", "o", ["v"], [], ["m"])) == [("k", 1, 3, "x", ["a", "b"]), ("l", 4, 1, None, [])]
    many = spark.createDataFrame([("k", i, f"v{i % 15}") for i in range(40)], "key string, o int, v string")
    assert merging.recent_distinct(many, "key", "v", "o", 12).first()["values"] == [f"v{i}" for i in range(3, 15)]
    assert merging.keep_first(df.where("false").select("key", "o"), "key", "o").collect() == []


def test_ledger_counts_runs_once_and_upserts(spark, rows):
    import datetime

    d = datetime.date
    seen = spark.createDataFrame([("a", d(2026, 1, 2)), ("a", d(2026, 1, 2)), ("a", d(2026, 1, 5)), ("b", d(2026, 1, 3))], "key string, run date")
    first = ledger.sightings(seen, "key", "run")
    assert rows(first) == [("a", d(2026, 1, 2), d(2026, 1, 5), 2), ("b", d(2026, 1, 3), d(2026, 1, 3), 1)]
    assert rows(ledger.upsert(first, first)) == [("a", d(2026, 1, 2), d(2026, 1, 5), 4), ("b", d(2026, 1, 3), d(2026, 1, 3), 2)]
    assert rows(ledger.upsert(first, first.where("false"))) == rows(first)


def test_ranking(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "g string, i int")
    assert rows(ranking.cap_per_group(df, "g", [F.asc("i")], 2)) == [("a", 1, 1), ("a", 2, 2), ("b", 4, 1)]
    assert [r.i for r in ranking.round_robin(df, "g", [F.asc("i")], 3).collect()] == [1, 4, 2]
    assert [r.batch_id for r in ranking.batches(df, "g", [F.asc("i")], 2).orderBy("i").collect()] == [0, 0, 1, 0]
