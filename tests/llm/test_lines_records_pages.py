import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import merkle, page_body, site_lines

ITEMS = "item_id bigint, institution string, extracted_text string, key string, tw_source string, pos int"


def items(spark, data):
    return spark.createDataFrame([(*r, "k", "s", 0) for r in data], ITEMS)


# -- problem 1 -------------------------------------------------------------------


def test_site_lines_against_brute_force(spark, rows):
    rnd = random.Random(1)
    stock = ["All rights reserved.", "ALL RIGHTS, reserved", "Straße 5", "STRASSE 5!", "— * —", "", "  ", "Print this page\r"]
    data = [(i, rnd.choice(["A", "A", "A", "B", None]), "\n".join(rnd.choice([*stock, f"unique line {i} {j}"]) for j in range(6))) for i in range(120)]
    data += [(200, "A", None), (201, "A", ""), (202, "B", "x" * 200_000), (203, "A", data[0][2])]
    key = lambda line: "".join(c for c in line.casefold() if c.isalnum())
    total, seen = Counter(s for _, s, _ in data), Counter()
    for _, s, t in data:
        seen.update({(s, key(x)) for x in (t or "").split("\n") if key(x)})
    hit = lambda s, x: key(x) and seen[s, key(x)] >= 5 and seen[s, key(x)] >= 0.05 * total[s]
    expected = sorted(((i, n) for i, s, t in data for n, x in enumerate((t or "").split("\n"), 1) if hit(s, x)), key=repr)
    df = items(spark, data)
    assert rows(site_lines.find(df)) == expected
    cleaned = {r.item_id: (r.extracted_text, r.lines_removed) for r in site_lines.clean(df).collect()}
    for i, s, t in data:
        lines = None if t is None else [x for x in t.split("\n") if not hit(s, x)]
        assert cleaned[i][0] == (None if t is None else "\n".join(lines))
        assert cleaned[i][1] == (0 if t is None else len(t.split("\n")) - len(lines))


def test_site_lines_of_an_empty_table(spark):
    assert site_lines.find(items(spark, [])).collect() == [] and site_lines.clean(items(spark, [])).collect() == []


# -- problem 4 -------------------------------------------------------------------

RECORDS = "candidate_id bigint, url string, canonical_url string, title string, digest string, u string"


def test_records_against_brute_force(spark, rows):
    rnd = random.Random(2)
    urls = ["https://e.org/a", "HTTPS://E.org:443/a/", "https://e.org/b?x=1&utm_source=q", "https://e.org/b?x=1", "no url", None, ""]
    titles = ["Café talk", "Café TALK!", "CAFÉ  talk", "Cafe talk", None, "", "*"]
    data = [(i, rnd.choice(urls), rnd.choice([*urls, " "]), rnd.choice(titles), "d", "u") for i in range(300)]
    data += [(7, "https://e.org/a", None, "Café talk", "", ""), (None, "https://e.org/a", None, "Café talk", "", ""), (999, "https://e.org/" + "x" * 50_000, None, "t" * 50_000, "", "")]

    def leaf(u):
        same = {"HTTPS://E.org:443/a/": "https://e.org/a", "https://e.org/b?x=1&utm_source=q": "https://e.org/b?x=1"}  # the rules written out
        return same.get(u) or u if (u or "").lower().startswith("https") else "=" + (u or "").strip()

    def title(t):
        return "".join(c for c in unicodedata.normalize("NFC", t or "").casefold() if c.isalnum())

    groups = {}
    for i, u, c, t, *_ in data:
        if i is not None:
            groups.setdefault((leaf(u), leaf(c) if c and c.strip() else leaf(u), title(t)), []).append(i)
    df = spark.createDataFrame(data, RECORDS)
    assert rows(merkle.copies(df)) == sorted(((min(g), i) for g in groups.values() for i in g if i > min(g)), key=repr)
    assert rows(merkle.records(df)) == sorted(((min(g), len(g)) for g in groups.values()), key=repr)
    assert merkle.copies(df.where("false")).collect() == []


def test_unordered_nodes(spark):
    leafs = lambda *xs: F.array(*[merkle.leaf(F.lit(x)) for x in xs])
    got = spark.range(1).select(
        merkle.unordered(leafs("a", "b")) == merkle.unordered(leafs("b", "a")),
        merkle.ordered(merkle.leaf(F.lit("a")), merkle.leaf(F.lit("b"))) == merkle.ordered(merkle.leaf(F.lit("b")), merkle.leaf(F.lit("a"))),
        merkle.leaf(F.lit(None).cast("string")) == merkle.leaf(F.lit("")),
        merkle.named_fields(x=merkle.leaf(F.lit(1)), y=merkle.leaf(F.lit(2))) == merkle.named_fields(y=merkle.leaf(F.lit(2)), x=merkle.leaf(F.lit(1))),
    ).first()
    assert tuple(got) == (True, False, False, True)


def test_colliding_digests_fall_back_to_structure(spark, rows):
    keyed = spark.createDataFrame([(1, b"x", "a"), (2, b"x", "b"), (3, b"x", "a"), (4, b"y", "c"), (5, b"y", "c")], "tw_id bigint, digest binary, structure string")
    groups, _ = merkle._confirmed(keyed)
    assert rows(groups.select("first_id", "n")) == [(1, 2), (2, 1), (4, 2)]


# -- problem 3 -------------------------------------------------------------------

PAGES = "capture_id bigint, source_host string, url string, extracted_title string, extracted_text string, host string, shard int"


def pages(spark, data):
    return spark.createDataFrame([(*r, "h", 1) for r in data], PAGES)


def site(n, host="www.site.example"):
    data = []

    def word(i):
        return "q" + "".join(chr(97 + int(c)) for c in str(i))

    for i in range(n):
        day = f"{i % 28 + 1} May 2025"
        text = "\n".join([
            "Menu | Home | About", f"Home / About / The curious case of {word(i)}", f"The curious case of {word(i)}", "Share Print",
            f"First paragraph of {word(i)}. It goes on with {word(i)} words.", "", f"- a list entry about {word(i)} things", "Most read", f"Other story {word(i * 7)} told",
            f"A teaser sentence about {word(i * 3)} that is cu…", day, "Read more", f"Last paragraph with {word(i)} ends.", "Energy, Health", f"© {2000 + i % 3} Site",
        ])
        data.append((i, host, f"https://www.site.example/a/the-curious-case-of-{word(i)}-x{i}", None, text))
    return data


def test_body_lines(spark):
    got = {}
    for r in page_body.find(pages(spark, [*site(60), (900, "site.example", "https://site.example/a/no-such-title-1", None, "Menu | Home | About\nShare Print"), (901, "h", None, None, None), (902, None, "", "", " ")])).collect():
        got.setdefault(r.capture_id, set()).add(r.line_no)
    assert all(got[i] == {3, 5, 7, 13} for i in range(60))
    assert not {900, 901, 902} & set(got)


def test_long_menu_lines(spark):
    menu = " | ".join(["Home", "Research", "Events", "Publications", "Experts", "Newsletter"] * 4)
    data = [(i, h, u, t, f"{x}\n{menu}\n{'-' * 200}") for i, h, u, t, x in site(60)]
    got = {}
    for r in page_body.find(pages(spark, data)).collect():
        got.setdefault(r.capture_id, set()).add(r.line_no)
    assert len(menu) > page_body.LONG_LINE and all(got[i] == {3, 5, 7, 13} for i in range(60))


def test_phrases_rare_on_each_of_large_hosts(spark):
    data = [(1000 * h + i, f"h{h}.example", f"https://h{h}.example/{i}", None, f"text q{i}" + "\nWritten by our guests" * (i < n)) for h, n in ((1, 2), (2, 2), (3, 1)) for i in range(250)]
    table = page_body.boilerplate(page_body._pages(pages(spark, data), "capture_id", "source_host", "url", "extracted_title", "extracted_text"))
    assert table.where("host IS NULL").where(F.col("phrase") == page_body._name("written by our guests".split())).count() == 1


def test_pages_of_an_empty_table(spark):
    assert page_body.find(pages(spark, [])).collect() == []


def test_shards_give_the_same_result(spark, rows, monkeypatch):
    df = pages(spark, site(60))
    whole = rows(page_body.find(df))
    monkeypatch.setattr(page_body, "BROADCAST_ROWS", 0)  # forces the way without broadcast
    monkeypatch.setattr(page_body, "SHARD_PAGES", 30)
    assert rows(page_body.find(df)) == whole


def test_substrings_against_brute_force():
    import numpy as np

    rnd = random.Random(4)
    words = ["a", "b", "c", "d1"]
    texts = ["\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40))) + rnd.choice(["", " | x, y z", ", q"]) for _ in range(4)) for _ in range(30)]
    seen = Counter()
    for text in texts:
        found = set()
        for line in page_body.segments(text):
            groups = []
            for comma, tokens in line:
                groups[-1].append(tokens) if comma and groups else groups.append([tokens])
            for g in groups:
                found.add((False, page_body._name(sum(g, []))))
                found |= {(True, page_body._name(t)) for t in g} if len(g) > 1 else set()
        seen.update(found)
    got = page_body.repeated(texts, np.arange(30), 2)
    assert {(bool(w), p, n) for w, p, n in zip(got.weak, got.phrase, got.pages)} == {(w, p, n) for (w, p), n in seen.items() if n >= 2}


@pytest.mark.parametrize("url", ["https://site.example/?p=123", "https://site.example/articles/48213", "https://site.example/"])
def test_addresses_that_name_no_article(url):
    known = page_body.Known((set(), set(), set()), (set(), set(), set()))
    assert page_body.body_lines("A title of some words\n\nA sentence of the article.", url, "", known) == [1, 3]
