import hashlib
import random
import re

import numpy as np
import pytest

from tidewatch.llm import incremental as inc

HISTORY = "item_id bigint, seen_item_key string, content_hash string, extracted_text string, cls int, batch string"
ARRIVALS = HISTORY.replace("batch string", "batch_no int")


def digest(t):
    return hashlib.sha256(re.sub(r"\s+", " ", t.strip().lower()).encode()).hexdigest()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(history, arrivals):
    accepted, pairs = [], []

    def parts(r):
        i, key, h, t, *_ = r
        text = t if t and t.strip() else None
        return i, key or None, (h or "").strip().lower() or (digest(text) if text else None), inc.word_hashes(text).tolist() if text else None

    for r in history:
        accepted.append(parts(r))
    for r in sorted(arrivals, key=lambda r: (r[5], r[0])):
        i, key, h, words = parts(r)
        hits = []
        for j, k, g, other in accepted:
            same = h and g and h == g
            alike = words and other and lcs(words, other) >= 0.75 * max(len(words), len(other))
            if same or alike or words is None and key and key == k:
                hits.append(j)
        if hits:
            pairs.append((min(hits), i))
        else:
            accepted.append((i, key, h, words))
    return sorted(pairs, key=repr)


def edit(rnd, words, share):
    out = []
    for w in words:
        r = rnd.random()
        if r < share / 3:
            continue
        out.append(f"new{rnd.randrange(9999)}" if r < 2 * share / 3 else w)
        if r > 1 - share / 3:
            out.append(f"ins{rnd.randrange(9999)}")
    return out


@pytest.mark.parametrize("parts", [16, 2])
def test_batches_against_brute_force(spark, rows, monkeypatch, parts):
    rnd = random.Random(7)
    monkeypatch.setattr(inc, "MAX_PARTS", parts)
    monkeypatch.setattr(inc, "SETTLED_AT_ONCE", 0 if parts == 2 else 4 << 20)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 9, 30, 80]))] for _ in range(40)]
    history = [(i, f"k{i}", rnd.choice([None, "", digest(" ".join(t))]), " ".join(t) if i % 9 else None, 0, "") for i, t in enumerate(texts)]
    arrivals = []
    for n in range(90):
        i, b = 1000 + n, n // 30 + 1
        kind, t = rnd.randrange(6), texts[rnd.randrange(40)]
        if kind == 0:
            text = " ".join(t).upper() + "!"
        elif kind in (1, 2):
            text = " ".join(edit(rnd, t, rnd.choice([0.1, 0.2])))
        elif kind == 3:
            text = rnd.choice([None, "", " \n"])
        else:
            fresh = [rnd.choice(vocabulary) for _ in range(40)]
            texts.append(fresh)
            text = " ".join(fresh)
        arrivals.append((i, f"k{rnd.randrange(60)}", None, text, 0, b))
    arrivals += [(2000, None, None, None, 0, 3), (2001, None, digest(" ".join(texts[1])), None, 0, 3), (2002, "k1", None, "long " * 20_000, 0, 3)]
    got = inc.deduplicate(spark.createDataFrame(history, HISTORY), spark.createDataFrame(arrivals, ARRIVALS))
    assert rows(got) == brute(history, arrivals)


def test_empty_tables_and_null_ids(spark, rows):
    none, nobody = spark.createDataFrame([], HISTORY), spark.createDataFrame([], ARRIVALS)
    assert inc.deduplicate(none, nobody).collect() == []
    some = spark.createDataFrame([(1, "k", None, "a b c d", 0, 1), (None, "k", None, "a b c d", 0, 1), (2, "k", None, "A b c d.", 0, 1)], ARRIVALS)
    assert rows(inc.deduplicate(none, some)) == [(1, 2)]


def test_many_copies_are_one_class(spark):
    arrivals = spark.range(1, 3001).selectExpr("id AS item_id", "'k' AS seen_item_key", "CAST(NULL AS STRING) AS content_hash", "concat('one text that is said again and again with some more words ', IF(id % 3 = 0, '', CAST(id AS STRING))) AS extracted_text", "0 AS cls", "1 AS batch_no")
    got = inc.deduplicate(spark.createDataFrame([], HISTORY), arrivals).collect()
    assert len(got) == 2999 and {r.accepted_id for r in got} == {1}


def test_common_in_order():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(1, 30))] for _ in range(2))
        assert inc.common_in_order(np.array(a), np.array(b)) == lcs(a, b)


def test_a_store_is_opened_again(spark, rows, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    history = spark.createDataFrame([(1, "k", None, "a few words of a first text", 0, "")], HISTORY)
    first = spark.createDataFrame([(2, "l", None, "some quite different words in another text", 0, 1), (3, "k", None, None, 0, 1)], ARRIVALS)
    assert rows(inc.deduplicate(history, first, store_path=path)) == [(1, 3)]
    other = spark.newSession()
    more = other.createDataFrame([(4, "m", None, "Some quite different words in another text!", 0, 2), (5, "l", None, "", 0, 2), (2, "l", None, "some quite different words in another text", 0, 1)], ARRIVALS)
    nothing = other.createDataFrame([], HISTORY)
    assert rows(inc.deduplicate(nothing, more, store_path=path)) == [(2, 4), (2, 5)]
    store = inc.FingerprintStore.open(other, path)
    assert store.meta["done"] == ["1", "2"] and store.classes_held == 2
    # a batch that was not committed is as if it had never been
    features = inc.featured(other.createDataFrame([(6, "n", None, "words that nobody has said before in here", 0, 3)], ARRIVALS), "item_id", "seen_item_key", "content_hash", "extracted_text")
    assert inc.admit(store, features).collect() == []
    again = inc.FingerprintStore.open(other, path)
    assert again.classes_held == 2 and inc.admit(again, features).collect() == []
    # merged parts hold the same
    monkeypatch.setattr(inc, "MAX_PARTS", 2)
    again.commit()
    again.compact()
    merged = inc.FingerprintStore.open(spark, path)
    assert len(merged.parts()) < 4 and merged.classes_held == 3
    repeat = inc.featured(spark.createDataFrame([(7, "o", None, "WORDS that nobody has said before in here", 0, 4), (8, "k", None, None, 0, 4)], ARRIVALS), "item_id", "seen_item_key", "content_hash", "extracted_text")
    assert rows(inc.admit(merged, repeat)) == [(1, 8), (6, 7)]


def test_repeats_of_texts_with_many_copies(spark, rows):
    rnd = random.Random(11)
    texts = [[f"t{k}w{rnd.randrange(5000)}" for _ in range(150)] for k in range(12)]
    history = [(100 * k + n, f"k{k}-{n}", f"h{k}-{n}", " ".join(t), 0, "") for k, t in enumerate(texts) for n in range(6)]
    arrivals = [(9000 + 10 * k + n, None, None, " ".join(edit(rnd, t, 0.1)), 0, 1) for k, t in enumerate(texts) for n in range(3)]
    got = inc.deduplicate(spark.createDataFrame(history, HISTORY), spark.createDataFrame(arrivals, ARRIVALS))
    assert rows(got) == sorted(((100 * k, 9000 + 10 * k + n) for k in range(12) for n in range(3)), key=repr)


def test_hot_shingles_count_documents(spark):
    text = "one two three four five " * 9 + "and then the end of it"
    items = inc.featured(spark.createDataFrame([(i, "k", None, text if i == 0 else f"{i} only here {i}", 0, "") for i in range(4)], HISTORY), "item_id", "seen_item_key", "content_hash", "extracted_text")
    assert inc.hot_counts(items, 5).count() == 0


@pytest.mark.parametrize("batch_rows", [700, 3000])
def test_a_family_of_variants(spark, rows, batch_rows):
    rnd = random.Random(13)
    base = [f"b{rnd.randrange(5000)}" for _ in range(200)]
    texts = [[f"x{n}" for n in range(150)] + base] + [edit(rnd, base, rnd.choice([0.05, 0.1, 0.2])) for _ in range(2000)]
    arrivals = [(i, None, None, " ".join(t), 0, 1 + i // batch_rows) for i, t in enumerate(texts)]
    accepted, expected = [], []
    for i, t in enumerate(texts):
        words = inc.word_hashes(" ".join(t))
        hit = next((j for j, other in accepted if inc.alike(words, other)), None)
        if hit is None:
            accepted.append((i, words))
        else:
            expected.append((hit, i))
    got = inc.deduplicate(spark.createDataFrame([], HISTORY), spark.createDataFrame(arrivals, ARRIVALS))
    assert rows(got) == sorted(expected, key=repr)
