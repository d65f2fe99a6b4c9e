"""Problem 5: new batches deduplicated against everything accepted before.

Method: the fingerprints of accepted texts (winnowed shingles of five words)
stand in a persistent store, beside Bloom filters partitioned by fingerprint.
A batch's shingles are screened by the filters; what passes is looked up in
the store; pairs that share a fingerprint are verified by the words both texts
have in the same order.  What is accepted is added to store and filters, so no
batch reads the history's texts again.

A row repeats an accepted item if both have one content hash, if at least
three quarters of the words of the longer text occur in both in the same
order, or if the row has no text and the item has its key.  Rows are taken in
order of batch and id, batch after batch; only accepted items are matched
against, and of several the one with the smallest id is reported.

Which shingles are kept.  Shingles that stand in ``HOT_SHARE`` of the texts or
more select little.  They are counted when texts enter the store, and kept with
it with their counts: at most ``HOT_MOST``.  Of every ``WINDOW`` others in a
row the smallest hash is stored, and of the hot ones the ``HOT_KEPT`` rarest of
each text, which are those it shares with its look-alikes if it has many.  A
text with few others has more hot ones stored, ``FEW`` in all.  A batch is asked with
all of its shingles, hot or not, so which ones are hot decides only what is
stored, never what is found of it.  Texts of at most ``SHORT`` words are looked
up by all pairs of words, those of at most ``MIDDLING`` words by all runs of
three.  A pair of alike texts of which no stored shingle is in both is missed;
the README has the measured recall.

The store.  A folder with the tables ``signs`` (hashes and keys), ``classes``
(one row for all items of one text), ``prints`` and ``hot``, each in parts (one
for each addition) and in buckets by hash, so that a lookup reads the buckets
that it asks only.  A bucket's fingerprints are one row with their filter; the
filter is a column of its own and is read alone.  ``meta-N.json`` names the parts that count; it
is written last, so a run that dies leaves the store as it was, and the next
run does the batch again.  Parts are merged when there are more than
``MAX_PARTS``; the many small ones first, all if they have outgrown the first.

Scale.  Equal texts are one class and are compared once.  Fingerprints are
joined by value and never gathered in one place; a task of the screening holds
about ``BUCKET_PRINTS`` stored and as many asked ones.  Within a batch only
what repeats nothing in the store is paired.  Where more than ``FAMILY``
classes share a fingerprint, the rows before the next one of them are admitted
first and the rest is held against what they added, with twice that number
each time; most of a family then repeats one of a few accepted texts and is
paired with these only.  No pair is left out.  Order within a batch is settled
by rounds over what is still undecided.

Defined cases.  Null, empty and blank texts are no text and have no content
hash unless one is stated.  A null or empty hash is computed.  Texts without
any word are compared by hash only.  Rows without text, hash and key are
accepted.  Rows with a null id are left out.  Rows that repeat an id of the
same batch are one row.  Rows without a batch number come last.  Extra columns
are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import content_digest, digest128, is_blank
from tidewatch.session import broadcast_if_small, keep, materialize, remove, scratch, shared_dir, written_bytes

SHINGLE = 5
WINDOW = 3
SHARE = 0.75
HOT_SHARE = 3e-5
HOT_MOST = 4_000_000
SHORT = 20
MIDDLING = 40
#: So many of a text's hot shingles are stored, the rarest; more of them if it has few others, up to so many in all.
HOT_KEPT = 12
FEW = 24
BUCKET_PRINTS = 1_000_000
#: Where more new classes share a fingerprint than this, the rows up to so many of them are admitted first.
FAMILY = 50
MAX_PARTS = 16
BITS_PER_PRINT = 12
HASHES = 4
COUNTED_TOGETHER = 50_000
SETTLED_AT_ONCE = 4 << 20

WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
#: ``s0`` to ``s3`` are a sketch of 256 bits: one is set for each distinct word.
SKETCH = ("s0", "s1", "s2", "s3")
_SKETCHED = ", ".join(f"{s} bigint" for s in SKETCH)
FEATURES = f"item_id bigint, h1 bigint, h2 bigint, k1 bigint, k2 bigint, mute boolean, cls bigint, n_words int, {_SKETCHED}, words binary"
NARROW = ["item_id", "h1", "h2", "k1", "k2", "mute", "cls"]
TABLES = {
    "signs": "x1 bigint, x2 bigint, item_id bigint",
    "classes": f"cls bigint, item_id bigint, n_words int, {_SKETCHED}, words binary",
    "prints": "n bigint, field binary, fp binary, cls binary, n_words binary",
    "hot": "fp bigint, n bigint",
}
PRINTS = "fp bigint, cls bigint, n_words int"
ROLLED = "bucket int, fp binary, cls binary, n_words binary"
PAIRS_AT_ONCE = 1_000_000


# -- words and shingles of many texts at once --------------------------------------


class _Words(dict):
    """Hash of each word met, four bytes wide as it is stored and shuffled."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) & 0x7FFFFFFF
        return h


_word = _Words()


def word_hashes(text: str) -> np.ndarray:
    return _joined([text])[0]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and the number of words of each."""
    found = [WORD.findall(t.casefold()) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(map(_word.__getitem__, itertools.chain.from_iterable(found)), np.int64, int(sizes.sum())), sizes


def _unpacked(cells) -> tuple[np.ndarray, np.ndarray]:
    """The same from stored words."""
    cells = list(cells)
    sizes = np.fromiter((len(c) // 4 for c in cells), np.int64, len(cells))
    return np.frombuffer(b"".join(cells), np.int32).astype(np.int64), sizes


def _mix(h: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def shingles(words: np.ndarray, sizes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within one text, in order, and the number of its text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, size, np.int64)
    for j in range(size):
        h = h * np.int64(1_000_003) + words[j : j + n]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[:n] == owner[size - 1 :]
    return _mix(h[inside]), owner[:n][inside]


def _whole(words: np.ndarray, sizes: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A fingerprint of each whole text of ``some``."""
    ends = np.cumsum(sizes)
    which = np.flatnonzero(some & (sizes > 0))
    return np.array([xxhash.xxh64_intdigest(words[ends[i] - sizes[i] : ends[i]].tobytes()) >> 1 for i in which], np.int64), which


def _parts(words: np.ndarray, sizes: np.ndarray, short: int, middling: int, all_: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(fingerprints, owners) by kind: of whole texts, pairs, runs of three and of five words.

    Texts of at most ``short`` words have the first two kinds, those of at most
    ``middling`` words the third, the others the last; with ``all_`` shorter
    texts have the kinds of longer ones as well.
    """
    tiny, small = sizes <= short, sizes <= middling
    found = [_whole(words, sizes, tiny)]
    for size, some in ((2, tiny), (3, small if all_ else small & ~tiny), (SHINGLE, np.ones(len(sizes), bool) if all_ else ~small)):
        if some.all():
            found.append(shingles(words, sizes, size))
        elif some.any():
            fp, owner = shingles(words[np.repeat(some, sizes)], sizes[some], size)
            found.append((fp, np.flatnonzero(some)[owner]))
    return found


class Hot:
    """Shingles in many texts, by value, with the logarithm of their counts."""

    def __init__(self, fp: np.ndarray, n: np.ndarray):
        order = np.argsort(fp)
        self.fp, self.n = fp[order], n[order]
        self.level = (1 + np.log2(np.maximum(self.n, 1))).astype(np.uint8)

    def with_more(self, fp: np.ndarray, n: np.ndarray) -> Hot:
        """These and further counts, the highest ``HOT_MOST``."""
        values, where = np.unique(np.concatenate([self.fp, fp]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([self.n, n]), len(values)).astype(np.int64)
        most = np.argsort(-counts, kind="stable")[:HOT_MOST]
        return Hot(values[most], counts[most])

    def levels(self, fp: np.ndarray) -> np.ndarray:
        """0 for what isn't hot."""
        if not len(self.fp):
            return np.zeros(len(fp), np.uint8)
        at = np.minimum(np.searchsorted(self.fp, fp), len(self.fp) - 1)
        return np.where(self.fp[at] == fp, self.level[at], np.uint8(0))


def prints_stored(words: np.ndarray, sizes: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints kept of accepted texts, and their owners."""
    kept = []
    # a text may be a third longer than one that is looked up by its shorter runs
    for fp, owner in _parts(words, sizes, SHORT * 4 // 3, MIDDLING * 4 // 3, True):
        level = hot.levels(fp)
        cold = level == 0
        n_cold = np.bincount(owner[cold], minlength=len(sizes))
        thinned = (n_cold >= FEW) & (sizes > MIDDLING * 4 // 3)
        c, t = fp[cold & thinned[owner]], owner[cold & thinned[owner]]
        if len(c):  # the least of each window, once for the windows in a row that share it
            least = c[: len(c) - WINDOW + 1].copy()
            for j in range(1, WINDOW):
                np.minimum(least, c[j : len(c) - WINDOW + 1 + j], out=least)
            inside = t[WINDOW - 1 :] == t[: len(t) - WINDOW + 1]
            least, own = least[inside], t[: len(t) - WINDOW + 1][inside]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
            kept.append((least[new], own[new]))
        rest = cold & ~thinned[owner]
        kept.append((fp[rest], owner[rest]))
        # the rarest hot ones: all that a text with many look-alikes shares with them is hot
        f, t, l = fp[~cold], owner[~cold], level[~cold]
        order = np.lexsort((f, l, t))
        f, t = f[order], t[order]
        first = np.arange(len(t)) - np.searchsorted(t, t) < np.maximum(HOT_KEPT, FEW - n_cold)[t]
        kept.append((f[first], t[first]))
    return np.concatenate([f for f, _ in kept]), np.concatenate([t for _, t in kept])


def prints_asked(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that new texts are looked up by, and their owners."""
    found = _parts(words, sizes, SHORT, MIDDLING, False)
    return np.concatenate([f for f, _ in found]), np.concatenate([t for _, t in found])


def common_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word of columns at a time."""
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_ = full
    for w in b.tolist():
        match = where.get(w)
        if match:
            hit = open_ & match
            open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def alike(a: np.ndarray, b: np.ndarray, share: float = SHARE) -> bool:
    """Whether ``share`` of the words of the longer text occur in both in the same order."""
    need = share * max(len(a), len(b))
    if min(len(a), len(b)) < need or not len(a):
        return False
    if len(a) - len(set(a.tolist()) - set(b.tolist())) < need:  # each missing word costs one at least
        return False
    return common_in_order(a, b) >= need


def sketches(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Four columns of bits, a row for each text; every text has words."""
    starts = np.cumsum(sizes) - sizes
    bit = np.left_shift(np.int64(1), words & 63)
    lane = (words >> 6) & 3
    return np.stack([np.bitwise_or.reduceat(np.where(lane == i, bit, 0), starts) for i in range(4)])


def featured(rows: DataFrame, key: str, seen_key: str, content_hash: str, text: str, *more: str) -> DataFrame:
    """Rows with the columns of ``FEATURES``: hash computed where missing, class and words of the text; ``more`` comes along."""
    blank = is_blank(F.col(text))
    stated = F.when(F.length(F.trim(F.col(content_hash))) > 0, F.lower(F.trim(F.col(content_hash))))
    narrow = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("item_id"),
        F.coalesce(stated, content_digest(F.col(text))).alias("hash"),
        F.when(F.length(F.col(seen_key)) > 0, F.col(seen_key)).alias("key"),
        blank.alias("mute"),
        F.when(~blank, F.col(text)).alias("text"),
        *[F.col(c).alias(f"tw_{c}") for c in more],
    )
    signs = {f"{c[0]}{i}": F.when(F.col(c).isNotNull(), h) for c in ("hash", "key") for i, h in enumerate(digest128(F.lit(c), F.col(c)), 1)}
    signed = narrow.select("item_id", *[h.alias(n) for n, h in signs.items()], "mute", "text", *[f"tw_{c}" for c in more])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            there = np.array([i for i, t in enumerate(texts) if t is not None], np.int64)
            words, sizes = _joined([texts[i] for i in there.tolist()])
            there, sizes = there[sizes > 0], sizes[sizes > 0]
            n, ends, narrow = len(texts), np.cumsum(sizes), words.astype(np.int32)
            cells: list[bytes | None] = [None] * n
            classes: list[int | None] = [None] * n
            for i, end, size in zip(there.tolist(), ends.tolist(), sizes.tolist()):
                cells[i] = narrow[end - size : end].tobytes()
                classes[i] = xxhash.xxh3_64_intdigest(cells[i]) - (1 << 63)
            counts, drawn = np.zeros(n, np.int32), np.zeros((4, n), np.int64)
            counts[there] = sizes
            if len(there):
                drawn[:, there] = sketches(words, sizes)
            made = {"cls": pa.array(classes, pa.int64()), "n_words": pa.array(counts), **{s: pa.array(d) for s, d in zip(SKETCH, drawn)}, "words": pa.array(cells, pa.binary())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(names.index(c)) for c in wanted], names=wanted)

    kinds, names = dict(signed.dtypes), signed.columns
    schema = ", ".join([FEATURES, *[f"tw_{c} {kinds[f'tw_{c}']}" for c in more]])
    wanted = [c.split(" ")[0] for c in schema.split(", ")]
    return signed.mapInArrow(features, schema)


def _exploded(batches: Iterator[pd.DataFrame], prints) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words, sizes = _unpacked(batch["words"])
        fp, owner = prints(words, sizes)
        yield pd.DataFrame({"fp": fp, "cls": batch["cls"].to_numpy(np.int64)[owner], "n_words": batch["n_words"].to_numpy(np.int32)[owner]})


def _asked(classes: DataFrame) -> DataFrame:
    """(fp, cls, n_words): what the texts of ``classes`` are looked up by."""
    return classes.select("cls", "n_words", "words").mapInPandas(lambda batches: _exploded(batches, prints_asked), PRINTS)


def _once(fp: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The fingerprints, once for each of their owners."""
    both = fp ^ _mix(owner.astype(np.int64))
    ordered = np.sort(both)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return fp
    twice = again[np.minimum(np.searchsorted(again, both), len(again) - 1)] == both
    _, first = np.unique(both[twice], return_index=True)
    return np.concatenate([fp[~twice], fp[twice][first]])


def hot_counts(classes: DataFrame, least: float) -> DataFrame:
    """(fp, n) of shingles in at least ``least`` texts.

    They are counted over ``COUNTED_TOGETHER`` texts at a time; one met once
    only among these doesn't count there, so counts may come out lower than
    they are.  They decide what is stored of a text, not what is found.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        texts = 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and len(batch):
                words, sizes = _unpacked(batch["words"])
                held += [_once(fp, owner) for fp, owner in _parts(words, sizes, SHORT * 4 // 3, MIDDLING * 4 // 3, True)]
                texts += len(batch)
            if held and (batch is None or texts >= COUNTED_TOGETHER):
                fp, n = np.unique(np.concatenate(held), return_counts=True)
                yield pd.DataFrame({"fp": fp[n > 1], "n": n[n > 1]})
                held, texts = [], 0

    counted = classes.select("words").mapInPandas(count, TABLES["hot"])
    return counted.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# -- the store ---------------------------------------------------------------------


def _spread(c: str, buckets: int) -> Column:
    return F.pmod(F.shiftright(F.col(c), 40), F.lit(buckets)).cast("int")


class FingerprintStore:
    """Accepted items, their fingerprints and the Bloom filters, under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version = 0
        #: parts that count: name -> {"bytes": of its prints, "classes": n}; buckets of prints and filters, of classes and signs; batches admitted
        self.meta: dict = {"parts": {}, "buckets": 4, "class_buckets": 1, "next": 0, "done": []}
        self._hot: Hot | None = None

    # -- opening and committing ------------------------------------------------

    @classmethod
    def create(cls, items: DataFrame, path: str | None = None) -> FingerprintStore:
        """A store holding ``items`` (columns as in ``FEATURES``) as accepted."""
        store = cls(items.sparkSession, path or f"{shared_dir(items.sparkSession)}/fingerprints-{uuid.uuid4().hex}")
        with scratch(store.spark):
            items = materialize(items, "history")
            firsts = items.where("cls IS NOT NULL").groupBy("cls").agg(F.min("item_id").alias("item_id"), F.max("n_words").alias("n_words"))
            firsts = materialize(firsts, "history-classes")
            n, words = firsts.agg(F.count(F.lit(1)), F.sum("n_words")).first()
            # about half of the shingles are kept; twice as many find room
            store.meta["buckets"] = max(4, -(-(words or 0) // BUCKET_PRINTS))
            store.meta["class_buckets"] = max(1, store.meta["buckets"] // 8)
            copies = items.select("cls", "item_id").join(firsts.select("cls", F.col("item_id").alias("first")), "cls").where("item_id <> first")
            copies = broadcast_if_small(materialize(copies.select("cls", "item_id"), "copies"))
            store._add(items.select(*NARROW), items.where("cls IS NOT NULL").join(copies, ["cls", "item_id"], "left_anti"), n)
            store.commit()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintStore | None:
        """The store kept at ``path`` as it was last committed; null if there is none."""
        store = cls(spark, path)
        where, fs = store._file("")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        versions = [int(m[1]) for name in names if (m := re.fullmatch(r"meta-(\d+)\.json", name))]
        if not versions:
            return None
        store.version = max(versions)
        stream = fs.open(store._file(f"meta-{store.version}.json")[0])
        try:
            store.meta = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return store

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commit(self) -> None:
        """Make the parts added so far count; fails if another writer was faster."""
        path, fs = self._file(f"meta-{self.version + 1}.json")
        half, _ = self._file(f"half-{uuid.uuid4().hex}")
        out = fs.create(half, False)
        try:
            out.write(bytearray(json.dumps(self.meta).encode()))
        finally:
            out.close()
        if fs.exists(path) or not fs.rename(half, path):
            fs.delete(half, False)
            raise RuntimeError(f"{self.path} was changed by another writer")
        self.version += 1

    def drop(self) -> None:
        remove(self.spark, self.path)

    @property
    def classes_held(self) -> int:
        return sum(p["classes"] for p in self.meta["parts"].values())

    # -- reading ---------------------------------------------------------------

    def _read(self, name: str, parts: list[str], hit: list[int] | None = None) -> DataFrame:
        """A table's parts; of the buckets only those in ``hit``."""
        where = f"{self.path}/{name}"
        rows = self.spark.read.schema(f"{TABLES[name]}, part int, bucket int").option("basePath", where).parquet(*[f"{where}/part={p}" for p in parts])
        return rows if hit is None else rows.where(F.col("bucket").isin(hit))

    def parts(self, since: int = 0) -> list[str]:
        return [p for p in self.meta["parts"] if int(p) >= since]

    def hot(self) -> Hot:
        if self._hot is None:
            self._hot = Hot(np.zeros(0, np.int64), np.zeros(0, np.int64))
            for p in self.parts():
                self._grow_hot(p)
        return self._hot

    def _grow_hot(self, part: str) -> None:
        more = self.spark.read.schema(TABLES["hot"]).parquet(f"{self.path}/hot/part={part}").toArrow()  # at most HOT_MOST rows
        self._hot = self._hot.with_more(more["fp"].to_numpy(), more["n"].to_numpy())

    # -- adding ----------------------------------------------------------------

    def _write(self, df: DataFrame, name: str, part: int) -> None:
        (df.repartition("bucket") if self.meta["class_buckets"] > 1 else df).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/part={part}")

    def kept(self, classes: DataFrame) -> DataFrame:
        """(fp, cls, n_words): what is stored of the texts of ``classes``."""
        hot = self.spark.sparkContext.broadcast(self.hot())  # at most HOT_MOST entries
        return classes.select("cls", "n_words", "words").mapInPandas(lambda batches: _exploded(batches, lambda w, s: prints_stored(w, s, hot.value)), PRINTS)

    def learn_hot(self, classes: DataFrame, held: int, part: int) -> None:
        """Count the shingles of new texts and keep what is hot with the part."""
        least = max(5.0, HOT_SHARE * (self.classes_held + held))
        self.hot()
        path = f"{self.path}/hot/part={part}"
        hot_counts(classes, least).write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(TABLES["hot"]).parquet(path)
        if written_bytes(self.spark, path) > 8 * HOT_MOST:  # average shingles / HOT_SHARE at most; HOT_MOST whatever the texts are like
            most = materialize(written.orderBy(F.desc("n"), "fp").limit(HOT_MOST), "hot")
            most.write.mode("overwrite").parquet(path)
        self._grow_hot(str(part))

    def _add(self, rows: DataFrame, classes: DataFrame, held: int, prints: DataFrame | None = None) -> int:
        """Write a further part: ``rows`` with ``NARROW``'s columns, one of each of the ``held`` classes with its words, and its prints."""
        part = self.meta["next"]
        self.meta["next"] += 1
        cb = self.meta["class_buckets"]
        signs = rows.select("item_id", F.inline(F.array(F.struct(F.col("h1").alias("x1"), F.col("h2").alias("x2")), F.struct(F.col("k1").alias("x1"), F.col("k2").alias("x2"))))).where("x1 IS NOT NULL")
        signs = signs.groupBy("x1", "x2").agg(F.min("item_id").alias("item_id"))
        self._write(signs.withColumn("bucket", _spread("x1", cb)), "signs", part)
        columns = [c.split(" ")[0] for c in TABLES["classes"].split(", ")]
        self._write(classes.select(*columns, _spread("cls", cb).alias("bucket")), "classes", part)
        written = self._read("classes", [str(part)])
        self.learn_hot(written, held, part)
        self._roll(self.kept(written) if prints is None else prints, part, held)
        return part

    def _roll(self, prints: DataFrame, part: int, held: int) -> None:
        """Write a part's fingerprints, sorted, a row for each bucket with its Bloom filter."""

        def roll(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("fp")
            fp = group["fp"].to_numpy(np.int64)
            marks = np.zeros(1 << max(10, (len(fp) * BITS_PER_PRINT).bit_length()), bool)
            for at in _positions(fp, len(marks)):
                marks[at] = True
            cells = fp.tobytes(), group["cls"].to_numpy(np.int64).tobytes(), group["n_words"].to_numpy(np.int32).tobytes()
            return pd.DataFrame([(group["bucket"].iloc[0], len(fp), np.packbits(marks, bitorder="little").tobytes(), *cells)], columns=["bucket", "n", "field", "fp", "cls", "n_words"])

        rolled = prints.withColumn("bucket", _spread("fp", self.meta["buckets"])).groupBy("bucket").applyInPandas(roll, f"bucket int, {TABLES['prints']}")
        rolled.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/prints/part={part}")
        self.meta["parts"][str(part)] = {"bytes": written_bytes(self.spark, f"{self.path}/prints/part={part}"), "classes": held}

    def compact(self) -> None:
        """Merge parts if there are too many: all but the first, or all with more buckets if these have outgrown it."""
        first, *others = self.parts()
        if len(others) + 1 <= MAX_PARTS:
            return
        counts = self.meta["parts"]
        if sum(counts[p]["bytes"] for p in others) >= counts[first]["bytes"]:
            others = [first, *others]
            self.meta["buckets"] = max(4, -(-2 * sum(p["bytes"] for p in counts.values()) // (20 * BUCKET_PRINTS)))
            self.meta["class_buckets"] = max(1, self.meta["buckets"] // 8)
        part = self.meta["next"]
        self.meta["next"] += 1
        cb = self.meta["class_buckets"]
        signs = self._read("signs", others).groupBy("x1", "x2").agg(F.min("item_id").alias("item_id"))
        self._write(signs.withColumn("bucket", _spread("x1", cb)), "signs", part)
        self._write(self._read("classes", others).drop("part").withColumn("bucket", _spread("cls", cb)), "classes", part)
        hot = self.spark.read.schema(TABLES["hot"]).parquet(*[f"{self.path}/hot/part={p}" for p in others])
        hot.groupBy("fp").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{self.path}/hot/part={part}")
        self._roll(self._read("prints", others).select("fp", "cls", "n_words").mapInPandas(_unrolled, PRINTS), part, sum(counts[p]["classes"] for p in others))
        for p in others:
            del counts[p]
        self.commit()
        for name in TABLES:
            for p in others:
                remove(self.spark, f"{self.path}/{name}/part={p}")

    # -- asking ----------------------------------------------------------------

    def screened(self, asked: DataFrame, expected: int, texts: int, parts: list[str]) -> DataFrame:
        """Those of about ``expected`` asked fingerprints of ``texts`` texts that the filters of ``parts`` may hold."""
        buckets = self.meta["buckets"]
        # so that a task has about BUCKET_PRINTS of them, though all texts may ask one fingerprint
        salts = -(-(expected // buckets + texts) // BUCKET_PRINTS)

        def screen(key, group: pd.DataFrame, fields: pd.DataFrame) -> pd.DataFrame:
            fp = group["fp"].to_numpy(np.int64)
            hit = np.zeros(len(fp), bool)
            for field in fields["field"] if len(fp) else ():
                bits = np.frombuffer(field, np.uint8)
                maybe = np.ones(len(fp), bool)
                for at in _positions(fp, 8 * len(bits)):
                    maybe &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                hit |= maybe
            cells = [group[c].to_numpy(t)[hit].tobytes() for c, t in (("fp", np.int64), ("cls", np.int64), ("n_words", np.int32))]
            return pd.DataFrame([(key[0], *cells)] if hit.any() else [], columns=["bucket", "fp", "cls", "n_words"])

        keyed = asked.withColumn("bucket", _spread("fp", buckets)).withColumn("salt", F.pmod(F.col("cls"), F.lit(salts)).cast("int"))
        fields = self._read("prints", parts).select("bucket", "field", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        return keyed.groupBy("bucket", "salt").cogroup(fields.groupBy("bucket", "salt")).applyInPandas(screen, ROLLED)

    def matches(self, classes: DataFrame, texts: int, words: int, since: int) -> DataFrame:
        """(cls, accepted): the first item with a text like that of each of ``classes``, in the parts from ``since`` on."""
        parts = self.parts(since)
        hits = materialize(self.screened(_asked(classes), words, texts, parts), "hits")
        # many fingerprints fall into all buckets; of few it is worth knowing which ones they ask
        asked = [r[0] for r in hits.select("bucket").distinct().collect()] if words < 8 * self.meta["buckets"] else None
        stored = self._read("prints", parts, asked).select("bucket", *[F.col(c).alias(f"b_{c}") for c in ("fp", "cls", "n_words")])
        both = stored.join(broadcast_if_small(hits), "bucket").select("fp", "cls", "n_words", "b_fp", "b_cls", "b_n_words")
        pairs = materialize(both.mapInPandas(_looked_up, "cls bigint, other bigint"), "pairs")
        links = _verified(pairs, classes, self._read("classes", parts, self._hit(pairs, "other", texts)))
        return materialize(links.groupBy("cls").agg(F.min("item_id").alias("accepted")), "links")

    def _hit(self, rows: DataFrame, c: str, expected: int) -> list[int] | None:
        """The buckets of classes or signs that hold the values of a column; null for all if so many values are expected to need them."""
        n = self.meta["class_buckets"]
        return [r[0] for r in rows.select(_spread(c, n).alias("b")).distinct().collect()] if n > 1 and expected < 8 * n else None

    def known_signs(self, rows: DataFrame, texts: int, since: int) -> DataFrame:
        """(item_id, accepted): the first item of each part with the content hash of a row, or with the key of one without text."""
        own = F.struct(F.col("h1").alias("x1"), F.col("h2").alias("x2"))
        mute = F.when(F.col("mute"), F.struct(F.col("k1").alias("x1"), F.col("k2").alias("x2")))
        asked = rows.select(F.col("item_id").alias("row"), F.inline(F.array(own, mute))).where("x1 IS NOT NULL")
        stored = self._read("signs", self.parts(since), self._hit(asked, "x1", texts))  # a sign is there once in each part
        return stored.join(broadcast_if_small(asked, of=rows), ["x1", "x2"]).select(F.col("row").alias("item_id"), F.col("item_id").alias("accepted"))


def _positions(fps: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = _mix(fps).view(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    for i in range(HASHES):
        yield ((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def _numbers(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.int32)


def _unrolled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield pd.DataFrame(dict(zip(("fp", "cls", "n_words"), _numbers(row))))


def _looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(cls, other) that share a fingerprint and may be alike by their lengths, from asked and stored fingerprints of one bucket."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            (fp, cls, n), (held, other, m) = _numbers(row[:3]), _numbers(row[3:])
            low = np.searchsorted(held, fp)
            times = np.searchsorted(held, fp, "right") - low
            fp, cls, n, low, times = (x[times > 0] for x in (fp, cls, n, low, times))
            ends = np.cumsum(times)
            begin = 0
            while begin < len(times):  # one fingerprint that all texts have may make any number of pairs
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
                t = times[begin:end]
                at = np.repeat(low[begin:end] - (ends[begin:end] - t - done), t) + np.arange(ends[end - 1] - done)
                a, b = np.repeat(n[begin:end], t), m[at]
                near = np.minimum(a, b) >= SHARE * np.maximum(a, b)
                yield pd.DataFrame({"cls": np.repeat(cls[begin:end], t)[near], "other": other[at][near]}).drop_duplicates()
                begin = end


def _near(n: Column, m: Column) -> Column:
    return F.least(n, m) >= SHARE * F.greatest(n, m)


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(cls, other, item_id) of the written ``pairs`` whose texts are alike; the item is the other's.

    Sketches go first: a word of one text whose bit the other lacks is missing
    there, and each missing word costs one at least.  Few pairs are left for
    which the words themselves are fetched.
    """
    a = left.select("cls", F.col("n_words").alias("n"), *[F.col(s).alias(f"a{i}") for i, s in enumerate(SKETCH)])
    b = right.select(F.col("cls").alias("other"), F.col("n_words").alias("m"), *[F.col(s).alias(f"b{i}") for i, s in enumerate(SKETCH)])
    missing, extra = (sum(F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(f"{y}{i}"))) for i in range(4)) for x, y in ("ab", "ba"))
    need = SHARE * F.greatest("n", "m")
    a = broadcast_if_small(a, of=left)
    likely = b.join(broadcast_if_small(pairs), "other").join(a, "cls").where((F.col("n") - missing >= need) & (F.col("m") - extra >= need))
    likely = broadcast_if_small(materialize(likely.select("cls", "other").distinct(), "likely"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [x == y or alike(np.frombuffer(x, np.int32), np.frombuffer(y, np.int32)) for x, y in zip(batch["a"], batch["b"])]
            yield batch.loc[same, ["cls", "other", "item_id"]]

    words = right.select(F.col("cls").alias("other"), "item_id", F.col("words").alias("b")).join(likely, "other")
    texts = broadcast_if_small(left.select("cls", F.col("words").alias("a")), of=left)
    both = words.join(texts, "cls").select("cls", "other", "item_id", "a", "b")
    return both.mapInPandas(check, "cls bigint, other bigint, item_id bigint")


def _rows_of(features: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch without their words, and one of each class with them."""
    rows = features.select(*by, *NARROW).dropDuplicates([*by, "item_id"])
    return rows, features.where("cls IS NOT NULL").dropDuplicates([*by, "cls"]).select(*by, "item_id", "cls", "n_words", *SKETCH, "words")


def admit(store: FingerprintStore, features: DataFrame, family: int = FAMILY) -> DataFrame:
    """(accepted_id, repeat_id) of each row of a batch that repeats an item; the others are added to the store.

    ``features`` has the columns of ``FEATURES``; its rows are taken in order
    of ``item_id``.  The store is not committed.
    """
    return _admit(store, *_rows_of(features), family)


def _admit(store: FingerprintStore, rows: DataFrame, classes: DataFrame, family: int) -> DataFrame:
    found = []
    with scratch(store.spark):
        since, rows = 0, materialize(rows, "rows")
        while True:
            classes = materialize(classes, "classes")
            texts, words = classes.agg(F.count(F.lit(1)), F.sum("n_words")).first()
            by_text = store.matches(classes, texts, words or 0, since).join(rows.select("item_id", "cls"), "cls").select("item_id", "accepted")
            known = by_text.unionByName(store.known_signs(rows, texts, since)).groupBy("item_id").agg(F.min("accepted").alias("accepted"))
            known = materialize(known, "known")
            found.append(known.select(F.col("accepted").alias("accepted_id"), F.col("item_id").alias("repeat_id")))
            fresh = materialize(rows.join(broadcast_if_small(known.select("item_id"), of=known), "item_id", "left_anti"), "fresh")
            inner = materialize(classes.join(broadcast_if_small(fresh.select("cls"), of=fresh), "cls", "left_semi"), "fresh-classes")
            own = materialize(store.kept(inner), "own")
            part, cut = store.meta["next"], _cut(own, inner, family)
            if cut is None:
                found.append(_admit_fresh(store, fresh, inner, own, own))
                break
            # what stands before the cut is admitted first; the rest is held against what that added
            ahead = materialize(fresh.where(F.col("item_id") < cut), "ahead")
            some = materialize(inner.join(broadcast_if_small(ahead.select("cls"), of=ahead), "cls", "left_semi"), "ahead-classes")
            found.append(_admit_fresh(store, ahead, some, own.join(broadcast_if_small(some.select("cls"), of=some), "cls", "left_semi"), own))
            rows = materialize(fresh.where(F.col("item_id") >= cut), "behind")
            classes = inner.join(broadcast_if_small(rows.select("cls"), of=rows), "cls", "left_semi")
            since, family = part, 2 * family
        everything = found[0]
        for more in found[1:]:
            everything = everything.unionByName(more)
        return keep(materialize(everything, "repeats"))


def _cut(own: DataFrame, classes: DataFrame, family: int) -> int | None:
    """The smallest row from which on more than ``family`` classes share a fingerprint."""
    counts = own.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= family:
        return None
    shared = broadcast_if_small(materialize(counts.where(F.col("n") > family).select("fp"), "shared"))
    held = own.select("fp", "cls").join(shared, "fp", "left_semi").distinct().join(classes.select("cls", F.col("item_id").alias("first")), "cls")
    nth = F.row_number().over(Window.partitionBy("fp").orderBy("first"))
    return held.withColumn("nth", nth).where(F.col("nth") <= family + 1).where(F.col("nth") == family + 1).agg(F.min("first")).first()[0]


def _admit_fresh(store: FingerprintStore, rows: DataFrame, classes: DataFrame, own: DataFrame, whole: DataFrame) -> DataFrame:
    """``admit`` for rows that repeat nothing in the store: they are held against each other only.  ``own`` is part of the written ``whole``."""
    held = own.select("fp", F.col("cls").alias("other"), F.col("n_words").alias("m"))
    one = _asked(classes).join(broadcast_if_small(held, of=whole), "fp").where("cls <> other").where(_near(F.col("n_words"), F.col("m")))
    pairs = materialize(one.select(F.least("cls", "other").alias("cls"), F.greatest("cls", "other").alias("other")).distinct(), "inner")
    among = materialize(_verified(pairs, classes, classes).select("cls", "other"), "among")
    repeats = _settle(rows, among)
    taken = materialize(rows.join(broadcast_if_small(repeats.select(F.col("repeat_id").alias("item_id")), of=repeats), "item_id", "left_anti"), "taken")
    firsts = materialize(taken.where("cls IS NOT NULL").groupBy("cls").agg(F.min("item_id").alias("item_id")), "taken-classes")
    new = classes.drop("item_id").join(broadcast_if_small(firsts), "cls")
    store._add(taken, new, firsts.count(), own.join(broadcast_if_small(firsts.select("cls"), of=firsts), "cls", "left_semi"))
    return repeats


def _settle(rows: DataFrame, among: DataFrame) -> DataFrame:
    """(accepted_id, repeat_id) within one batch, rows taken in order of id.

    Every row sends out what it is (hash, class, key) and listens to what would
    make it a repeat.  A row that hears an accepted earlier one is a repeat; a
    row that hears no earlier one left undecided is accepted; the rest waits.
    Links pass between classes, after their rows have been put together.  Up to
    ``SETTLED_AT_ONCE`` bytes of this are settled by the driver in one go,
    more in rounds; the result is the same.
    """
    text, own = F.struct(F.col("cls").alias("x1"), F.lit(1).cast("bigint").alias("x2")), F.struct(F.col("h1").alias("x1"), F.col("h2").alias("x2"))
    key = F.struct(F.col("k1").alias("x1"), F.col("k2").alias("x2"))
    sent = rows.select("item_id", F.inline(F.array(own, key, text))).where("x1 IS NOT NULL")
    heard = rows.select("item_id", F.inline(F.array(own, F.when(F.col("mute"), key), text))).where("x1 IS NOT NULL")
    both = among.unionByName(among.select(F.col("other").alias("cls"), F.col("cls").alias("other")))
    passing = both.select(F.col("other").alias("x1"), F.lit(1).cast("bigint").alias("x2"), F.col("cls").alias("to"))
    passing = broadcast_if_small(passing, of=among)

    def lowest(said: DataFrame) -> DataFrame:
        """(x1, x2, yes, open): the first accepted and the first undecided row that each sign is heard from."""
        parts = said.groupBy("x1", "x2").agg(F.min("yes").alias("yes"), F.min("open").alias("open"))
        passed = parts.join(passing, ["x1", "x2"]).select(F.col("to").alias("x1"), "x2", "yes", "open")
        return parts.unionByName(passed).groupBy("x1", "x2").agg(F.min("yes").alias("yes"), F.min("open").alias("open"))

    nobody = F.lit(None).cast("bigint")
    first = lowest(sent.select("x1", "x2", nobody.alias("yes"), F.col("item_id").alias("open")))
    listening = heard.join(first, ["x1", "x2"]).groupBy("item_id").agg(F.collect_list(F.struct("x1", "x2")).alias("signs"), F.min("open").alias("open"))
    listening = materialize(listening.where("open < item_id").select("item_id", F.inline("signs")), "listening")
    asked = listening.select("x1", "x2")
    asked = asked.unionByName(asked.join(passing.select(F.col("to").alias("x1"), "x2", F.col("x1").alias("from")), ["x1", "x2"]).select(F.col("from").alias("x1"), "x2"))
    asked = materialize(asked.distinct(), "asked")
    senders = materialize(sent.join(broadcast_if_small(asked), ["x1", "x2"], "left_semi"), "senders")
    spark = rows.sparkSession
    if sum(written_bytes(spark, t._tidewatch_path) for t in (listening, senders, among)) <= SETTLED_AT_ONCE:
        return materialize(spark.createDataFrame(_settled(*[t.toArrow() for t in (listening, senders, among)]), "accepted_id bigint, repeat_id bigint"), "repeats")
    state = listening.select("item_id", F.lit(0).alias("state")).distinct()  # 0 undecided, 1 accepted, 2 repeat; all others are accepted

    def said() -> DataFrame:
        status = senders.join(state, "item_id", "left").select("x1", "x2", "item_id", F.coalesce("state", F.lit(1)).alias("state"))
        return status.select("x1", "x2", F.when(F.col("state") == 1, F.col("item_id")).alias("yes"), F.when(F.col("state") == 0, F.col("item_id")).alias("open"))

    while not state.where("state = 0").isEmpty():
        seen = listening.join(lowest(said()), ["x1", "x2"]).groupBy("item_id").agg(
            F.min(F.when(F.col("yes") < F.col("item_id"), F.col("yes"))).alias("yes"), F.max(F.col("open") < F.col("item_id")).alias("open")
        )
        after = state.join(seen, "item_id", "left").select(
            "item_id",
            F.when(F.col("state") != 0, F.col("state")).when(F.col("yes").isNotNull(), 2).when(F.coalesce("open", F.lit(False)), 0).otherwise(1).alias("state"),
        )
        state = materialize(after, "settled")
    # the earliest accepted one is known only now that all are decided
    target = listening.join(lowest(said()), ["x1", "x2"]).where("yes < item_id").groupBy("item_id").agg(F.min("yes").alias("yes"))
    return materialize(state.where("state = 2").join(target, "item_id").select(F.col("yes").alias("accepted_id"), F.col("item_id").alias("repeat_id")), "repeats")


def _settled(listening: pa.Table, senders: pa.Table, among: pa.Table) -> list[tuple[int, int]]:
    """The same for tables of bounded size, row after row."""
    links: dict[int, list[int]] = {}
    for a, b in zip(*(among[c].to_pylist() for c in ("cls", "other"))):
        links.setdefault(a, []).append(b)
        links.setdefault(b, []).append(a)
    hears: dict[int, list[tuple[int, int]]] = {}
    says: dict[int, list[tuple[int, int]]] = {}
    for table, into in ((listening, hears), (senders, says)):
        for i, *sign in zip(*(table[c].to_pylist() for c in ("item_id", "x1", "x2"))):
            into.setdefault(i, []).append(tuple(sign))
    first: dict[tuple[int, int], int] = {}  # the first accepted row that each sign is heard from
    found = []
    for i in sorted({*hears, *says}):
        earlier = [first[s] for s in hears.get(i, ()) if s in first]
        if earlier:
            found.append((min(earlier), i))
            continue
        for s in says.get(i, ()):
            for heard in [s, *[(c, 1) for c in links.get(s[0], ()) if s[1] == 1]]:
                first.setdefault(heard, i)
    return found


def deduplicate(
    history: DataFrame,
    arrivals: DataFrame,
    batch: str = "batch_no",
    key: str = "item_id",
    seen_key: str = "seen_item_key",
    content_hash: str = "content_hash",
    text: str = "extracted_text",
    store_path: str | None = None,
) -> DataFrame:
    """(accepted_id, repeat_id) of all repeats in ``arrivals``, batch after batch, against ``history`` and each other.

    With ``store_path`` the store is kept there.  If one stands there already,
    ``history`` is not read again, and batches that it has admitted are left out.
    Without, the store is made of ``history`` and deleted at the end.
    """
    spark = arrivals.sparkSession
    with scratch(spark):
        store = FingerprintStore.open(spark, store_path) if store_path else None
        if store is None:
            store = FingerprintStore.create(featured(history, key, seen_key, content_hash, text), store_path)
        parted = f"tw_{batch}"
        features = materialize(featured(arrivals, key, seen_key, content_hash, text, batch), "arrivals")
        rows, classes = (materialize(t, "arrived", parted) for t in _rows_of(features, parted))
        numbers = [r[0] for r in rows.select(parted).distinct().collect()]  # one row per batch
        found = spark.createDataFrame([], "accepted_id bigint, repeat_id bigint")
        for number in sorted(numbers, key=lambda n: (n is None, n)):
            if str(number) in store.meta["done"]:
                continue
            some = F.col(parted).eqNullSafe(F.lit(number))
            found = found.unionByName(_admit(store, rows.where(some).drop(parted), classes.where(some).drop(parted), FAMILY))
            store.meta["done"].append(str(number))
            store.commit()
            store.compact()
        found = keep(materialize(found, "repeats"))
        if not store_path:
            store.drop()
    return found
