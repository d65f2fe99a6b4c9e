"""Problem 8: the corpus as token ids of a public byte-level BPE.

Method (prefix dynamic programming): for every byte prefix of a word the last
token of its encoding is unique; it is found from the tokens that end there by
asking whether token and predecessor stand side by side in a BPE encoding.
Following last tokens back from the end gives the ids.  The stored prefixes
make appends exact without encoding again, and confine an edit to the words
around it (``IncrementalEncoding``).

Scale.  One pass, no shuffle.  The vocabulary travels as the bytes of its file
(under 1 MB).  Each Python worker keeps the ids of the words it has met, up to
``WORDS_KEPT``.  Texts are encoded whole.

Defined cases.  Null and empty texts have no ids: an empty array.  Strings of
special tokens are ordinary text.  Repeated rows come out repeatedly; extra
columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_KEPT = 400_000


def default_vocabulary() -> tuple[str, str]:
    """Path and word pattern of byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class PrefixEncoder:
    """BPE by last tokens of prefixes, over ranks given as ``base64-token rank`` lines."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import ahocorasick
        import regex

        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.words = regex.compile(pattern)
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.matcher.add_word(token.decode("latin-1"), rank)
        self.matcher.make_automaton()
        self.length = {r: len(t) for r, t in self.tokens.items()}
        self._side_by_side: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: join the pair of lowest rank until none is left.  For short inputs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        pair = (a, b)
        known = self._side_by_side.get(pair)
        if known is None:
            if len(self._side_by_side) > 2_000_000:
                self._side_by_side.clear()
            known = self._side_by_side[pair] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """Last tokens of all prefixes of ``data``; those in ``last`` stand already."""
        start = len(last)
        # a token that ends behind ``start`` may begin before it, by at most its own length
        back = max(0, start - 256)
        ends: dict[int, list[int]] = {}
        for end, rank in self.matcher.iter(data[back:].decode("latin-1")):
            if back + end >= start:
                ends.setdefault(back + end, []).append(rank)
        for end in range(start, len(data)):
            for rank in sorted(ends[end], key=self.length.__getitem__, reverse=True):
                before = end - self.length[rank]
                if before < 0 or self.side_by_side(last[before], rank):
                    last.append(rank)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def back(self, last: list[int]) -> list[int]:
        ids, at = [], len(last)
        while at > 0:
            ids.append(last[at - 1])
            at -= self.length[ids[-1]]
        return ids[::-1]

    def word(self, word: str) -> tuple[int, ...]:
        ids = self._known.get(word)
        if ids is None:
            data = word.encode("utf-8")
            one = self.ranks.get(data)
            ids = (one,) if one is not None else tuple(self.back(self.extend([], data)))
            if len(self._known) >= WORDS_KEPT:
                self._known.clear()
            self._known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for word in self.words.findall(text or ""):
            ids.extend(self.word(word))
        return ids


class IncrementalEncoding:
    """A text with the last tokens of its words' prefixes, kept exact under appends and edits."""

    #: Words before an edit that are split anew: white space is divided by what follows it.
    CONTEXT = 2

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.starts: list[int] = []
        self.last: list[list[int]] = []
        self.worked = 0
        self._resplit(0, text, [], [], 0)

    def _resplit(self, first: int, text: str, old_starts: list[int], old_last: list[list[int]], settled: int) -> None:
        """Split ``text`` from word ``first`` on; from ``settled`` on, stop where an old word begins."""
        at = self.starts[first] if first < len(self.starts) else 0
        kept = {s: i for i, s in enumerate(old_starts) if s >= settled}
        tables = dict(zip(self.starts[first:], self.last[first:]))
        words = {s: self.text[s : (self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))] for i, s in enumerate(self.starts) if i >= first}
        del self.starts[first:], self.last[first:]
        for m in self.encoder.words.finditer(text, at):
            if m.start() in kept:
                i = kept[m.start()]
                self.starts += old_starts[i:]
                self.last += old_last[i:]
                break
            word, table = m.group(), []
            if m.start() in words and word.startswith(words[m.start()]):
                table = list(tables[m.start()])  # the word only grew: its prefixes stand
            self.worked += len(word) - len(table)
            self.starts.append(m.start())
            self.last.append(self.encoder.extend(table, word.encode("utf-8")))
        self.text = text

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        from bisect import bisect_right

        first = max(0, bisect_right(self.starts, start) - 1 - self.CONTEXT)
        shift = len(new) - (end - start)
        tail = [(s + shift, t) for s, t in zip(self.starts, self.last) if s >= end]
        text = self.text[:start] + new + self.text[end:]
        self._resplit(first, text, [s for s, _ in tail], [t for _, t in tail], start + len(new) + 1)

    def ids(self) -> list[int]:
        return [i for table in self.last for i in self.encoder.back(table)]


_ENCODERS: dict[int, PrefixEncoder] = {}


def _encoder(vocabulary: bytes, pattern: str) -> PrefixEncoder:
    """One encoder per Python worker and vocabulary."""
    mark = hash((vocabulary, pattern))
    if mark not in _ENCODERS:
        _ENCODERS[mark] = PrefixEncoder(vocabulary, pattern)
    return _ENCODERS[mark]


def _over(docs: DataFrame, key: str, text: str, vocabulary: str | None, pattern: str | None, counts: bool) -> DataFrame:
    path, default_pattern = (vocabulary, pattern) if vocabulary and pattern else default_vocabulary()
    path, pattern = vocabulary or path, pattern or default_pattern
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(key), F.col(text).alias("tw_text"))
    kind = rows.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                if counts:
                    out = pa.array([len(x) for x in ids], pa.int64())
                else:
                    out = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=[key, "n_tokens" if counts else "ids"])

    return rows.mapInArrow(encode, f"`{key}` {kind}, " + ("n_tokens bigint" if counts else "ids array<int>"))


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids) of each document."""
    return _over(docs, key, text, vocabulary, pattern, counts=False)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens) of each document."""
    return _over(docs, key, text, vocabulary, pattern, counts=True)
