"""Problem 10: sentence units across languages and scripts.

Method (document-centred disambiguation): whether a period ends a sentence is
settled, where it is in doubt, by unambiguous occurrences elsewhere: first in
the document, then in the whole corpus.  A word that the document has in lower
case is no proper name, so a capital on it starts a sentence.  Of each short
word before a period it is counted what follows:

* a lower-case word or a comma: it is an abbreviation; if capitals follow it too,
  it may also close a sentence, and does so before one,
* numbers mostly: it refers, and ends nothing before a number,
* capitals, of many different words that are never met in lower case: it stands
  before names and ends nothing, unless it has periods inside (U.S.),

* one and the same word, and it is never met without the period: it is bound to that
  word if that is an abbreviation too,

and of each word how often it follows a number with a period (German ordinals).
No list of abbreviations, titles or months is used.  Scripts without capitals
or spaces have terminator rules of their own.  Quotations and brackets inside a
sentence suspend its terminators.

Scale.  Two passes, each without a shuffle of texts.  The first counts words
per batch and sends only sums to the shuffle.  A word enters the corpus tables
only with at least ``SHARE`` of all words counted, so each table has at most
``1 / SHARE`` entries however large the corpus is; that is what is collected
and broadcast.  A text is split in time linear in its length, paragraph by
paragraph.

Defined cases.  Null texts and texts without a visible character give no row.
Repeated rows come out repeatedly; extra columns are ignored.  ``lang`` is not
used: it may be missing or wrong.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize

SHARE = 5e-6

TERMINATORS = re.compile(r"[.!?…。！？｡؟۔।॥]+(?:[   ][!?]+)*")
STRONG = frozenset("。！？｡؟۔।॥")
#: Opening marks and what closes them.
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "《": "》", "〈": "〉"}
CLOSERS = frozenset("”»›」』）)]》〉\"’")
OPENERS = frozenset("“„«‹「『（([《〈‘\"'¿¡")
QUOTED_ON = re.compile(r"(?:と|って|という|との|など)")

BLANK_LINES = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
BULLET = re.compile(r"[^\S\n]*[-–—*•·‣▪◦●○][^\S\n]+\S")
NUMBER = re.compile(r"[^\S\n]*\(?(\d{1,3})[.)][^\S\n]+\S")
LETTER = re.compile(r"[^\S\n]*\(?([a-z])\)[^\S\n]+\S")

WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
_L = r"(?:[^\W\d_]|[\u00ad\u200b-\u200d\u2060\ufeff])"  # invisible characters inside a word belong to it
BEFORE = re.compile(rf"(\d[\d.,]*|{_L}+(?:[.-]{_L}+)*)$")
PREVIOUS = re.compile(r"([^\W\d_]+|\d+)(\.?)\s*$")

THAI = re.compile(r"[฀-๿]")
THAI_SPACE = re.compile(r"[^\S\n]+")


def _is_lower(c: str) -> bool:
    return c.islower()


def _is_upper(c: str) -> bool:
    return c.isupper() or c.istitle()


def _script(c: str) -> str:
    """Coarse script of a letter: cased, or the Unicode block's first word."""
    return "cased" if c.lower() != c.upper() else unicodedata.name(c, "?").split(" ")[0]


class Corpus(NamedTuple):
    """What the whole corpus shows of words before a period, by what follows, and of words at large."""

    common: frozenset[str] = frozenset()  #: usual in lower case
    inner: frozenset[str] = frozenset()  #: abbreviations that end no sentence
    closing: frozenset[str] = frozenset()  #: abbreviations that may close one
    naming: frozenset[str] = frozenset()  #: what stands before names
    referring: frozenset[str] = frozenset()  #: what stands before numbers
    ordinal: frozenset[str] = frozenset()  #: what follows an ordinal number
    bound: frozenset[str] = frozenset()  #: never met without a period, and followed by one word only


#: A short word before a period, and what follows: a comma, or (behind opening marks) a word or number.
CONTEXT = re.compile(r"(?<![^\W_])(?<![^\W_]\.)(?<![^\W_][’'-])([^\W\d_]{1,6}(?:\.[^\W\d_]{1,3}){0,3})\.(?=(\s*[,;:])|\s+[“„«‹「(\[‘\"'¿¡]*(\w+))")
ORDINAL = re.compile(r"(?<![\w.,])\d{1,2}\. ([^\W\d_]+)")


class _Document:
    """What one document shows, found when first asked for."""

    def __init__(self, text: str, corpus: Corpus):
        self.text, self.corpus = text, corpus
        self._lower: set[str] | None = None
        self._inner: set[str] | None = None

    def usual_in_lower_case(self, word: str) -> bool:
        if self._lower is None:
            self._lower = {w for w in set(WORD.findall(self.text)) if w[0].islower()}
        return word.lower() in self._lower or word.lower() in self.corpus.common

    def is_abbreviation(self, word: str) -> bool:
        """Whether the document has the word with a period before a comma or a lower-case word, or the corpus takes it for one."""
        if word in self.corpus.inner or word in self.corpus.naming or word in self.corpus.closing or word in self.corpus.referring:
            return True
        if len(word) > 6:
            return False
        if self._inner is None:
            self._inner = {m[1].lower() for m in CONTEXT.finditer(self.text) if m[2] or m[3][0].islower()}
        return word in self._inner

    def ends_before_capital(self, word: str, following: str, following_dotted: bool) -> bool:
        """Whether ``word`` with a period ends a sentence before the capital of ``following``."""
        corpus = self.corpus
        if following_dotted and self.is_abbreviation(following.lower()) and following.lower() not in corpus.closing:
            return word not in corpus.bound and not self.is_abbreviation(word)
        if word in corpus.naming:
            return False
        if word in corpus.closing:
            return True
        if self.is_abbreviation(word):
            return following != "" and self.usual_in_lower_case(following)
        return True


def _spans(text: str) -> list[tuple[int, int]]:
    """Outermost (open, close) positions of quotations and brackets that are closed."""
    stack: list[tuple[int, str]] = []
    found = []
    for m in re.finditer(r"[“”„«»‹›「」『』（）()\[\]《》〈〉]", text):
        c = m.group()
        for depth in range(len(stack) - 1, -1, -1):
            if c in PAIRS[stack[depth][1]]:
                found.append((stack[depth][0], m.start()))
                del stack[depth:]
                break
        else:
            if c in PAIRS:
                stack.append((m.start(), c))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _past_closers(text: str, at: int, closing: set[int]) -> int:
    """The position behind closing marks at ``at``; one space may stand before a guillemet."""
    while at < len(text):
        if at in closing or text[at] in CLOSERS and text[at] != '"':
            at += 1
        elif text[at] == '"' and (at + 1 == len(text) or text[at + 1].isspace()):
            at += 1
        elif text[at] in "   " and at + 1 < len(text) and text[at + 1] in "»›" and at + 1 in closing:
            at += 2
        else:
            break
    return at


def _ends(doc: _Document, text: str, start: int, stop: int, after: int) -> bool:
    """Whether terminators ``text[start:stop]``, closing marks up to ``after``, end a sentence."""
    run = text[start:stop]
    at = after
    while at < len(text) and text[at].isspace():
        at += 1
    if at == len(text):
        return True
    spaced, closed = at > after, after > stop
    if closed and QUOTED_ON.match(text, at) and not spaced:
        return False
    opened = at
    while at < len(text) and (text[at] in OPENERS or text[at].isspace()):
        at += 1
    if at == len(text):
        return True
    c = text[at]
    bracket = text[opened] in "(["
    if STRONG & set(run):
        return not _is_lower(c)
    if _is_lower(c):
        return False
    ellipsis = "…" in run or ".." in run
    m = WORD.match(text, at)
    following = m.group() if m else ""
    if c.isalpha() and not _is_upper(c):  # a script without capitals
        if not spaced and not closed and not ellipsis:
            return start > 0 and text[start - 1].isalpha() and _script(text[start - 1]) == _script(c) and _script(c) not in ("CJK", "HIRAGANA", "KATAKANA")
        if run == ".":
            before = re.search(r"(?<![^\W\d_])([^\W\d_])$", text[:start])
            return not (before and _script(before[1]) == _script(c) and _script(c) == "ARABIC")
        return True
    if run[0] in "!?":
        if spaced or closed:
            return True
        return _is_upper(c) and len(following) > 1 and following[1:].islower()
    if ellipsis:
        if closed:
            return True
        return c.isdigit() is False and following != "" and doc.usual_in_lower_case(following)
    if not spaced and not closed:
        left = text[max(0, start - 2) : start]
        lost = len(left) == 2 and (left.isalpha() and left[1].islower() or left.isdigit()) and _is_upper(c) and len(following) > 1 and following[1:].islower()
        word = (BEFORE.search(text, max(0, start - 40), start) or ["", ""])[1].lower()
        if "." in word and word in doc.corpus.closing:  # p.m.Nobody
            return _is_upper(c) and len(following) > 1 and following[1:].islower()
        if not lost or text[start + 1 : start + 2] == "-":
            return False
        return doc.ends_before_capital(word, following, False)
    if closed:
        return not (bracket and c.isdigit())
    if not c.isalnum():
        return c not in ",;:"
    found = BEFORE.search(text, max(0, start - 40), start)
    raw = found[1] if found else ""
    word = raw.lower()
    if not word:
        return not (bracket and c.isdigit())
    earlier = PREVIOUS.search(text, max(0, found.start() - 40), found.start())
    dotted = text[at + len(following) : at + len(following) + 1] == "."
    if word[0].isdigit():
        if len(word) <= 2 and following:
            if earlier and earlier[2] and doc.is_abbreviation(earlier[1].lower()):
                return True
            return following.lower() not in doc.corpus.ordinal
        return True
    if len(raw) == 1 and raw.islower() and len(following) == 1 and dotted:
        return False  # z. B., i. R.
    if len(word) == 1 and earlier and earlier[2] and len(earlier[1]) == 1:  # p. m., z. B., i. R.
        pair = f"{earlier[1].lower()}.{word}"
        if pair in doc.corpus.closing:
            return True
        if pair in doc.corpus.inner or raw.islower():
            return following != "" and doc.usual_in_lower_case(following)
    if c.isdigit():
        return not bracket and word not in doc.corpus.referring and not (len(word) <= 6 and doc.is_abbreviation(word) and word not in doc.corpus.closing)
    if len(word) > 1 and "-" in raw and len(raw.rsplit("-", 1)[1]) == 1:  # J.-P.
        return False
    if len(raw) == 1 and raw.isupper():  # an initial, unless a sentence plainly starts
        return word not in doc.corpus.naming and len(following) > 1 and doc.usual_in_lower_case(following)
    if word in doc.corpus.referring and following.isupper() and set(following) <= set("IVXLCDM"):
        return False
    if bracket and doc.is_abbreviation(word):
        return False
    return doc.ends_before_capital(word, following, dotted)


def _flow(doc: _Document, text: str, base: int) -> Iterator[int]:
    """Ends of the units of running text."""
    spans = _spans(text)
    opens = [a for a, _ in spans]
    closing = {b for _, b in spans}
    thai = len(THAI.findall(text))
    cuts = []
    for m in TERMINATORS.finditer(text):
        start, stop = m.span()
        # a long word, a period, a space and a capital: nothing is in doubt
        plain = stop == start + 1 and text[start] == "." and text[stop : stop + 1] == " " and text[start - 7 : start].isalpha() and start >= 7 and text[stop + 1 : stop + 2].isupper()
        i = bisect_right(opens, start) - 1
        if plain and (i < 0 or start > spans[i][1]):
            cuts.append(stop)
            continue
        after = stop
        if i >= 0 and start < spans[i][1]:
            after = _past_closers(text, stop, closing)
            if after <= spans[i][1]:
                continue  # inside a quotation that goes on
        else:
            after = _past_closers(text, stop, closing)
        if _ends(doc, text, start, stop, after):
            cuts.append(after)
    if thai and 2 * thai > sum(map(str.isalpha, text)):
        for m in THAI_SPACE.finditer(text):
            a, b = m.span()
            if 0 < a and b < len(text) and not text[a - 1].isdigit() and not text[b].isdigit() and text[b] != "\n" and text[a - 1] != "\n":
                if THAI.match(text[a - 1]) or THAI.match(text[b]):
                    cuts.append(a)
        cuts.sort()
    for cut in [*cuts, len(text)]:
        yield base + cut


def _entries(block: str, last_number: int) -> tuple[list[int], int]:
    """Starts of the list entries in a block, and the last entry's number (0 if there is none)."""
    starts, lines, at = [], [], 0
    for line in block.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    bullets = sum(bool(BULLET.match(line)) for _, line in lines)
    numbers = {int(m[1]) for _, line in lines if (m := NUMBER.match(line))}
    letters = {m[1] for _, line in lines if (m := LETTER.match(line))}
    number = last_number
    for i, (at, line) in enumerate(lines):
        before = lines[i - 1][1].rstrip() if i else ""
        if BULLET.match(line):
            if i == 0 or bullets > 1 or before[-1:] in ".:;!?":
                starts.append(at)
        elif m := NUMBER.match(line):
            n = int(m[1])
            if n == number + 1 or n == 1 and (i == 0 or before[-1:] in ".:;!?" or 2 in numbers) or i == 0 and n + 1 in numbers:
                starts.append(at)
                number = n
        elif m := LETTER.match(line):
            if i == 0 or m[1] == "a" and "b" in letters or chr(ord(m[1]) - 1) in letters:
                starts.append(at)
    return starts, number if starts else 0


def _visible(text: str) -> bool:
    return any(not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc") for c in text)


def ends(text: str | None, corpus: Corpus | None = None) -> list[int]:
    """The end of each unit of ``text``: characters up to and including its last non-blank one."""
    if not text or not _visible(text):
        return []
    doc = _Document(text, corpus or Corpus())
    cuts: list[int] = []
    at, number = 0, 0
    for m in [*BLANK_LINES.finditer(text), None]:
        stop = m.start() if m else len(text)
        block = text[at:stop]
        if block.strip():
            entries, number = _entries(block, number)
            head = entries[0] if entries else len(block)
            if block[:head].strip():
                cuts += _flow(doc, block[:head], at)
            cuts += [at + b for b in [*entries[1:], len(block)]] if entries else []
        at = m.end() if m else stop
    units, begin = [], 0
    for cut in cuts:
        end = cut
        while end > begin and text[end - 1].isspace():
            end -= 1
        if end > begin and _visible(text[begin:end]):
            units.append(end)
        begin = max(begin, cut)
    return units


def corpus_tables(docs: DataFrame, text: str = "text", share: float = SHARE) -> Corpus:
    """What all documents show, each word of the tables holding ``share`` of all words at least."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words: Counter = Counter()
            seen: Counter = Counter()
            for t in batch["tw_text"]:
                found = WORD.findall(t)
                words.update(found)
                lower = None
                for m in CONTEXT.finditer(t):
                    word, next_ = m[1].lower(), m[3]
                    if m[2] or next_[0].islower():
                        seen["inside", word, ""] += 1
                    elif next_[0].isdigit():
                        seen["number", word, ""] += 1
                    elif next_[0].isupper():
                        lower = lower if lower is not None else set(found)
                        next_ = next_.lower()
                        seen["common" if next_ in lower else "name", word, "" if next_ in lower else next_] += 1
                for m in ORDINAL.finditer(t):
                    seen["ordinal", m[1].lower(), ""] += 1
            rows = [(kind, word, next_, n) for (kind, word, next_), n in seen.items()]
            rows += [("lower" if w[0].islower() else "other", w.lower(), "", n) for w, n in words.items() if len(w) <= 20]
            rows.append(("total", "", "", words.total()))
            yield pd.DataFrame(rows, columns=["kind", "word", "next", "n"])

    rows = docs.select(F.col(text).alias("tw_text")).where(F.length("tw_text") > 0)
    counted = rows.mapInPandas(count, "kind string, word string, next string, n bigint")
    sums = counted.groupBy("kind", "word", "next").agg(F.sum("n").alias("n"))
    kinds = ("inside", "number", "common", "name", "ordinal", "lower", "other", "total")
    by_word = sums.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds], F.count_if(F.col("kind") == "name").alias("names"))
    by_word = materialize(by_word, "sentence-words")
    total = by_word.agg(F.sum("total")).first()[0] or 0
    least = max(3, share * total)
    # every word kept holds ``share`` of all words, so there are at most 1 / share of each kind
    common = by_word.where(F.col("lower") >= least).select("word").collect()
    dotted = by_word.withColumn("n", F.col("inside") + F.col("number") + F.col("common") + F.col("name")).where(F.col("n") >= least)
    capitals, alone = F.col("common") + F.col("name"), F.col("lower") + F.col("other")
    abbreviated = dotted.where((F.col("inside") + F.col("number") >= 0.2 * F.col("n")) & (F.col("n") >= 0.2 * alone))
    naming = dotted.where((F.col("common") <= 0.03 * capitals) & (F.col("names") >= 5) & ~F.col("word").contains(".") & (capitals >= 0.1 * F.col("n")) & (F.col("n") >= 0.2 * alone))
    inner = abbreviated.where((F.col("inside") > 0) & (capitals < 0.1 * F.col("n")))
    closing = abbreviated.where((F.col("inside") > 0.1 * F.col("n")) & (capitals >= 0.1 * F.col("n")))
    referring = abbreviated.where((F.col("number") >= 3) & (F.col("number") >= 0.15 * F.col("n")) & (F.col("inside") + F.col("number") >= 0.5 * F.col("n")))
    bound = dotted.where((F.col("common") == 0) & (F.col("names") == 1) & (F.col("name") >= 0.9 * F.col("n")) & (F.col("n") >= 0.9 * alone))
    ordinal = by_word.where((F.col("ordinal") >= least) & (F.col("ordinal") >= 0.2 * F.col("other")))
    sets = [frozenset(r["word"] for r in t.select("word").collect()) for t in (inner, closing, naming, referring, ordinal, bound)]
    names = sets[2]
    return Corpus(frozenset(r["word"] for r in common), sets[0], sets[1] - names, names, *sets[3:])


def sentence_ends(docs: DataFrame, key: str = "doc_id", text: str = "text", corpus: Corpus | None = None) -> DataFrame:
    """(key, end_char) of each sentence unit."""
    corpus = corpus or corpus_tables(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(corpus))
    rows = docs.select(F.col(key), F.col(text).alias("tw_text")).where(F.length("tw_text") > 0)
    kind = rows.schema[key].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Corpus(*shared.value)
        for batch in batches:
            keys, found = [], []
            for k, t in zip(batch[key], batch["tw_text"]):
                e = ends(t, known)
                keys += [k] * len(e)
                found += e
            yield pd.DataFrame({key: keys, "end_char": found})

    return rows.mapInPandas(split, f"`{key}` {kind}, end_char int")
