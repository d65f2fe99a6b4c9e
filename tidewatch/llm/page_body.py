"""Problem 3: the main body of whole pages, without what the site puts around and into it.

Method (host suffix array): the token streams of a host's pages are laid end to
end, with a sentinel wherever a line or a menu separator parts them.  Prefix
doubling sorts all suffixes; two overlapping ranks of one level name any
substring exactly.  Substrings between sentinels that recur on distinct pages
of the host are boilerplate where they hold a fixed share of the host's pages
(or of all pages, for hosts with few).  Lines covered by them are removed.
Of the unique runs left, those from the article's title on are its body.  The
title is the line that agrees with the page's address (or stated title); runs
under a heading for other articles, with a headline, at most one sentence and
a date each, are teasers.

Scale.  A host is split into shards of about ``SHARD_PAGES`` pages by hash of
the address, so a host with a third of all pages is many groups of bounded
size; shards report substrings and page counts, which are summed per host.
None is left out before the sum.
Every substring kept holds ``HOST_SHARE`` of a host's pages, so a host has at
most ``segments per page / HOST_SHARE`` of them.  The second pass is a map over
pages with these tables, broadcast below ``BROADCAST_ROWS`` rows and joined to
the shards beyond.

Defined cases.  Null, empty and blank texts give no row.  Captures of one
address are one page when pages are counted; each capture comes out.  Rows
without a host are taken by institution-less host ''.  A page with an address
or title none of its lines agrees with has no body.  Without address and title
all unique runs outside teasers are body.  Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import broadcast_if_small, materialize

#: Boilerplate phrases up to which they are broadcast.
BROADCAST_ROWS = 500_000

SHARD_PAGES = 1000
HOST_SHARE = 0.012
FEW_PAGES = 100
ALL_SHARE = 0.004
TAG_SHARE = 0.03

# Headings under which sites name other articles, in English,
# German, French and Spanish; letters only.
TEASER_HEADINGS = frozenset(
    "inthisseries upcomingevents relatedcontent mostread youmayalsolike latestfromourexperts relatedarticles readnext keepreading trending popular "
    "meistgelesen verwandtebeiträge neuestebeiträge ähnlichebeiträge mehrzumthema "
    "lespluslus lesplusconsultés articlesliés àlireaussi dernierspublications dernièrespublications derniersarticles surlemêmethème contenusliés "
    "lomásleído últimasentradas artículosrelacionados contenidorelacionado contenidosrelacionados tambiénlepuedeinteresar lemáspuedeinteresar másleídos".split()
)

# Links with which such a block ends; letters only.
TEASER_CLOSINGS = frozenset(
    "readmore continuereading viewall seeall showall registernow more seemore allposts weiterlesen alleansehen mehr mehrlesen jetztanmelden "
    "lirelasuite voirtout plus toutvoir sinscrireàlévénement leermás vertodo más inscribirse".split()
)
#: A word belongs to the forms of headlines with this share of the titles; a form with the second share of them is one.
WORD_SHARE = 0.06
FORM_SHARE = 0.008
HEAD_TOKENS = re.compile(r"[^\W\d_]+|\d+")
#: Lines beyond this many characters are taken apart only if boilerplate begins like them.
LONG_LINE = 160
FORM_TOKENS = re.compile(r"[^\W\d_]+|\d+|[:?&—]")

PIECES = re.compile(r"[^\W\d_]+|\d+|\n|[•|·»«›‹>/\t—–]|[ \xa0]{2,}|,")
STRONG = frozenset("•|·»«›‹>/\t—–\n")
LIST_MARK = re.compile(r"^\s*(?:[-–—•*·▪]|\d{1,3}[.)])\s")
SENTENCES = re.compile(r"[.!?。！？](?:[\"”’»)]*)\s+\S")


def segments(text: str) -> list[list[tuple[bool, list[str]]]]:
    """For each line its segments: (whether a comma parts it from the one before, tokens).  Digits count as one token '0'."""
    lines: list[list[tuple[bool, list[str]]]] = []
    line: list[tuple[bool, list[str]]] = []
    tokens: list[str] = []
    comma = False
    for piece in PIECES.findall(text.lower()):
        if piece[0].isdigit():
            tokens.append("0")
        elif piece == "\n":
            if tokens:
                line.append((comma, tokens))
            lines.append(line)
            line, tokens, comma = [], [], False
        elif piece[0] in STRONG or piece[0] in " \xa0":
            if tokens:
                line.append((comma, tokens))
                tokens = []
            comma = False
        elif piece == ",":
            if tokens:
                line.append((comma, tokens))
                tokens = []
            comma = True
        else:
            tokens.append(piece)
    if tokens:
        line.append((comma, tokens))
    lines.append(line)
    return lines


def _strong_segments(line: list[tuple[bool, list[str]]]) -> list[list[str]]:
    """Segments between strong separators: pieces parted by commas are put together."""
    found: list[list[str]] = []
    for comma, tokens in line:
        if comma and found:
            found[-1] = found[-1] + tokens
        else:
            found.append(tokens)
    return found


def _name(tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(tokens)) - (1 << 63)


DEPTH = 16


class SuffixNames:
    """Names of all suffixes by their first 1, 2, 4, 8, 16 tokens: the levels of a suffix array.

    Each level names pairs of the level below (prefix doubling).  Only equality
    of substrings is asked for, so levels are named by hashing, not by sorting.
    """

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.levels = [tokens.astype(np.int64)]
        step = 1
        while step < DEPTH:
            shifted = np.zeros(n, np.int64)
            shifted[: n - step] = self.levels[-1][step:] + 1
            names, _ = pd.factorize(self.levels[-1] * (int(shifted.max()) + 1) + shifted)
            self.levels.append(names.astype(np.int64))
            step *= 2

    def names(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A number for each substring, equal for equal substrings only."""
        level = np.minimum(np.floor(np.log2(length)).astype(np.int64), len(self.levels) - 1)
        width = np.left_shift(1, level)
        tops = np.stack([ranks for ranks in self.levels])
        found = level * (int(length.max()) + 1) + length
        most = int(tops.max()) + 2
        for offset in range(0, int(length.max()), DEPTH):  # blocks side by side, the last one flush with the end
            at = np.where(offset + width <= length, start + offset, start + length - width)
            part = np.where(offset < length, tops[level, np.minimum(at, tops.shape[1] - 1)] + 1, 0)
            found, _ = pd.factorize(found * most + part)
        last, _ = pd.factorize(found * most + tops[level, start + length - width])
        return last


def repeated(texts: list[str], pages: np.ndarray, least: int) -> pd.DataFrame:
    """(weak, phrase, head, pages): substrings between sentinels on at least ``least`` distinct pages.

    ``weak`` marks those parted by commas only; ``head`` names the first two tokens.
    """
    words: list[str] = ["\n", "|", ","]
    number = {"\n": 0, ",": 2, **{c: 1 for c in STRONG if c != "\n"}}

    def grow(piece: str) -> int:
        if piece in number:
            return number[piece]
        if piece[0].isdigit():
            return number.setdefault(piece, known("0"))
        if piece[0] in " \xa0":
            return number.setdefault(piece, 1)
        return known(piece)

    def known(piece: str) -> int:
        if piece not in number:
            number[piece] = len(words)
            words.append(piece)
        return number[piece]

    get = number.get
    parts, sizes = [], []
    for text in texts:
        found = PIECES.findall(text.lower())
        codes = list(map(get, found))
        if None in codes:
            codes = [grow(p) if c is None else c for c, p in zip(codes, found)]
        parts.append(np.array([*codes, 0], np.int64))
        sizes.append(len(codes) + 1)
    stream, page = np.concatenate(parts), np.repeat(pages, sizes)
    comma = stream == 2
    follows = np.zeros(len(stream), bool)
    follows[1:] = comma[:-1]
    stream, page, follows = stream[~comma], page[~comma], follows[~comma]
    wall = stream <= 1
    before = np.ones(len(wall), bool)
    before[1:] = wall[:-1]
    starts = np.flatnonzero(~wall & before)
    if not len(starts):
        return pd.DataFrame({"weak": [], "phrase": [], "head": [], "pages": []})
    walls = np.flatnonzero(wall)
    ends = walls[np.searchsorted(walls, starts)]
    cuts = np.flatnonzero(~wall & ~before & follows)  # behind a comma, inside a segment
    split = np.unique(np.searchsorted(starts, cuts, side="right") - 1)
    weak_starts = np.sort(np.concatenate([starts[split], cuts]))
    bounds = np.sort(np.concatenate([ends[split], cuts]))
    weak_ends = bounds[np.searchsorted(bounds, weak_starts, side="right")] if len(weak_starts) else weak_starts
    start = np.concatenate([starts, weak_starts])
    length = np.concatenate([ends, weak_ends]) - start
    weak = np.arange(len(start)) >= len(starts)
    names = SuffixNames(stream).names(start, length) * 2 + weak
    span = int(page.max()) + 1
    pairs = pd.unique(names * span + page[start])  # one page counts once
    counts = np.bincount(pairs // span)
    chosen = np.flatnonzero(counts >= max(1, least))
    first = np.full(len(counts), -1, np.int64)
    first[names[::-1]] = np.arange(len(names))[::-1]
    spots = first[chosen]
    tokens = [[words[t] for t in stream[start[i] : start[i] + length[i]]] for i in spots]
    return pd.DataFrame({"weak": weak[spots], "phrase": [_name(t) for t in tokens], "head": [_name(t[:2]) for t in tokens], "pages": counts[chosen]})


def host(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^www\.", ""), r"[.:].{0,0}$|:\d+$", ""), F.lit(""))


def _pages(captures: DataFrame, key: str, source_host: str, url: str, title: str | None, text: str) -> DataFrame:
    rows = captures.select(
        F.col(key).alias("tw_key"),
        host(F.col(source_host)).alias("host"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        (F.coalesce(F.col(title), F.lit("")) if title else F.lit("")).alias("title"),
        F.col(text).alias("text"),
    ).where(F.length("text") > 0)
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("captures"))
    shards = broadcast_if_small(materialize(sizes, "hosts"))
    shard = F.pmod(F.xxhash64("url"), F.ceil(F.col("captures") / SHARD_PAGES).cast("int"))
    return rows.join(shards, "host").withColumn("shard", shard)


def boilerplate(pages: DataFrame) -> DataFrame:
    """(host, weak, phrase, head) of the boilerplate of each host; host null for what holds on all hosts."""

    def report(group: pd.DataFrame) -> pd.DataFrame:
        page, _ = pd.factorize(group["url"])
        found = repeated(list(group["text"]), page, 1)  # what is rare here may reach a share with other shards and hosts
        found.insert(0, "host", group["host"].iloc[0])
        return found

    totals = pages.groupBy("host").agg(F.countDistinct("url").alias("total"))
    seen = pages.groupBy("host", "shard").applyInPandas(report, "host string, weak boolean, phrase bigint, head bigint, pages bigint")
    seen = materialize(seen.groupBy("host", "weak", "phrase", "head").agg(F.sum("pages").alias("pages")), "phrases")
    least = F.when(F.col("total") < FEW_PAGES, F.lit(2)).otherwise(F.greatest(F.lit(3), HOST_SHARE * F.col("total")))
    own = seen.join(totals, "host").where(F.col("pages") >= least).select("host", "weak", "phrase", "head")
    total = totals.agg(F.sum("total")).first()[0] or 0
    everywhere = seen.groupBy("weak", "phrase", "head").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("hosts"))
    share = F.when(F.col("weak"), F.lit(TAG_SHARE)).otherwise(F.lit(ALL_SHARE)) * F.lit(total)
    common = everywhere.where((F.col("pages") >= F.greatest(F.lit(5), share)) & (F.col("hosts") >= 3))
    return own.unionByName(common.select(F.lit(None).cast("string").alias("host"), "weak", "phrase", "head"))


def headline_forms(pages: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words and forms of the corpus's headlines, from the stated titles.

    By their shares there are at most ``words per title / WORD_SHARE`` words and
    ``1 / FORM_SHARE`` forms, whatever the number of titles.
    """
    titles = pages.where("title <> ''").select("title").distinct()
    tokens = materialize(titles.select(F.regexp_extract_all(F.regexp_replace(F.lower("title"), r"\d+", "0"), F.lit(r"(\p{L}+|0|[:?&—])"), 1).alias("tokens")), "titles")
    n = tokens.count()
    if not n:
        return frozenset(), frozenset()
    counts = tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").count()
    words = frozenset(r["token"] for r in counts.where(F.col("count") >= WORD_SHARE * n).collect())
    known = F.array(*[F.lit(w) for w in sorted(words)]) if words else F.array().cast("array<string>")
    form = F.array_join(F.transform("tokens", lambda t: F.when(F.array_contains(known, t), t).otherwise(F.lit("*"))), " ")
    forms = tokens.select(F.regexp_replace(form, r"\*( \*)+", "*").alias("form")).groupBy("form").count()
    kept = forms.where(F.col("count") >= FORM_SHARE * n).collect()
    return words, frozenset(r["form"] for r in kept if r["form"] != "*")


def _form(text: str, words: frozenset[str]) -> str:
    out: list[str] = []
    for token in FORM_TOKENS.findall(text.lower()):
        token = "0" if token[0].isdigit() else token if token in words else "*"
        if token != "*" or out[-1:] != ["*"]:
            out.append(token)
    return " ".join(out)


def _letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isascii() and c.isalnum())


def _plainly(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalpha())


class Known:
    """Names of a host's boilerplate, and the corpus's headline forms."""

    def __init__(self, own: tuple[set[int], set[int], set[int]], everywhere: tuple[set[int], set[int], set[int]], headlines: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())):
        self.sets = (own[0], everywhere[0]), (own[1], everywhere[1])
        self.heads = own[2], everywhere[2]
        self.words, self.forms = headlines

    def may_begin(self, line: str) -> bool:
        """Whether boilerplate begins with the first word or two of a long line, or the line has no words."""
        first = ["0" if t[0].isdigit() else t for t in itertools.islice((m.group() for m in HEAD_TOKENS.finditer(line.lower())), 2)]
        return not first or any(_name(head) in s for s in self.heads for head in (first[:1], first))

    def headline(self, line: str) -> bool | None:
        """Whether a line has the form of a headline; null if no forms are known."""
        return _form(line, self.words) in self.forms if self.forms else None

    def strong(self, tokens: list[str]) -> bool:
        name = _name(tokens)
        return any(name in s for s in self.sets[0])

    def weak(self, tokens: list[str]) -> bool:
        name = _name(tokens)
        return any(name in s for s in self.sets[1])

    def tiled(self, tokens: list[str]) -> bool:
        """Whether boilerplate laid end to end gives these tokens."""
        if self.strong(tokens):
            return True
        if len(tokens) > 14:
            return False
        reach = [True] + [False] * len(tokens)
        for b in range(1, len(tokens) + 1):
            for a in range(max(0, b - 6), b):
                if reach[a] and (a, b) != (0, len(tokens)) and self.strong(tokens[a:b]):
                    reach[b] = True
                    break
        return reach[-1]


def body_lines(text: str, url: str, title: str, known: Known) -> list[int]:
    """Numbers (from 1) of the lines of the main body."""
    lines = text.split("\n")
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*", "", url).rstrip("/")
    slug = _letters(path.rsplit("/", 1)[-1].rsplit("-", 1)[0])
    named = _letters(title)
    want = [w for w in (slug, named) if len(w) > 3 and not w.isdigit()]  # a number names no article
    at = -1
    for w in want:
        at = next((i for i, line in enumerate(lines) if (x := _letters(line)) and (x.startswith(w) and len(x) < len(w) + 120 or len(x) > 20 and w.startswith(x) and w is named)), -1)
        if at >= 0:
            break
    if want and at < 0:
        return []

    def furniture(i: int) -> bool:
        if len(lines[i]) > LONG_LINE and not known.may_begin(lines[i]):
            return False
        line = segments(lines[i])[0]
        if not line:
            return True
        if not any(c.isalpha() for c in lines[i]):
            return not LIST_MARK.match(lines[i]) and not re.search(r"\d", lines[i])
        strong = _strong_segments(line)
        if all(known.tiled(s) for s in strong):
            return True
        if not re.search(r"[.!?;:]\s*$", lines[i]) and all(known.weak(t) for _, t in line) and (len(line) > 1 or len(line[0][1]) <= 3):
            return True
        # a breadcrumb: the page's title behind boilerplate
        return len(strong) > 1 and known.tiled(strong[0]) and any(_letters("".join(s)).startswith((slug or named)[:20]) for s in strong[1:] if len(slug or named) > 3)

    found = [at + 1] if at >= 0 else []
    following = [i for i in range(at + 1, len(lines)) if lines[i].strip()]
    plain = [_plainly(lines[i]) for i in following]
    plays = [furniture(i) for i in following]
    dated = [f and bool(re.search(r"\d", lines[i])) and len(lines[i].strip()) < 40 for f, i in zip(plays, following)]
    n = 0
    while n < len(following):
        if plain[n] in TEASER_HEADINGS:
            n = _past_teasers(n + 1, [lines[i] for i in following], plain, plays, dated, known)
            continue
        if not plays[n]:
            found.append(following[n] + 1)
        n += 1
    return found


CUT = re.compile(r"(?:…|\.\.\.)\W*$")
FULL_STOP = re.compile(r"[.。]\W*$")


def _past_teasers(n: int, lines: list[str], plain: list[str], plays: list[bool], dated: list[bool], known: Known) -> int:
    """The first line behind the block of teasers that begins at ``n``."""
    for end in range(n, len(lines)):  # a closing link settles it
        if plain[end] in TEASER_CLOSINGS:
            return end + 1
        if plays[end] and not dated[end] or plain[end] in TEASER_HEADINGS:
            break
    after = "heading"
    while n < len(lines):
        line = lines[n].strip()
        if dated[n]:
            if after == "heading":
                return n
            after = "date"
        elif plays[n]:
            return n
        elif CUT.search(line):
            after = "sentence"
        elif FULL_STOP.search(line):
            several = bool(SENTENCES.search(line))
            ahead = n + 1 < len(lines) and (dated[n + 1] or not plays[n + 1] and bool(known.headline(lines[n + 1])))
            if after != "headline" or several or LIST_MARK.match(lines[n]) or len(line) > 130 and not ahead:
                return n
            after = "sentence"
        else:
            form = known.headline(line)
            if form is False or LIST_MARK.match(lines[n]) or form is None and (len(line) > 130 or after == "headline"):
                return n
            after = "headline"
        n += 1
    return n


def find(
    captures: DataFrame,
    key: str = "capture_id",
    source_host: str = "source_host",
    url: str = "url",
    title: str | None = "extracted_title",
    text: str = "extracted_text",
) -> DataFrame:
    """(key, line_no) of each non-blank line of the main body, lines numbered from 1."""
    pages = _pages(captures, key, source_host, url, title, text)
    table = materialize(boilerplate(pages), "boilerplate")
    kind = pages.schema["tw_key"].dataType.simpleString()
    schema = f"`{key}` {kind}, line_no int"

    def lines_of(batch: pd.DataFrame, known: dict[str, Known]) -> pd.DataFrame:
        keys, numbers = [], []
        for k, h, u, t, x in zip(batch["tw_key"], batch["host"], batch["url"], batch["title"], batch["text"]):
            found = body_lines(x, u, t, known[h])
            keys += [k] * len(found)
            numbers += found
        return pd.DataFrame({key: keys, "line_no": numbers})

    def sets_of(rows) -> tuple[set[int], set[int], set[int]]:
        strong, weak, heads = set(), set(), set()
        for r in rows:
            (weak if r["weak"] else strong).add(r["phrase"])
            heads.add(r["head"])
        return strong, weak, heads

    everywhere = sets_of(table.where("host IS NULL").select("weak", "phrase", "head").collect())  # at most segments per page / ALL_SHARE
    own = table.where("host IS NOT NULL")
    headlines = headline_forms(pages)
    narrow = pages.select("tw_key", "host", "url", "title", "text")
    if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows: dict[str, list] = {}
        for r in own.toLocalIterator():
            rows.setdefault(r["host"], []).append(r)
        shared = captures.sparkSession.sparkContext.broadcast(({h: sets_of(rs) for h, rs in rows.items()}, everywhere, headlines))

        def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sets, everywhere, headlines = shared.value
            for batch in batches:
                known = {h: Known(sets.get(h, (set(), set(), set())), everywhere, headlines) for h in set(batch["host"])}
                yield lines_of(batch, known)

        return narrow.mapInPandas(mapped, schema)

    shards = pages.select("host", "shard").distinct()
    dealt = materialize(own.join(shards, "host"), "dealt").select(F.col("host").alias("h"), F.col("shard").alias("s"), "weak", "phrase", "head")

    def joined(group: pd.DataFrame, phrases: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({key: [], "line_no": []})
        known = Known(sets_of(phrases.to_dict("records")), everywhere, headlines)
        return lines_of(group, {group["host"].iloc[0]: known})

    sharded = pages.select("tw_key", "host", "shard", "url", "title", "text")
    return sharded.groupBy("host", "shard").cogroup(dealt.groupBy("h", "s")).applyInPandas(joined, schema)
