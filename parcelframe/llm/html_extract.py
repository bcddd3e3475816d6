"""Main text of web pages: page structure, and a suffix array over each host's token streams.

A page is read into blocks (text between block-level tags), each in a zone:
*main* (inside ``article`` or ``main``), *chrome* (inside menus, footers,
asides, forms, scripts, adverts, notices, comments and the like, by element,
role or class) or *open*. A class or id names chrome if one of its tokens is
made of chrome words alone, or of those and words for a box (``share-box``, not
``has-sidebar``); it says nothing of ``html``, ``body``, ``main``, ``article``
or what holds a ``main``, nor of what holds an ``article`` where the page would
have no text otherwise. A page that marks its article is that: repetition on
other pages says nothing against it, as articles quote and copy each other.
Open text may be boilerplate that nothing marks, and there the host decides:

* the token streams of a host's pages (all but main text) are concatenated,
  with a mark of its own after each page;
* prefix doubling sorts the suffixes by their first ``LONG`` tokens; suffixes
  that agree on those and come from distinct pages are a repeated long
  substring, and their tokens are covered;
* covered tokens are removed from open text (blocks covered whole, and runs of
  ``LONG`` tokens or more inside a block), unique runs stay.

Skew: a host of more than ``SHARD`` tokens is dealt by page into shards of
about that size, each with a suffix array of its own, so a host that holds a
third of all pages is many bounded groups. Runs that only pages of different
shards share are found by key: a shard gives its distinct windows of ``LONG``
tokens (host, 64-bit hash) with the smallest and largest digest of the streams
that hold them; where those differ over all shards, the window goes back to the
shards in which one stream alone holds it. So the size of a host decides
nothing. Main text is never shuffled.

Defined results: null or empty html gives empty text; a page of any length or
brokenness is read in time proportional to its length; an empty table gives an
empty result; ties can't arise, as a passage is repeated or isn't; pages with equal
streams count as one page, so repeated rows don't erase each other; a null url is a
host of its own name; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .url_filter import split_url

LONG, SHARD = 8, 1 << 20  # LONG: a power of two

_WEIGHTS = np.random.default_rng(53).integers(1, 1 << 62, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: NAMED: chrome by a class or id only; it leaves the parser as CHROME.
MAIN, OPEN, CHROME, NAMED = 0, 1, 2, 3
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes".split())  # no markup inside
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td
tfoot th thead title tr ul""".split())
MAIN_TAGS = frozenset(("article", "main"))
CHROME_TAGS = frozenset("head nav footer aside form button select menu dialog fieldset svg canvas object audio video datalist".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that name something other than the article.
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent
gdpr notice notices menu nav navbar navigation breadcrumb breadcrumbs sidebar share sharing social comment comments reply replies
respond footer newsletter subscribe subscription signup login popup modal overlay related recommended widget masthead toolbar pager
pagination skip disqus""".split())
#: Words beside those in a hyphenated class that still name the same box.
BOX_WORDS = frozenset("""area bar block body bottom box btn button buttons col column container desktop element float footer global group header icon icons
inner item items left link links list main mobile module outer page panel pane posts primary right row secondary section site slot text
title top unit wrap wrapper""".split())
#: Elements that a class or id never turns into chrome.
UNNAMED = frozenset(("html", "body", "main", "article"))
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",)}
_HOLDS = frozenset("article main body html div section ul ol dl table nav aside footer header form blockquote".split())


def _names_chrome(names: str) -> bool:
    """Whether a token of a class or id names chrome."""
    for token in names.lower().split():
        words = [w for w in re.split(r"[^a-z0-9]+", token) if w and not w.isdigit()]
        if any(w in CHROME_WORDS for w in words) and all(w in CHROME_WORDS or w in BOX_WORDS for w in words):
            return True
    return False


def _zone(tag: str, attributes: str, around: int, rescue: bool) -> int:
    if around == CHROME or tag in CHROME_TAGS:
        return CHROME
    zone = MAIN if tag == "main" or tag == "article" and (around != NAMED or rescue) else around
    if "=" in attributes or "hidden" in attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        role = found.get("role", "").lower()
        if role in CHROME_ROLES or found.get("aria-hidden", "").lower() == "true" or re.search(r"\shidden(?=[\s/]|$)", " " + attributes):
            return CHROME
        if role == "main":
            zone = MAIN
        elif tag not in UNNAMED and _names_chrome(found.get("class", "") + " " + found.get("id", "")):
            return NAMED
    if tag == "header" and zone != MAIN:
        return CHROME
    return zone


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks that aren't empty, in page order."""
    found = _blocks(page, False)
    if found and all(z >= CHROME for z, _ in found) and any(z == NAMED for z, _ in found):
        found = _blocks(page, True)  # an article in elements that only a class or id makes chrome is the page's text after all
    return [(min(z, CHROME), t) for z, t in found]


class _Markup:
    """The tags and comments of a page, in time proportional to its length however it's broken.

    A tag ends at the first ``>`` outside quotes; without one, its ``<`` is text. What
    a search from a place outside quotes comes to depends on that place alone, so
    it's remembered by the quote that the search meets first."""

    def __init__(self, page: str):
        self.page, self.special, self.after, self.ends = page, -1, -1, {}

    def _next_special(self, at: int) -> int:
        """The first ``>`` or quote from ``at`` on (or the page's length); ``at`` never falls between calls."""
        if self.special < at:
            m = SPECIAL.search(self.page, at)
            self.special = m.start() if m else len(self.page)
        return self.special

    def _close(self, at: int) -> int:
        """The first ``>`` from ``at`` on, or -1; ``at`` never falls between calls."""
        if -1 < self.after < at or self.after == -1:
            self.after = self.page.find(">", at)
            if self.after < 0:
                self.after = -2
        return self.after

    def tag_end(self, at: int) -> int:
        """The ``>`` that ends a tag whose attributes begin at ``at``; -1 if there is none."""
        page, path = self.page, []
        spot = self._next_special(at)
        while spot not in self.ends:
            if spot == len(page) or page[spot] == ">":
                self.ends[spot] = spot if spot < len(page) else -1
                break
            path.append(spot)
            quote = page.find(page[spot], spot + 1)
            if quote < 0:
                self.ends[spot] = -1
                break
            m = SPECIAL.search(page, quote + 1)
            spot = m.start() if m else len(page)
        end = self.ends[spot]
        self.ends.update(dict.fromkeys(path, end))
        return end

    def pieces(self, at: int) -> tuple[int, int, re.Match | None, int]:
        """(where the next markup begins, where it ends, its tag if it is one, where the tag's attributes end) from ``at`` on."""
        page = self.page
        while (spot := page.find("<", at)) >= 0:
            if page.startswith("<!--", spot):
                end = page.find("-->", spot + 4)
                return spot, end + 3 if end >= 0 else len(page), None, 0
            if page[spot + 1:spot + 2] in ("!", "?"):
                if (end := self._close(spot + 2)) >= 0:
                    return spot, end + 1, None, 0
            elif m := TAG.match(page, spot):
                if (end := self.tag_end(m.end())) >= 0:
                    return spot, end + 1, m, end
            at = spot + 1
        return len(page), len(page), None, 0


class _Open:
    """The open elements, each with its zone; the last one of a tag is found at once."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.holds: list[int] = []

    def push(self, tag: str, zone: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _HOLDS:
            self.holds.append(len(self.stack))
        self.stack.append((tag, zone))

    def last(self, tag: str) -> int | None:
        """The place of the last open ``tag``, unless an element that holds others stands in between (for tags that don't)."""
        own = self.places.get(tag)
        if not own or (tag not in _HOLDS and self.holds and self.holds[-1] > own[-1]):
            return None
        return own[-1]

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in _HOLDS:
                self.holds.pop()

    @property
    def zone(self) -> int:
        return self.stack[-1][1] if self.stack else OPEN


def _blocks(page: str | None, rescue: bool) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    if not page:
        return out
    markup, open_ = _Markup(page), _Open()
    zone, text, at = OPEN, [], 0

    def close() -> None:
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                out.append((zone, whole))

    while at < len(page):
        begin, end, m, attributes_end = markup.pieces(at)
        if begin > at:
            text.append(entities.unescape(page[at:begin]))
        at = end
        if m is None:
            continue
        tag, attributes = m[2].lower(), page[m.end():attributes_end]
        if tag == "br":
            text.append(" ")
        elif m[1]:
            if tag in BLOCKS:
                close()
            k = open_.last(tag)
            if k is not None:
                if open_.stack[k][1] != zone or (k and open_.stack[k - 1][1] != zone):
                    close()
                open_.cut(k)
            zone = open_.zone
        elif tag in RAW:
            raw_end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", raw_end.start()) + 1 if raw_end else len(page)
            if not at:
                at = len(page)
        elif tag in VOID:
            if tag in BLOCKS:
                close()
        else:
            if tag in BLOCKS:
                close()
            for other in _CLOSES.get(tag, ()):
                k = open_.last(other)
                if k is not None:
                    open_.cut(k)
            new = _zone(tag, attributes, open_.zone, rescue)
            if new != zone:
                close()
            if not attributes.endswith("/") or tag in BLOCKS:
                open_.push(tag, new)
                zone = new
    close()
    return out


def repeated(streams: list[np.ndarray]) -> list[np.ndarray]:
    """Which tokens of each stream lie in a run of ``LONG`` tokens that another stream holds too.

    A suffix array of the concatenated streams, sorted to depth LONG by prefix doubling:
    equal ranks are equal substrings."""
    if not streams:
        return []
    size = np.array([len(s) for s in streams])
    total = int(size.sum()) + len(streams)
    page = np.repeat(np.arange(len(streams)), size + 1)
    ids = np.concatenate([np.append(s, 0) for s in streams])
    _, rank = np.unique(ids, return_inverse=True)
    ends = np.cumsum(size + 1) - 1
    rank = rank + len(streams)
    rank[ends] = np.arange(len(streams))  # a mark of its own ends each page
    k = 1
    while k < LONG:
        ahead = np.zeros(total, np.int64)
        ahead[:-k] = rank[k:] + 1
        _, rank = np.unique(rank * (total + len(streams) + 2) + ahead, return_inverse=True)
        k *= 2
    array = np.argsort(rank, kind="stable")  # suffixes in order
    first = np.flatnonzero(np.concatenate([[True], rank[array][1:] != rank[array][:-1]]))
    several = np.maximum.reduceat(page[array], first) != np.minimum.reduceat(page[array], first)
    starts = array[np.repeat(several, np.diff(np.append(first, total)))]
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + LONG, total), -1)
    covered = np.cumsum(change[:-1]) > 0
    return [covered[e - n:e] for e, n in zip(ends, size)]


def _distinct(texts: list[list[str]]) -> tuple[list[np.ndarray], list[int], dict[str, int]]:
    """(streams of token numbers, of equal pages once; which one each page has; number of each token)."""
    known: dict[str, int] = {}
    streams, number, first = [], {}, []
    for page in texts:
        ids = np.array([known.setdefault(w, len(known) + 1) for t in page for w in t.split(" ")], np.int64)
        key = ids.tobytes()
        if key not in number:
            number[key] = len(streams)
            streams.append(ids)
        first.append(number[key])
    return streams, first, known


def _hashes(known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each numbered token, the same in all shards."""
    whole = b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in known)
    return np.concatenate([np.zeros(1, np.uint64), np.frombuffer(whole, "<u8")])


def windows(tokens: np.ndarray) -> np.ndarray:
    """A hash of each window of LONG tokens, from the tokens' hashes."""
    n = max(0, len(tokens) - LONG + 1)
    out = np.zeros(n, np.uint64)
    for k in range(LONG):
        out += tokens[k:k + n] * _WEIGHTS[k]
    return out.view(np.int64)


def within(covered: np.ndarray) -> np.ndarray:
    """The covered tokens of one block that go: all of them if the block is covered whole, else those in
    runs of LONG or more. A shorter run at a block's edge only continues the boilerplate beside it by chance."""
    if covered.all():
        return covered
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    out = np.zeros(len(covered), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        out[a:b] = b - a >= LONG
    return out


def _streams(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, tokens, stream): all blocks but main ones; ``whole``: the page marks no main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zones, texts, count, whole = [], [], [], []
            for page in b.column("html"):
                found = blocks_of(page.as_py())
                whole.append(not any(z == MAIN for z, _ in found))
                rest = [x for x in found if x[0] != MAIN]
                zones.append([z for z, _ in rest])
                texts.append([t for _, t in rest])
                count.append(sum(t.count(" ") + 1 for _, t in rest))
            yield pa.record_batch([b.column("page_id"), b.column("url"), b.column("host"), pa.array(zones, pa.list_(pa.int32())),
                                   pa.array(texts, pa.list_(pa.string())), pa.array(count, pa.int64()), pa.array(whole, pa.bool_())],
                                  ["page_id", "url", "host", "zones", "texts", "tokens", "whole"])

    rows = pages.select("page_id", "url", split_url(F.col("url"))[0].alias("host"), "html")
    return rows.mapInArrow(run, "page_id long, url string, host string, zones array<int>, texts array<string>, tokens long, whole boolean")


def _marked(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of the pages that mark their main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page in b.column("html"):
                main = [t for z, t in blocks_of(page.as_py()) if z == MAIN]
                texts.append("\n".join(main) if main else None)
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string").where("text IS NOT NULL")


#: A shard's rows: its pages, and windows (w) that other shards hold too.
_DEALT = ("host", "part", "page_id", "url", "zones", "texts", "whole", "w")


def _by_shard(rows: DataFrame, solve, ddl: str) -> DataFrame:
    """Apply ``solve`` to the pages of each shard and the windows sent to it; it gives record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, sent = None, [], []
        for b in batches:
            hosts, parts, w = b.column("host").to_pylist(), b.column("part").to_pylist(), b.column("w").to_pylist()
            for i in range(b.num_rows):
                if (hosts[i], parts[i]) != group:
                    if held:
                        yield from solve(group, held, sent)
                    group, held, sent = (hosts[i], parts[i]), [], []
                if w[i] is not None:
                    sent.append(w[i])
                else:
                    held.append((b.column("page_id")[i].as_py(), b.column("url")[i].as_py(), b.column("zones")[i].as_py(),
                                 b.column("texts")[i].as_py(), b.column("whole")[i].as_py()))
        if held:
            yield from solve(group, held, sent)

    return rows.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(run, ddl)


def _across(rows: DataFrame) -> DataFrame:
    """(host, part, w): windows on unmarked pages that one stream of their shard holds, and a stream of another shard too."""

    def solve(group: tuple, held: list[tuple], _: list[int]) -> Iterator[pa.RecordBatch]:
        streams, first, known = _distinct([texts for _, _, _, texts, _ in held])
        hashes = _hashes(known)
        tokens = [hashes[x] for x in streams]
        asks = np.zeros(len(streams), bool)
        asks[[k for k, r in zip(first, held) if r[4]]] = True
        found = [windows(x) for x in tokens]
        digest = np.array([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in tokens], np.int64)
        owner = np.repeat(np.arange(len(streams)), [len(x) for x in found])
        w = np.concatenate(found)
        order = np.argsort(w, kind="stable")
        w, owner = w[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])[:len(w)])
        if not len(at):
            return
        low, high = np.minimum.reduceat(digest[owner], at), np.maximum.reduceat(digest[owner], at)
        asked, w = np.logical_or.reduceat(asks[owner], at), w[at]
        for k in range(0, len(w), 1 << 15):
            n = len(w[k:k + (1 << 15)])
            yield pa.record_batch([pa.array([group[0]] * n, pa.string()), pa.array([group[1]] * n, pa.int32()),
                                   *[pa.array(x[k:k + n]) for x in (w, low, high, asked)]], ["host", "part", "w", "low", "high", "asked"])

    own = _by_shard(rows, solve, "host string, part int, w long, low long, high long, asked boolean")
    same = Window.partitionBy("host", "w")
    own = own.withColumn("least", F.min("low").over(same)).withColumn("most", F.max("high").over(same))
    return own.where("asked AND low = high AND least != most").select("host", "part", "w")


def _unmarked(streams: DataFrame) -> DataFrame:
    """(page_id, url, text) of the other pages: open text less what the host's other pages cover."""
    streams = stored(streams, "streams")
    # written, so that Spark knows its size: a join by host would send a hot host's pages to one task
    spread = stored(streams.groupBy("host").agg(F.sum("tokens").alias("all"), F.max("whole").alias("asks")).where(F.col("all") > SHARD)
              .select(F.col("host").alias("h"), F.ceil(F.col("all") / SHARD).cast("int").alias("parts"), "asks"), "hosts")
    rows = streams.join(spread, F.col("host") == F.col("h"), "left")
    rows = rows.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id"), F.col("parts"))).cast("int"))
    rows = rows.withColumn("w", F.lit(None).cast("long"))
    pages = rows.select(*_DEALT)
    if not spread.where("asks").isEmpty():
        sent = _across(rows.where("asks").select(*_DEALT))
        pages = pages.unionByName(sent, allowMissingColumns=True)

    def solve(_: tuple, held: list[tuple], sent: list[int]) -> Iterator[pa.RecordBatch]:
        streams_, first, known = _distinct([texts for _, _, _, texts, _ in held])
        covered = repeated(streams_)
        if sent:
            hashes, elsewhere = _hashes(known), np.array(sent, np.int64)
            for k in {k for k, r in zip(first, held) if r[4]}:
                for at in np.flatnonzero(np.isin(windows(hashes[streams_[k]]), elsewhere)):
                    covered[k][at:at + LONG] = True
        out = []
        for (page_id, url, zones, texts, whole), k in zip(held, first):
            if not whole:
                continue
            blocks, at = [], 0
            for z, t in zip(zones, texts):
                words = t.split(" ")
                if z == OPEN:
                    left = " ".join(w for w, c in zip(words, within(covered[k][at:at + len(words)])) if not c)
                    if left:
                        blocks.append(left)
                at += len(words)
            out.append((page_id, url, "\n".join(blocks)))
        yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()),
                               pa.array([r[2] for r in out], pa.string())], ["page_id", "url", "text"])

    return _by_shard(pages, solve, "page_id long, url string, text string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    both = _marked(pages).unionByName(_unmarked(_streams(pages)))
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
