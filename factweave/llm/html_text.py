"""Main text of web pages: nearest-URL page differencing, and structure of the markup.

All pages are sorted by host and URL path, and each is paired with the one next to it on the same host whose path shares
the longer prefix. The text lines of both are aligned by longest common subsequence and the shared ones deleted: they
belong to the site, not to the page. Copies of a page stand side by side on real sites and would delete each other, so three
limits keep that right: what is deleted must be shared with the next page on the other side too, where there is one on
the host; lines inside an <article> or <main> are the page's own whatever its neighbours say; and a page of which nothing
would be left keeps its lines.

Of the lines that are left, those go that the markup itself names as menu, header, footer, sidebar, notice, advert, form,
script, style or reader comments: such lines may differ from page to page.

Pages are dealt to slices of the sorted order, whose bounds come from a sort of the keys alone; the first and the last
page of a slice go to its neighbours too. So each page meets its neighbours, however many slices there are.

Defined results: null html counts as empty and gives an empty text; a null url counts as an empty one; equal rows are
all kept; truncated and unclosed markup is read as far as it goes; nothing is capped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_filter import host_of, path_of

SCHEMA = "page_id long, url string, text string, n_chars long, n_shared_lines long"
#: Fixed values of the markup's standard: elements without an end, elements that begin a block, elements with main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
MAIN = frozenset(("article", "main"))
#: Elements whose content isn't text of the page, and elements that are something else than its main text.
SILENT = frozenset("canvas datalist head iframe noscript object script select style svg template textarea audio video".split())
DROPPED = frozenset("aside button canvas datalist dialog footer form head iframe input label menu nav noscript object script select style svg template textarea title video audio".split())
#: Words in class, id or role that name something else than main text.
NOT_MAIN = frozenset("ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus disclaimer footer gdpr masthead menu menubar modal nav navbar navigation navigation newsletter notice notices notification overlay pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget widgets".split())
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
#: Elements that no name of theirs can make something else than the page and its main text.
WHOLE = frozenset(("html", "body", "main", "article"))
#: Words that make a name one of a state, as in `has-sidebar` and `comments-open`: before a listed word, and at the end.
STATE_BEGINS, STATE_ENDS = frozenset("has with no without is not".split()), frozenset("open closed on off enabled disabled".split())
#: Words that name a block when they stand behind a listed word, as in `share-buttons`, and listed words that name a layout: the
#: main text may stand in an element that is named after them, as in `content-sidebar-wrap`.
BLOCK_NAMES = frozenset("area bar block box button buttons container form group inner item items label link links list panel post posts section slot title unit wrap wrapper".split())
LAYOUT_NAMES, LAYOUT = frozenset("footer masthead menu menubar nav navbar search sidebar toolbar topbar widget widgets".split()), 3
#: Bits of the table by which lines are aligned; more lines than that are halved first.
ALIGN_BITS = 1 << 26

#: A line of a page: its text, whether it is inside <article> or <main>, whether the markup names it as something else.
Line = tuple[str, bool, bool]


#: Pieces of markup: what begins an element or ends one, and an attribute with its value.
_OPENS, _ATTRIBUTE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)"), re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")


class Scanner:
    """Reads markup from left to right, in time that is linear in the page: what was looked for in vain isn't looked for
    again, and where a tag runs on to the end of the page, quotes count no more."""

    def __init__(self, html: str):
        self.html, self.gone, self.quotes = html, set(), True

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def attributes(self, at: int) -> tuple[list[tuple[str, str | None]], int, bool] | None:
        """Names and values behind `at`, where the tag ends, and whether it ends at once; None if it doesn't end."""
        html, found = self.html, []
        while m := _ATTRIBUTE.match(html, at):
            at, value = m.end(), None
            if m[2]:
                quote = html[at : at + 1]
                close = self.find(quote, at + 1) if self.quotes and quote in ('"', "'") else -1
                if close >= 0:
                    value, at = html[at + 1 : close], close + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            found.append((m[1].lower(), value and unescape(value)))
        end = html.find(">", at)
        return None if end < 0 else (found, end + 1, html[at:end].endswith("/"))

    def run(self, lines: Lines) -> None:
        html, at = self.html, 0
        while at < len(html):
            k = self.find("<", at)
            if k < 0 or ">" in self.gone:
                break
            if k > at:
                lines.data(unescape(html[at:k]))
            at = k
            m = _OPENS.match(html, at)
            if m:
                read = self.attributes(m.end())
                if read is None and self.find(">", at) >= 0:
                    self.quotes = False
                    read = self.attributes(m.end())
                if read is None:
                    break
                attrs, at, empty = read
                tag = m[2].lower()
                if m[1]:
                    lines.close(tag)
                    continue
                lines.start(tag, attrs)
                if empty and tag not in VOID:
                    lines.close(tag)
                elif tag in ("script", "style") and tag not in self.gone:
                    end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                    if not end:
                        return  # the rest is the element's
                    at = end.start()
            elif html.startswith("<!--", at):
                close = at + 3 if html.startswith("<!-->", at) else self.find("-->", at + 4)
                close = self.find(">", at) if close < 0 else html.index(">", close)
                at = close + 1 if close >= 0 else len(html)
            elif html[at + 1 : at + 2] in ("!", "?", "/"):
                close = self.find(">", at)
                if close < 0:
                    break
                at = close + 1
            else:
                lines.data("<")
                at += 1
        if at < len(html):
            lines.data(unescape(html[at:]))


class Lines:
    """Blocks of text of a page."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # element; here or above: without text, something else, main
        self.count: Counter[str] = Counter()
        self.blocks: list[int] = []  # places in `open` of the elements that begin a block
        self.words: tuple[list[str], list[str], list[str]] = [], [], []  # of the block so far: main text, something else, main text if there is none else
        self.plain_main = False  # an element with main text outside what is named as something else

    @classmethod
    def of(cls, html: str | None) -> list[Line]:
        lines = cls()
        Scanner(html or "").run(lines)
        lines.cut()
        return [(text, main, other == 1 or (other == 2 and lines.plain_main)) for text, main, other in lines.lines]

    def cut(self) -> None:
        for other, words in enumerate(self.words):
            if words:
                text = " ".join("".join(words).split())
                if text:
                    self.lines.append((text, bool(self.open and self.open[-1][3]), other))
                words.clear()

    def start(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.cut()
            if tag in ("p", "li", "dt", "dd", "option") or (tag[0] == "h" and tag[1:].isdigit()):
                self._close_paragraph(tag)
        elif tag == "br":
            self.words[self.kind()].append(" ")
        if tag in VOID:
            return
        silent, other, main = self.open[-1][1:] if self.open else (False, 0, False)
        if other == LAYOUT and tag in MAIN:  # what is named after its layout holds the main text
            other, main = (0, True) if tag == "main" else (2, True)
        main = main or (tag in MAIN and not other)
        self.plain_main = self.plain_main or (main and not other)
        if other in (0, 2) and (tag in DROPPED or (tag == "header" and not main)):
            other = 1
        elif other in (0, 2) and tag not in WHOLE:
            named = self._named(tag, attrs, main)
            other = named and (LAYOUT if named == 2 and not main else 1) or other
        self.open.append((tag, silent or tag in SILENT, other, main))
        self.count[tag] += 1
        if tag in BLOCK:
            self.blocks.append(len(self.open) - 1)

    def _named(self, tag: str, attrs: list[tuple[str, str | None]], main: bool) -> int:
        """0 if no name says that the element isn't main text, 2 if names of a layout alone do, else 1.

        Inside main text, and for headings, a word counts only as the whole name or before a word for a block: there
        `related-work` and `share-price` are names of what is said. Ids of headings are anchors."""
        heading, found = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit(), set()
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return 1
            if name in ("class", "id", "role") and value and not (heading and name == "id"):
                for token in value.split():
                    words = [w.lower() for w in _NAME.findall(token)]
                    if NOT_MAIN.isdisjoint(words) or words[-1] in STATE_ENDS:
                        continue
                    first = next(k for k, w in enumerate(words) if w in NOT_MAIN)
                    if (main or heading) and (first or not BLOCK_NAMES.union(NOT_MAIN).issuperset(words[1:])):
                        continue
                    if STATE_BEGINS.isdisjoint(words[:first]):
                        found.update(w for w in words if w in NOT_MAIN)
        return 0 if not found else 2 if found <= LAYOUT_NAMES else 1

    def _close(self, k: int) -> None:
        """The element at place k ends, and all that is open in it."""
        for tag, *_ in self.open[k:]:
            self.count[tag] -= 1
        del self.open[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def _close_paragraph(self, tag: str) -> None:
        """A paragraph ends where the next block begins; items end where the next item of their list begins."""
        if self.blocks and self.open[self.blocks[-1]][0] in (tag, "p"):
            self._close(self.blocks[-1])

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        if self.count[tag]:
            k = len(self.open) - 1
            while self.open[k][0] != tag:
                k -= 1
            self._close(k)

    def data(self, text: str) -> None:
        if not self.open:
            self.words[0].append(text)
        elif not self.open[-1][1]:
            self.words[self.kind()].append(text)

    def kind(self) -> int:
        """Where text goes now: see `words`."""
        other = self.open[-1][2] if self.open else 0
        return 1 if other == LAYOUT else other


def _rows(a: list, b: list) -> list[int]:
    """For each line of `a` the bits of `b` at which the common subsequence with all lines so far gets no longer."""
    places: dict = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, []
    for line in a:
        u = v & places.get(line, 0)
        v = (v + u | v - u) & full
        out.append(v)
    return out


def _reach(row: int, n: int) -> list[int]:
    """Length of the common subsequence with the first 0 to n lines."""
    out = [0]
    for bit in bin(row | 1 << n)[:2:-1]:
        out.append(out[-1] + (bit == "0"))
    return out


def common_lines(a: list, b: list) -> list[int]:
    """Places in `a` of a longest common subsequence with `b`, by rows of bits (Hyyrö 2004), halved where they are many (Hirschberg 1975)."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    own, other = a[lead : len(a) - tail], b[lead : len(b) - tail]
    there, here = set(other), set(own)
    places = [k for k, x in enumerate(own) if x in there]  # others cannot be shared
    own, other = [own[k] for k in places], [x for x in other if x in here]
    if len(own) * len(other) > ALIGN_BITS and len(own) > 1:
        half = len(own) // 2
        before = _reach(_rows(own[:half], other)[-1], len(other))
        after = _reach(_rows(own[:half - 1 : -1], other[::-1])[-1], len(other))[::-1]
        at = max(range(len(other) + 1), key=lambda j: before[j] + after[j])
        found = common_lines(own[:half], other[:at]) + [half + k for k in common_lines(own[half:], other[at:])]
    else:
        rows, found, i, j = _rows(own, other), [], len(own), len(other)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    found.append(i)
                    j -= 1
        found.reverse()
    return [*range(lead), *(lead + places[k] for k in found), *range(len(a) - tail, len(a))]


def difference(own: list[Line], *others: list[Line]) -> tuple[str, int]:
    """The page's text, and how many lines went because its neighbours have them too; the nearest neighbour comes first. A line
    without the third mark isn't named. Copies stand side by side, so what goes must stand in the second neighbour too; a
    page of which that leaves nothing is a copy of both and keeps its lines."""
    lines = [(*line, False)[:3] for line in own]
    shared: set[int] = set()
    for k, other in enumerate(filter(None, others)):
        common = {k for k in common_lines([t for t, *_ in lines], [t for t, *_ in other]) if not lines[k][1]}
        shared = shared & common if k else common
    if not any(k not in shared and not named for k, (_, _, named) in enumerate(lines)):
        shared = {k for k in shared if lines[k][2]}
    return "\n\n".join(t for k, (t, _, named) in enumerate(lines) if k not in shared and not named), len(shared)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


#: What orders the pages; equal rows have equal keys and are neighbours.
ORDER = ["host", "path", "mark", "page_id"]
_KEYED = "slice int, home boolean, host string, path string, mark long, page_id long, url string, html string"


def _key(host: str, path: str, mark: int, page_id: int | None) -> tuple:
    """As Spark sorts: strings by their bytes, nulls first."""
    return host.encode(), path.encode(), mark, page_id is not None, page_id or 0


def bounds(keyed: DataFrame, slices: int) -> list[tuple[tuple, tuple]]:
    """First and last key of each slice that holds pages: two keys for each of the slices at the driver, whose number is a setting."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            if b.num_rows:
                first = first or b.slice(0, 1)
                last = b.slice(b.num_rows - 1)
        if first:
            yield first
            yield last

    keys = keyed.select(*ORDER)
    found = keys.repartitionByRange(slices, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(ends, keys.schema).collect()
    ends_ = sorted(_key(*r) for r in found)
    return list(zip(ends_[::2], ends_[1::2], strict=True))


def sliced(keyed: DataFrame, slices: list[tuple[tuple, tuple]]) -> DataFrame:
    """Each page with its slice; the ends of a slice once more for the slice next to it, where they aren't at home."""
    shipped = keyed.sparkSession.sparkContext.broadcast(([last for _, last in slices], slices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lasts, all_ = shipped.value
        for b in batches:
            spot, home, take = [], [], []
            for k, key in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
                key = _key(*key)
                n = bisect_left(lasts, key)
                spot.append(n)
                home.append(True)
                take.append(k)
                for near, end in ((n - 1, all_[n][0]), (n + 1, all_[n][1])):
                    if key == end and 0 <= near < len(all_):
                        spot.append(near)
                        home.append(False)
                        take.append(k)
            rows = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(spot, pa.int32()), pa.array(home, pa.bool_()), *rows.columns], names=[x.split()[0] for x in _KEYED.split(", ")])

    return keyed.mapInArrow(run, _KEYED)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared_lines) of each row of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = here = None
        done: list[tuple] = []

        def result(after) -> tuple:
            near = [x for x in (before, after) if x and x["place"] == here["place"]]
            near.sort(key=lambda x: -_prefix(x["path"], here["path"]))
            text, shared = difference(here["lines"], *(x["lines"] for x in near))
            return here["page_id"], here["url"], text, len(text), shared

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for k in range(b.num_rows):
                number, home, host, path, _, page_id, url, html = (c[k].as_py() for c in b.columns)
                now = {"home": home, "place": (number, host), "path": path, "page_id": page_id, "url": url, "lines": Lines.of(html)}
                if here and here["home"]:
                    done.append(result(now))
                before, here = here, now
                if len(done) >= 500:
                    yield batch()
        if here and here["home"]:
            done.append(result(None))
        if done:
            yield batch()

    text = lambda c: F.coalesce(c, F.lit(""))
    # Copies under one URL are ordered by their text, so that a hot page fills as many slices as it needs.
    keyed = pages.select(text(host_of(F.col("url"))).alias("host"), text(path_of(F.col("url"))).alias("path"), F.xxhash64("html").alias("mark"), "page_id", "url", "html")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = bounds(keyed, parts)
    if not slices:
        return pages.sparkSession.createDataFrame([], SCHEMA)
    dealt = sliced(keyed, slices).repartitionById(len(slices), "slice").sortWithinPartitions("slice", *ORDER)
    return dealt.mapInArrow(run, SCHEMA)
