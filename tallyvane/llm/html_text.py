"""Main text of web pages: streaming parser events, text-to-tag ratios, Gaussian smoothing, clustering.

The standard library's parser streams events; a block (paragraph, heading, list item, table row, or
loose text between them) is a line with its text, its tags, its linked text and its place. The lines' text-to-tag
ratios are smoothed by a Gaussian kernel and cut in two clusters by a threshold found by two-means;
the lines of the upper cluster vote, by length, for the elements they stand in. The articles with votes, and beside
them those not mostly link text, are the content region (or main elements, or else the least element that holds all
votes, with the headings and the lines beside it that are not mostly link text). Every line of the region is kept
whole, whatever its own ratio, but for boilerplate: by kind (menus, headers, footers, asides, forms, scripts, styles),
by role or if hidden, and by name. A class or id all of whose parts name boilerplate or a place of it (`sidebar-left`,
`comment-list`) takes its element out, unless that holds the article or main element with votes and none
stands elsewhere. A class or id with such a part among others (`post-header`, `notice-board-history`) is evidence
only: its element goes if it is mostly link text, or if it stands outside of articles, has no heading and no line of
the upper cluster. Where the region is the whole body, leading and trailing lines of mostly link text go too.

Elements are numbered as they open and know their parent alone, and open tags are found by name, so time and memory
follow the page's length, however deep its elements lie. Null and empty pages, and pages of boilerplate alone, give
empty text. Broken markup is read as far as it goes: what stands after the last `>` is text, and so is the head of a comment, a marked
section or a tag that nothing ends. That no end of a kind lies ahead is found once a page; start tags that end nowhere (quotes that
never close) are looked for until they cost RESCANS readings of the page, and are text to the next `>` from then on. Pages of any
length are read whole. Repeated rows give equal results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
GONE = frozenset("aside button datalist dialog footer form head header iframe menu nav noscript object option script select style svg template textarea title".split())
GONE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
GONE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted"
    " promotion recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: What a name that stands for boilerplate alone may have beside its GONE_NAMES.
PARTS_OF = frozenset(
    "area block bottom box btn button center container content footer form global group header icon inner item items js left link links list main"
    " mobile outer page panel primary reader readers right row secondary section site slot text thread title top unit user wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_GONE = frozenset("html body article main".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SAME_STOP = frozenset("ul ol dl table body html article section div select".split())
#: Readings of a page that start tags without an end may cost.
RESCANS = 8
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Line:
    __slots__ = ("text", "tags", "linked", "at")

    def __init__(self, text: str, tags: int, linked: int, at: int):
        self.text, self.tags, self.linked, self.at = text, tags, linked, at


class Lines(HTMLParser):
    """Lines of a page outside of boilerplate by kind. Block elements, and those named as boilerplate, have numbers that
    rise as they open; a line's place is the number of its innermost one, 0 where there is none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # tag, whether it is gone (by kind 1, by name 2, perhaps 3), number
        self.where: dict[str, list[int]] = {}  # places of the open elements of a tag in the stack
        self.blocks: list[int] = []  # those of open block elements
        self.open = [0]  # numbers of the open numbered elements
        self.named: set[int] = set()  # elements gone by name, those of them that hold an article or main element, and elements perhaps gone
        self.holding: set[int] = set()
        self.perhaps: set[int] = set()
        self.named_open: list[int] = []
        self.spent = 0  # characters read for start tags that nothing ends
        self.open_ended: set[str | bool] = set()  # kinds of markup of which no end lies ahead
        self.gone = self.links = 0
        self.kinds, self.parents = [""], [0]
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[Line] = []

    def check_for_whole_start_tag(self, i: int) -> int:
        if self.spent > RESCANS * len(self.rawdata):
            return -1
        end = super().check_for_whole_start_tag(i)
        if end < 0:
            self.spent += len(self.rawdata) - i
        return end

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = -1 if "comment" in self.open_ended else super().parse_comment(i, report)
        if end < 0:
            self.open_ended.add("comment")
        return end

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        kind = self.rawdata[i + 3 : i + 11].lower().startswith(("if", "else", "endif"))
        try:
            end = -1 if kind in self.open_ended else super().parse_marked_section(i, report)
        except AssertionError:  # of no known kind
            return self.parse_bogus_comment(i)
        if end < 0:
            self.open_ended.add(kind)
        return end

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, self.tags, self.linked, self.open[-1]))
            self.parts = []
        self.tags = self.linked = 0

    def pop(self) -> None:
        if self.stack[-1][1]:
            self.flush()
        tag, gone, number = self.stack.pop()
        self.where[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        if number:
            self.open.pop()
        if gone == 2:
            self.named_open.pop()
        self.gone -= gone == 1
        self.links -= tag == "a"

    def close_to(self, k: int) -> None:
        while len(self.stack) > k:
            self.pop()

    def innermost(self, tags: frozenset | set) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def close_open(self, tags: frozenset | set, stop: frozenset) -> None:
        k = self.innermost(tags)
        if k >= 0 and k >= self.innermost(stop):
            if self.stack[k][2] or self.stack[k][1]:
                self.flush()
            self.close_to(k)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P:
                self.close_open({"p"}, SAME_STOP)
        if tag in SAME:
            self.close_open(SAME[tag], SAME_STOP)
        self.tags += 1
        if tag in VOID:
            if not self.gone:
                self.parts.append(" ")
            return
        if tag in ("td", "th"):
            self.parts.append(" ")
        gone = 1 if tag in GONE else self.named_gone(attrs) if tag not in NEVER_GONE and attrs else 0
        if gone == 3 and (tag not in BLOCKS or tag in HEADINGS):
            gone = 0
        number = 0
        if tag in ("article", "main") and not self.gone:
            for n in reversed(self.named_open):
                if n in self.holding:
                    break
                self.holding.add(n)
        if gone and not self.gone:
            self.flush()
        if tag in BLOCKS or gone == 2:
            number = len(self.kinds)
            self.kinds.append(tag)
            self.parents.append(self.open[-1])
            self.open.append(number)
        if gone == 2:
            self.named.add(number)
            self.named_open.append(number)
        elif gone == 3:
            self.perhaps.add(number)
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, gone, number))
        self.gone += gone == 1
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in GONE:
            self.flush()
        k = self.innermost({tag})
        if k < 0 or tag not in BLOCKS and self.blocks and self.blocks[-1] > k:
            return  # an inline end tag closes no block
        if self.stack[k][1]:
            self.flush()
        self.close_to(k)

    def handle_data(self, data: str) -> None:
        if not self.gone:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    @staticmethod
    def named_gone(attrs: list) -> int:
        """1 by role or if hidden, 2 by a class or id all of whose parts name boilerplate, 3 if some do, else 0."""
        named = 0
        for name, value in attrs:
            if name in ("class", "id"):
                for word in (value or "").split():
                    parts = {x.lower() for x in _TOKENS.findall(word)}
                    if not parts.isdisjoint(GONE_NAMES):
                        kind = 2 if parts <= GONE_NAMES | PARTS_OF else 3
                        named = kind if not named else min(named, kind)
            elif name == "role":
                if (value or "").lower() in GONE_ROLES:
                    return 1
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return 1
        return named


_KERNEL = [math.exp(-(x * x) / 2) for x in range(-2, 3)]


def smoothed_ratios(lines: list[Line]) -> list[float]:
    ratios = [len(x.text) / max(1, x.tags) for x in lines]
    out = []
    for i in range(len(ratios)):
        near = [(ratios[j], w) for j, w in zip(range(i - 2, i + 3), _KERNEL) if 0 <= j < len(ratios)]
        out.append(sum(r * w for r, w in near) / sum(w for _, w in near))
    return out


def threshold(values: list[float]) -> float:
    """Border of two clusters (two-means on the line, from the least and the greatest value)."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not above:
            return min(values)
        new = (sum(below) / len(below) if below else low, sum(above) / len(above))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def upper(lines: list[Line]) -> list[bool]:
    """Whether each line is of the upper cluster."""
    ratios = smoothed_ratios(lines)
    cut = threshold(ratios) if ratios else 0.0
    return [r >= cut for r in ratios]


def _below(parents: list[int], marked: set[int]) -> list[bool]:
    """Whether each element is marked or stands in a marked one."""
    out = [0 in marked] * len(parents)
    for n in range(1, len(parents)):
        out[n] = n in marked or out[parents[n]]
    return out


def _sums(parents: list[int], lines: list[Line], values: list[int]) -> list[int]:
    """The sum of the lines' values in each element."""
    out = [0] * len(parents)
    for line, v in zip(lines, values):
        out[line.at] += v
    for n in range(len(parents) - 1, 0, -1):
        out[parents[n]] += out[n]
    return out


def main_text(html: str) -> str:
    parser = Lines()
    last = html.rfind(">") + 1
    try:
        parser.feed(html[:last] + html[last:].replace("<", "&lt;"))
        parser.close()
    except AssertionError:  # the parser's own checks on broken declarations; what was read stays
        pass
    parser.flush()
    parents, kinds = parser.parents, parser.kinds
    content = _below(parents, {n for n, t in enumerate(kinds) if t in ("article", "main")})

    def without(lines: list[Line], elements: set[int]) -> list[Line]:
        gone = _below(parents, elements)
        return [x for x in lines if not gone[x.at]]

    lines = without(parser.lines, parser.named - parser.holding)
    if not lines:
        return ""
    chosen = upper(lines)
    # boilerplate names around an article with lines of the upper cluster say nothing if no such article has fewer of them
    deep = [0] * len(parents)
    for n in range(1, len(parents)):
        deep[n] = deep[parents[n]] + (n in parser.named)
    around = [x.at for x, ok in zip(lines, chosen) if ok and content[x.at]]
    fewest, low, seen = min((deep[n] for n in around), default=0), set(parser.holding), set()
    for n in (n for n in around if deep[n] == fewest):
        while n and n not in seen:
            seen.add(n)
            low.discard(n)
            n = parents[n]
    if low:
        lines = without(lines, low)
        chosen = upper(lines)
    if parser.perhaps:
        size, linked, above = (_sums(parents, lines, v) for v in ([len(x.text) for x in lines], [x.linked for x in lines], [int(ok) for ok in chosen]))
        headed = _sums(parents, lines, [int(kinds[x.at] in HEADINGS) for x in lines])
        low = {n for n in parser.perhaps if 2 * linked[n] > size[n] or not (content[n] or above[n] or headed[n])}
        if low:
            lines = without(lines, low)
            chosen = upper(lines)
    votes = _sums(parents, lines, [len(x.text) * ok for x, ok in zip(lines, chosen)])
    prose = _sums(parents, lines, [len(x.text) - 2 * x.linked for x in lines])
    some = _sums(parents, lines, [1] * len(lines))
    region, inside = None, []
    for kind in ("article", "main"):
        of_kind = [n for n, t in enumerate(kinds) if t == kind]
        found = {n for n in of_kind if votes[n]}
        if found:
            found |= {n for n in of_kind if some[n] and prose[n] >= 0}
            region, within = min(found), _below(parents, found)
            inside = [x for x in lines if within[x.at]]
            break
    if region is None:
        holders = [n for n in range(1, len(kinds)) if votes[n] == votes[0] and kinds[n] in BLOCKS and kinds[n] not in ("p", "li", "td", "tr", "pre")]
        region = max(holders, default=0)  # the last opened of those is the innermost
        within, near = _below(parents, {region}), _below(parents, {parents[region]})
        inside = [x for x in lines if within[x.at] or near[x.at] and (2 * x.linked <= len(x.text) or kinds[x.at] in HEADINGS)]
    if kinds[region] in ("", "body", "html"):
        plain = [k for k, x in enumerate(inside) if 2 * x.linked <= len(x.text)]
        inside = inside[plain[0] : plain[-1] + 1] if plain else []
    return "\n".join(x.text for x in inside)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a narrow map without a shuffle."""
    small_batches(pages.sparkSession)
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
