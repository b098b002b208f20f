"""HTML extraction by text-to-tag ratios.

The standard library's parser streams events; block elements cut the page into lines. Each line has a ratio of text
characters (those of links don't count) to tags; the ratios are smoothed by a Gaussian over neighbouring lines and
clustered by a threshold (two means). The outermost article or main element that holds most of the upper cluster is the
content region, or else the lowest common ancestor of all its lines, with headings and paragraphs beside it.

Of the region's lines the clusters decide, too. Lines of the upper cluster stay. A line of the lower cluster goes if it is
mostly links and not in an article (a menu), or, where
no article or main element bounds the region, if it stands before or after all headings, paragraphs and lines of the upper
cluster. Copyright lines outside articles, after the last line whose own ratio is above the threshold, go, too. All others stay, however short. Elements that are not content by their meaning (menus, scripts,
forms, comments, adverts and so on) have ratio 0 and are left out wherever they are; so are elements that a class or id
names as such, if the name says nothing else ("comment-list", but not "share-price"). A name doesn't count on an element
that holds all article and main elements of the page.

Defined results: a null or empty page, and one without content, gives the empty text; broken markup is read as the
parser reads it (an element that isn't closed ends with its parent; what stands after a `<` that opens nothing is text);
repeated pages are rows of their own; null ids and urls are kept; pages of any length are read whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split()
)
#: Elements that are never the text of an article.
OUTSIDE = frozenset(
    "head script style noscript template iframe object svg math canvas audio video nav footer aside form button select textarea input dialog menu title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words of class and id names that mark what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus disclaimer footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination paywall popup privacy promo promoted "
    "promotion related replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that may stand before and after these without saying anything else.
BEFORE = frozenset("site page main top bottom left right primary secondary global post entry article the my js wp user reader sticky fixed mobile desktop email web full small large popular latest".split())
AFTER = frozenset(
    "area articles aside bar block body bottom box button buttons btn card center column container content count dialog entries field form frame group heading icon icons inner input "
    "item items label layer left line link links list main media message module network networks outer overlay panel policy post posts region right row section slot stories strip "
    "text thread title tools top unit wrap wrapper zone".split()
)
REGION = frozenset("html body".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure".split())
PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")
#: An open element of a kind is ended by the start of another.
ENDS = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
#: Conditions of old browsers, which the parser takes for text.
CONDITION = re.compile(r"<!\[(?:if|endif)[^>]*>", re.I)
COPYRIGHT = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|all rights reserved", re.I)
SIGMA = 1.0


def _names_other(name: str) -> bool:
    """Whether a class or id names something other than the article, and nothing else."""
    parts = [part.lower() for part in PART.findall(name)]
    at = [k for k, part in enumerate(parts) if part in NAMES]
    return bool(at) and all(part in NAMES or (part in BEFORE and k < at[-1]) or (part in AFTER and k > at[0]) for k, part in enumerate(parts))


def _outside(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """0: no; 1: by meaning; 2: by its name."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return 1
    if tag in REGION or tag in ("article", "main") and not any(k == "class" and v and any(map(_names_other, v.split())) for k, v in attrs):
        return 0
    named = False
    for key, value in attrs:
        if not value and key not in ("hidden",):
            continue
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.lower() in ROLES):
            return 1
        if key == "style" and "display:none" in value.replace(" ", "").lower():
            return 1
        named |= key in ("class", "id") and any(_names_other(name) and not (in_article and name.lower() == "header") for name in value.split())
    return 2 if named else 0


class Events(HTMLParser):
    """Lines of a page: text, number of tags, the path of open elements, whether they are outside, characters in links.

    Elements whose number is in `plain` aren't outside by their name.
    """

    def __init__(self, plain: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.plain, self.skipped = plain, False
        self.open: list[tuple[str, int, int]] = []  # name, number of the element, number of the element that is outside (0: none)
        self.n = 0
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0
        self.lines: list[tuple[str, int, tuple[int, ...], bool, int]] = []
        self.kinds: dict[int, str] = {}
        self.articles = 0
        self.named: dict[int, int] = {}  # elements outside by their name: article and main elements in them
        self.all_articles = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, tuple(x[1] for x in self.open), False, self.linked))
        elif self.skipped:
            self.lines.append(("", self.tags, (), True, 0))
        self.text.clear()
        self.tags, self.skipped, self.linked = 0, False, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag == "br" or tag in ("td", "th"):
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in ENDS:
            for k in range(len(self.open) - 1, max(-1, len(self.open) - 12), -1):
                name = self.open[k][0]
                if name in ENDS[tag]:
                    self._close(k)
                    break
                if name in BLOCK and name not in ("p",):
                    break
        self.n += 1
        self.kinds[self.n] = tag
        up = self.open[-1][2] if self.open else 0
        why = 0 if up else _outside(tag, attrs, self.articles > 0)
        if why == 2 and self.n in self.plain:
            why = 0
        elif why == 2:
            self.named[self.n] = 0
        if tag in ("article", "main"):
            self.all_articles += 1
            if up in self.named or why == 2:
                self.named[up or self.n] += 1
        self.open.append((tag, self.n, up or (self.n if why else 0)))
        self.articles += tag in ("article", "main")
        self.links += tag == "a"

    def _close(self, k: int) -> None:
        self.articles -= sum(x[0] in ("article", "main") for x in self.open[k:])
        self.links -= sum(x[0] == "a" for x in self.open[k:])
        del self.open[k:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag in ("svg", "math"):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in ("td", "th"):
            self.text.append(" ")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # a declaration that the parser can't read is a comment up to its end
            return self.parse_bogus_comment(i, report)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            self.skipped = True
        else:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def _smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    padded = np.concatenate([np.full(reach, x[0]), x, np.full(reach, x[-1])])
    return np.convolve(padded, kernel, "valid")


def _threshold(x: np.ndarray) -> float:
    """Between two clusters of values: the mean of their means, found by iteration from the overall mean."""
    t = float(x.mean())
    for _ in range(50):
        low, high = x[x < t], x[x >= t]
        if not len(low) or not len(high):
            return t
        new = float((low.mean() + high.mean()) / 2)
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def _read(html: str) -> Events:
    """The events, read again where a name would hide all articles of the page."""
    plain: frozenset[int] = frozenset()
    while True:
        events = Events(plain)
        events.feed(CONDITION.sub(" ", html))
        events.close()
        events.flush()
        layout = {e for e, n in events.named.items() if n and n == events.all_articles and events.kinds[e] not in ("article", "main")}
        if not layout:
            return events
        plain |= layout


def extract(html: str | None) -> str:
    if not html:
        return ""
    events = _read(html)
    lines = events.lines
    inside = [k for k, x in enumerate(lines) if not x[3]]
    if not inside:
        return ""
    linked = [min(1.0, x[4] / max(len(x[0]), 1)) for x in lines]
    ratio = np.array([0.0 if x[3] else len(x[0]) * (1 - linked[k]) / max(x[1], 1) for k, x in enumerate(lines)])
    smooth = _smooth(ratio)
    t = _threshold(smooth)
    content = [k for k in inside if smooth[k] >= t and ratio[k] > 0 and linked[k] <= 0.5] or inside
    votes: dict[int, int] = {}
    total = 0
    for k in content:
        size = len(lines[k][0])
        total += size
        for e in lines[k][2]:
            if events.kinds[e] not in ENDS and events.kinds[e] not in ("b", "i", "em", "strong", "a", "span", "u", "font", "small", "code"):
                votes[e] = votes.get(e, 0) + size
    # The outermost article or main element with most of the content, or else the lowest common ancestor of all content lines.
    kind = events.kinds
    named = [e for e, v in votes.items() if kind[e] in ("article", "main") and v > 0.5 * total]
    if named:
        region = min(named)
    else:
        region = max((e for e, v in votes.items() if v == total), default=0)
        path = next((x[2] for x in lines if region in x[2]), ())
        up = [e for e in path[: path.index(region) + 1] if kind[e] in ("div", "section", "body", "html", "article", "main")] if region else []
        region = up[-1] if up else 0
        # Headings and paragraphs around it belong to it; a parent that holds anything else isn't taken.
        for e in reversed(up[:-1]):
            more = [x[2] for x in lines if e in x[2] and region not in x[2]]
            if all(any(kind[k] in PROSE for k in line) for line in more):
                region = e
            else:
                break
    chosen, own = set(content), [k for k in inside if not region or region in lines[k][2]]
    path = {k: {kind[e] for e in lines[k][2]} for k in own}
    menu = {k for k in own if linked[k] > 0.5 and "article" not in path[k] and not PROSE & path[k]}
    last = max((k for k in content if ratio[k] >= t), default=content[-1])
    legal = {k for k in own if k > last and COPYRIGHT.search(lines[k][0]) and not path[k] & {"article", "main"}}
    # Without an element that bounds the article, it goes from its first to its last heading, paragraph or line of the cluster.
    body = [k for k in own if k not in legal and (k in chosen or PROSE & path[k])]
    low, high = (own[0], own[-1]) if named or not body else (body[0], body[-1])
    keep = chosen.union(k for k in own if low <= k <= high and k not in menu) - legal
    return "\n\n".join(lines[k][0] for k in sorted(keep))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(x: dict[str, list]) -> dict[str, list]:
        texts = [extract(h) for h in x["html"]]
        return {"page_id": x["page_id"], "url": x["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return pages.mapInArrow(by_slices(rows, schema), "page_id long, url string, text string, n_chars long")
