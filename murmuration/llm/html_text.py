"""Main text of web pages from the events of the standard parser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from murmuration.llm.rows import Batches, append_columns, appended, strings

CHUNK = 1 << 16
RADIUS = 2  # of the Gaussian, in lines
WHOLE = 0.9  # share of the content that a container must hold to stand for the one around it
FAIR = 0.2  # the same for an article element
SIBLING = 0.1  # share of the largest article that one beside it must hold
MOST = 0.5  # share of the text that no element loses by its name alone
OTHER = 0.1  # what a character outside of the content cluster counts

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
             "span strike strong sub sup time tt u var wbr br".split())
NEVER = set("head title script style noscript template iframe object svg math canvas audio video map select option "
            "optgroup datalist textarea button input progress meter".split())
AROUND = set("nav header footer aside form menu dialog fieldset search".split())
ROLES = set("navigation banner contentinfo complementary search menu menubar toolbar dialog alertdialog alert form "
            "note status".split())
CONTAINERS = set("html body main article section div td center blockquote".split())
HEAD = set("title script style noscript template base basefont bgsound link meta head html".split())
ARTICLE = {"article", "main"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertise\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification\w*|"
    r"alerts?|popup|modal|overlay|newsletter|subscri\w*|signup|login|nav|navbar|navigation|menu|topbar|toolbar|"
    r"breadcrumbs?|sidebar|side|rail|widgets?|footer|masthead|site-header|page-header|share|sharing|social|related|"
    r"recommend\w*|comments?|respond|replies|disqus|pagination|pager|skip|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.IGNORECASE,
)
# States of a wrapper, as in no-sidebar or comments-enabled, are not names of what it is.
STATES = re.compile(
    r"(?<![\w-])(?:(?:has|have|no|with|without|hide|hides|layout|is|not)[_-][\w-]+|"
    r"[\w-]+[_-](?:enabled|disabled|open|opened|closed|on|off|layout|active|inactive|visible|present))(?![\w-])",
    re.IGNORECASE,
)
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Element:
    tag: str
    outside: bool  # does not belong to the text
    within_article: bool
    container: int  # number of the innermost container
    named: tuple[int, ...] = ()  # elements around it, and itself, that only a class or an id marks as boilerplate


@dataclass
class Line:
    """The text between two block boundaries."""

    container: int
    outside: bool
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    named: tuple[int, ...] = ()
    within_article: bool = False

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents = [-1]  # of the containers; the first is the page
        self.kinds = ["page"]
        self.stack = [Element("page", False, False, 0)]
        self.lines: list[Line] = []
        self.links = 0
        self.n_named = 0
        self._open()

    def _open(self) -> None:
        top = self.stack[-1]
        tags = 0
        if self.lines and not self.lines[-1].parts:  # its tags belong to the text that follows
            last = self.lines.pop()
            tags = 0 if last.outside else last.tags
        self.lines.append(Line(top.container, top.outside, tags=tags, named=top.named, within_article=top.within_article))

    def _boilerplate(self, tag: str, attrs: dict[str, str | None], top: Element) -> bool:
        if tag in NEVER:
            return True
        if tag in AROUND and not (tag == "header" and top.within_article):
            return True
        if (attrs.get("role") or "").lower() in ROLES or "hidden" in attrs:
            return True
        if (attrs.get("aria-hidden") or "").lower() == "true" or HIDDEN.search(attrs.get("style") or ""):
            return True
        return False

    def _named(self, tag: str, attrs: dict[str, str | None], top: Element) -> bool:
        if tag in ("html", "body", *ARTICLE):
            return False
        names = [STATES.sub(" ", attrs.get(name) or "") for name in ("class", "id")]
        return any(NAMES.search(n) or (not top.within_article and HEADER.search(n)) for n in names)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.lines[-1].tags += 1
        if tag not in HEAD:
            self._end_head()
        if tag not in INLINE:
            self._implied(tag)
        top = self.stack[-1]
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag not in INLINE:
                self._open()
            return
        element = Element(tag, top.outside or self._boilerplate(tag, dict(attrs), top),
                          top.within_article or tag in ARTICLE, top.container, top.named)
        if not element.outside and self._named(tag, dict(attrs), top):
            element.named = (*top.named, self.n_named)
            self.n_named += 1
        if tag in CONTAINERS:
            self.parents.append(top.container)
            self.kinds.append(tag)
            element.container = len(self.parents) - 1
        self.links += tag == "a"
        self.stack.append(element)
        if tag not in INLINE or element.outside != top.outside or element.named != top.named:
            self._open()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in CONTAINERS:  # a slash does not close the elements of HTML that hold others
            self.handle_endtag(tag)

    def _implied(self, tag: str) -> None:
        """A new block ends an open paragraph, an item or a cell the one before it."""
        ends = {"p", *({tag} & {"li", "dt", "dd", "td", "th", "tr"})}
        if tag in ("dt", "dd"):
            ends |= {"dt", "dd"}
        elif tag in ("td", "th"):
            ends |= {"td", "th"}
        for k in range(len(self.stack) - 1, 0, -1):
            here = self.stack[k].tag
            if here in ends:
                self._close(k)
                return
            if here not in INLINE:
                return

    def _end_head(self) -> None:
        """The end tag of a head may be left out: what cannot be in it ends it."""
        if self.stack[-1].tag == "head":
            self._close(len(self.stack) - 1)

    def _close(self, k: int) -> None:
        self.links -= sum(e.tag == "a" for e in self.stack[k:])
        del self.stack[k:]
        self._open()

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1].tags += 1
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                if tag in INLINE and k == len(self.stack) - 1 and (
                    self.stack[k].outside, self.stack[k].named) == (self.stack[k - 1].outside, self.stack[k - 1].named):
                    self.links -= tag == "a"
                    self.stack.pop()
                else:
                    self._close(k)
                return
            if tag in INLINE and self.stack[k].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        line = self.lines[-1]
        if not line.outside:
            line.parts.append(data)
            if self.links:
                line.linked += len(data)


def smoothed(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights inside of the page count."""
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-(offsets**2) / (2.0 * (radius / 2) ** 2))
    whole = np.convolve(np.ones(len(values)), weights, "full")[radius : radius + len(values)]
    return np.convolve(values, weights, "full")[radius : radius + len(values)] / whole


def threshold(values: np.ndarray) -> float:
    """Where two clusters of the values part: midway between their means, found by repeated splitting."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            break
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def _region(events: Events, weight: list[float]) -> tuple[set[int], bool]:
    """Containers that make up the region of the content.

    A main element is trusted, an article if it holds a fair share of the page, together with those beside it that hold
    a fair share of the largest.  Without either, the way goes down
    from the page as long as one child holds nearly everything.  True if an article or main element was found.
    """
    inside = list(weight)
    for k in range(len(inside) - 1, 0, -1):  # children have higher numbers than their parents
        inside[events.parents[k]] += inside[k]
    largest: dict[int, float] = {}  # article by what is around all articles beside each other
    for k, kind in enumerate(events.kinds):
        if kind == "article":
            largest[events.parents[k]] = max(largest.get(events.parents[k], 0.0), inside[k])
    together: dict[int, float] = {}
    for k, kind in enumerate(events.kinds):
        if kind == "article" and inside[k] >= SIBLING * largest[events.parents[k]] > 0:
            together[events.parents[k]] = together.get(events.parents[k], 0.0) + inside[k]
    marked = [k for k, kind in enumerate(events.kinds)
              if kind == "main" and inside[k] > 0
              or kind == "article" and together.get(events.parents[k], 0.0) >= FAIR * inside[0] > 0]
    chosen = max(marked, key=lambda k: (events.kinds[k] == "main", inside[k], -k), default=0)
    children: dict[int, list[int]] = {}
    for k, parent in enumerate(events.parents):
        children.setdefault(parent, []).append(k)
    while not marked and (below := [k for k in children.get(chosen, ()) if inside[k] >= WHOLE * inside[chosen] > 0]):
        chosen = below[0]
    region = {chosen}
    if events.kinds[chosen] == "article":
        beside = events.parents[chosen]
        region |= {k for k in children[beside] if events.kinds[k] == "article" and inside[k] >= SIBLING * largest[beside]}
    for k in range(min(region) + 1, len(events.parents)):
        if events.parents[k] in region:
            region.add(k)
    return region, bool(marked)


def _spared(events: Events, lines: list[tuple[Line, str]]) -> list[tuple[Line, str]]:
    """Lines without those in elements that a name marks as boilerplate.

    Where no article or main element has text beside these, an element that holds most of the page's unlinked text stays.
    """
    size = [max(0, len(text) - line.linked) for line, text in lines]
    held = [0] * events.n_named
    for (line, _), n in zip(lines, size):
        for e in line.named:
            held[e] += n
    least = sum(size) * (1 if any(line.within_article and not line.named for line, _ in lines) else MOST)
    return [(line, text) for line, text in lines if all(held[e] > least for e in line.named)]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, joined by an empty line."""
    if not html:
        return ""
    events = Events()
    for start in range(0, len(html), CHUNK):
        events.feed(html[start : start + CHUNK])
    events.close()
    lines = _spared(events, [(line, text) for line in events.lines if (text := line.text)])
    if not lines:
        return ""
    ratio = smoothed(np.array([len(text) / max(1, line.tags) for line, text in lines]))
    content = ratio >= threshold(ratio)
    weight = [0.0] * len(events.parents)
    for (line, text), good in zip(lines, content.tolist()):
        weight[line.container] += len(text) if good else OTHER * len(text)
    region, named = _region(events, weight)
    return "\n\n".join(
        text for (line, text), good in zip(lines, content.tolist())
        if line.container in region and (named or good or 2 * line.linked < len(text))
    )


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every row with ``text``, the main text of its page, and ``n_chars``, its code points.

    Lines are the stretches between block elements.  What elements, roles and names mark as menus, headers, footers,
    side bars, notices, adverts, forms or comments is left out at once; a name alone does not count where the element holds
    most of the text of a page without another article.  Over the other lines the ratio of text to
    tags is smoothed by a Gaussian and split into two clusters; the container that holds the content cluster (an
    article or main element if there is one) is the region, all its lines are the text.  Lines made of links count
    only where the region is not marked as an article.  Null and empty pages give an empty text; long pages are
    parsed piece by piece; nothing is cut.  Rows are read on their own; input columns named like results are
    replaced.
    """
    def worker(batches: Batches) -> Batches:
        for batch in batches:
            texts = [main_text(h) for h in strings(batch, html)]
            yield appended(batch, text=pa.array(texts, pa.string()),
                           n_chars=pa.array([len(t) for t in texts], pa.int64()))

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return append_columns(pages, fields, worker)
