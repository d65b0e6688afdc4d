"""Main text of web pages: parser events, text-to-tag ratio, smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that start a new block, elements without an end tag, elements that are never article text.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("""applet aside audio button canvas datalist dialog footer frameset head header iframe input
label map math menu nav noembed noframes noscript object script select style svg template textarea title video""".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body head html option optgroup title".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|captcha|comments?|consent|cookies?|disqus|disclaimer|footer|gdpr|"
    r"header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|outbrain|pagination|pager|paywall|"
    r"popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|taboola|"
    r"toolbar|widget)(?:$|[\s_-])", re.IGNORECASE)
# Words in the class or id of an article element that make it a comment or an advert, whatever else it is called.
NOT_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|promo\w*|related|replies|sponsor\w*)(?:$|[\s_-])", re.IGNORECASE)
# Words that name what their element holds; the other boilerplate words also name layouts that wrap a whole page.
NEVER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|breadcrumbs?|captcha|comments?|consent|cookies?|disqus|disclaimer|footer|gdpr|newsletter|"
    r"notices?|notification|outbrain|pagination|pager|promo\w*|related|replies|respond|signup|sponsor\w*|taboola)(?:$|[\s_-])",
    re.IGNORECASE)
# Classes that say what a page or article has, and the header of an article: no boilerplate.
MODIFIER = re.compile(r"(?:^|(?<=\s))(?:(?:has|no|with|without)[_-]\S*|(?:article|entry|post|story)[_-]+header(?=\s|$))", re.IGNORECASE)
# Elements that are left out on their own, but are part of the sentence they stand in inside these blocks.
INLINE = frozenset("button label math object".split())
PARAGRAPHS = frozenset("blockquote dd figcaption h1 h2 h3 h4 h5 h6 li p pre td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLE_LINES = 3         # a title may have so many lines (a subtitle, an author) between it and the text
CONTROLS = frozenset("button datalist input label select textarea".split())
CONTROL_CHARS = 40      # a control that shows counts as so much text of its form
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SPACE = re.compile(r"\s+")


class _Wrapper:
    """An element that is left out unless its text shows that it holds the content."""

    def __init__(self, form: bool, never: bool, comments: bool, main: bool = False) -> None:
        self.form, self.never, self.comments, self.main = form, never, comments, main
        self.text = self.controls = 0


class _Open(NamedTuple):
    """An open element and what holds for everything in it."""

    tag: str = ""
    skipped: bool = False
    article: int = 0                        # number of the outermost marked article, from 1
    wrappers: tuple[_Wrapper, ...] = ()
    around: int = 0                         # how many of them were open around that article
    link: bool = False
    control: bool = False
    form: bool = False
    paragraph: bool = False
    block: str = ""                         # the innermost block element


class Line(NamedTuple):
    """A block of the page: its text, the tags met in it, its article, whether it is mostly links, and its element."""

    text: str
    tags: int
    article: int
    links: bool
    block: str


class _Blocks(HTMLParser):
    """Collects the blocks of a page in order, each with its text, the tags met in it and where it stands."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.counts: Counter[str] = Counter()
        self.found: list[tuple[list, int, _Open]] = []   # (parts, number of tags, state)
        self.blocks: list[Line] = []
        self.parts: list[tuple[str, _Open]] = []
        self.tags = self.total = self.articles = 0

    def state(self) -> _Open:
        return self.open[-1] if self.open else _Open()

    def flush(self) -> None:
        if self.parts or self.tags:
            self.found.append((self.parts, self.tags, self.state()))
            self.parts, self.tags = [], 0

    def cut(self, i: int) -> None:
        """Close the elements from the i-th on."""
        self.counts.subtract(o.tag for o in self.open[i:])
        del self.open[i:]

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ENDS_PARAGRAPH:
            self._end_paragraph()
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append((" ", _Open()))
        self.tags += 1
        if tag in CONTROLS and tag != "label" and (dict(attrs).get("type") or "").lower() != "hidden":
            self._count_controls(CONTROL_CHARS)
        if tag in VOID:
            return
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close_same(tag)
        now = self.state()
        main = tag in ("article", "main") or dict(attrs).get("role") in ("main", "article")
        outermost = main and not now.article
        self.articles += outermost
        left_out = tag in SKIPPED and not (tag == "header" and now.article) and not (tag in INLINE and now.paragraph and not now.form)
        skipped = now.skipped or left_out or self._hidden(tag, attrs)
        wrappers, around = now.wrappers, now.around
        if not skipped:
            wrapper = self._wrapper(tag, attrs, outermost)
            wrappers += (wrapper,) if wrapper else ()
            if outermost and not any(w.comments for w in wrappers):
                around = len(wrappers)
        self.counts[tag] += 1
        self.open.append(_Open(
            tag, skipped, self.articles if outermost else now.article, wrappers, around, now.link or tag == "a",
            now.control or tag in CONTROLS, now.form or tag == "form", (now.paragraph and tag not in BLOCKS) or tag in PARAGRAPHS,
            tag if tag in BLOCKS else now.block))

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in VOID or not self.counts[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self.cut(i)
                break
            # A stray end tag doesn't close the region that it stands in.
            if self.open[i].tag in ("article", "main", "body", "table", "td") and tag not in ("article", "main", "body", "html", "table"):
                break

    def handle_data(self, data) -> None:
        now = self.state()
        if now.skipped:
            if now.control and any(w.form for w in now.wrappers):
                self._count_controls(len(data.strip()))
            return
        self.parts.append((data, now))
        size = len(data.strip())
        self.total += size
        for w in now.wrappers:
            w.text += size

    def _count_controls(self, size) -> None:
        for w in self.state().wrappers:
            w.controls += size

    def _hidden(self, tag, attrs) -> bool:
        if tag in ("html", "body"):
            return False
        found = dict(attrs)
        return found.get("role") in ROLES or "hidden" in found or found.get("aria-hidden") == "true"

    def _wrapper(self, tag, attrs, main) -> _Wrapper | None:
        if tag in ("html", "body"):
            return None
        found = dict(attrs)
        names = [MODIFIER.sub("", found.get(k) or "") for k in ("class", "id")]
        pattern = NOT_ARTICLE if main else BOILERPLATE
        if any(pattern.search(n) for n in names):
            return _Wrapper(False, any(NEVER.search(n) for n in names), any(NOT_ARTICLE.search(n) for n in names), main)
        return _Wrapper(True, False, False) if tag == "form" else None

    def _holds_content(self, w: _Wrapper) -> bool:
        """A form does if it has more text than controls, any other wrapper if it has most of the page's text; one whose
        name says what else it holds doesn't, unless it is marked as an article itself."""
        return w.text > w.controls if w.form else (w.main or not w.never) and 2 * w.text > self.total

    def _settle(self) -> None:
        """Leave out what stands in wrappers. If that takes every article, articles reopen the wrappers around them."""
        holds = {w: self._holds_content(w) for parts, _, _ in self.found for _, o in parts for w in o.wrappers}
        for reopen in (False, True):
            self.blocks = []
            for parts, tags, at in self.found:
                kept = [p for p in parts if all(holds[w] for w in p[1].wrappers[p[1].around if reopen else 0:])]
                text = SPACE.sub(" ", "".join(p[0] for p in kept)).strip()
                links = 2 * sum(len(p[0]) for p in kept if p[1].link) > len(text)
                self.blocks.append(Line(text, tags, at.article, links, at.block))
            if any(b.text and b.article for b in self.blocks) or not any(o.around for parts, _, _ in self.found for _, o in parts):
                return

    def _end_paragraph(self) -> None:
        """A block start ends an open paragraph, with the inline elements left open in it."""
        if not self.counts["p"]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i].tag
            if tag == "p":
                self.flush()
                self.cut(i)
                return
            if tag in BLOCKS:
                return

    def _close_same(self, tag) -> None:
        same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
        if not any(self.counts[t] for t in same):
            return
        for i in range(len(self.open) - 1, -1, -1):
            other = self.open[i].tag
            if other == tag or (tag in ("dt", "dd") and other in ("dt", "dd")) or (tag in ("td", "th") and other in ("td", "th")):
                self.cut(i)
                return
            if other in ("ul", "ol", "dl", "table", "select", "menu"):
                return

    def close(self) -> None:
        super().close()
        self.flush()
        self._settle()


def smoothed(values: np.ndarray, radius: int) -> np.ndarray:
    """A Gaussian of width ``radius`` over the lines; at the ends only the lines that exist have weight."""
    kernel = np.exp(-0.5 * (np.arange(-2 * radius, 2 * radius + 1) / radius) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, "same") if len(values) >= len(kernel) else None
    if weight is None:
        at = np.arange(len(values))
        near = np.exp(-0.5 * ((at[:, None] - at) / radius) ** 2)
        return near @ values / near.sum(1)
    return np.convolve(values, kernel, "same") / weight


def _is_marked(lines: list[Line]) -> bool:
    """Whether the marked articles of a page are its text: they have most of it, or the main heading."""
    inside = sum(len(x.text) for x in lines if x.article)
    return 2 * inside >= sum(len(x.text) for x in lines) or any(x.article and x.block == "h1" for x in lines)


def content_lines(lines: list[Line], radius: int = 1) -> list[bool]:
    """Which lines are content, by the smoothed ratios of their text to the tags met in them.

    The threshold is the standard deviation of the smoothed ratios, at most their mean. Marks shift a line's score: up by the
    mean in the articles of a page that has its text in articles, down by twice the mean outside of them; a line that is
    mostly links has score 0 there and on other pages. Lines that reach the threshold cluster into regions.
    """
    ratios = np.array([len(x.text) / max(x.tags, 1) for x in lines])
    smooth = smoothed(ratios, radius)
    threshold = min(smooth.std(), smooth.mean())
    marked = _is_marked(lines)
    inside = np.array([marked and x.article > 0 for x in lines])
    score = np.where(np.array([x.links for x in lines]) & ~inside, 0.0, smooth)
    # A marked article beside the text is a teaser: long neighbours don't lift its short lines.
    score = np.where(np.array([x.article > 0 for x in lines]) & ~inside, np.minimum(score, ratios), score)
    if marked:
        score = score + np.where(inside, smooth.mean(), -2 * smooth.mean())
    content = (score >= threshold) & (score > 0)
    at = np.flatnonzero(content)
    if len(at):
        # Between two regions of a page without a marked article stand its short lines and paragraphs that are links.
        keep = [not x.links or x.block in PARAGRAPHS - {"li", "td"} for x in lines]
        first = _title(lines, at[0])
        for i in range(first, at[0]) if marked else range(first, at[-1]):
            content[i] |= keep[i]
    return content.tolist()


def _title(lines: list[Line], first: int) -> int:
    """Where the text begins, with the main heading a few lines before it or another heading right before it."""
    for i in range(first - 1, max(first - 2 - TITLE_LINES, -1), -1):
        if lines[i].block == "h1":
            return i
    return first - 1 if first and lines[first - 1].block in HEADINGS else first


def main_text(html: str | None, radius: int = 1) -> str:
    """The article of one page.

    Each block is a line. Content regions come from text-to-tag ratios, a Gaussian over neighbouring lines and a threshold
    (``content_lines``); nothing in a region is cut. Elements with boilerplate names and forms are left out before, unless
    they hold the content (see ``_Blocks._holds_content``) or the only article. A page of links alone is "". Very long pages
    are read whole, in time in proportion to their length; elements may be nested as deep as they like.
    """
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    lines = [b for b in parser.blocks if b.text]
    if not lines:
        return ""
    return "\n".join(line.text for line, keep in zip(lines, content_lines(lines, radius)) if keep)


def _main_text(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` to every page, one row in, one row out.

    Null, empty and markup-only pages have the text "". Repeated pages are extracted each; an empty table stays empty.
    Input columns named text or n_chars are replaced.
    """
    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    return (pages.select(*own, F.pandas_udf(_main_text, "string")(html).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
