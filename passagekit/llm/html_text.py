"""Main text of web pages.

A page is read as a flat list of text blocks. A decision tree tells the article's blocks from the
others by the number of words and the link density of a block and of its neighbours, by whether it is a
heading, and by what the names around it (semantic elements, words of class, id and role) are worth.
Nothing is decided before the tree: what a name is worth is learned too, from the same small table of
labelled pages. A name that the table does not have is worth nothing, so blocks among
unknown names are told apart by their words and links.

Markup is read in one pass, in time linear in the page whatever the page holds.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import import_on_workers, table, text_of

# Names of elements.
RAW = "script style noscript template title textarea iframe svg math object select button".split()
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr link meta"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
SEMANTIC = "article main nav header footer aside form dialog menu figcaption head".split()

# The labelled table: blocks of example pages in page order. A block has the elements around it with words
# of their attributes, its words, the share of them in links, and whether it is main text.
LABELLED = """
nav ul li | 1 | 1 | 0
nav ul li | 2 | 1 | 0
div.ad | 8 | 0 | 0
article h1 | 9 | 0 | 1
article p | 60 | 0 | 1
article p | 1 | 0 | 1
article p | 2 | 0 | 1
article p | 300 | 0.1 | 1
footer | 14 | 0 | 0

header h1 | 3 | 1 | 0
header p | 6 | 0 | 0
nav li | 1 | 1 | 0
main h1 | 4 | 0 | 1
main p | 35 | 0 | 1
main h2 | 1 | 0 | 1
main p | 90 | 0.2 | 1
main p | 12 | 1 | 1
main p | 40 | 0 | 1
aside h3 | 1 | 0 | 0
aside li | 7 | 1 | 0
aside p | 30 | 0 | 0
footer p | 40 | 0 | 0

div.menu li | 1 | 1 | 0
div.menu li | 1 | 1 | 0
h1 | 2 | 0 | 1
p | 45 | 0 | 1
p | 3 | 0 | 1
p | 80 | 0.1 | 1
h2 | 2 | 0 | 1
p | 25 | 0 | 1
div.footer | 12 | 0 | 0

div a | 1 | 1 | 0
div a | 1 | 1 | 0
div | 3 | 0 | 0
div a | 2 | 1 | 0
div h1 | 7 | 0 | 1
div p | 120 | 0 | 1
div p | 1 | 0 | 1
div p | 1 | 0 | 1
div p | 18 | 0.5 | 1
div p | 33 | 0 | 1
div a | 3 | 1 | 0
div a | 4 | 1 | 0
div | 5 | 0 | 0
div a | 2 | 1 | 0

article header h1 | 6 | 0 | 1
article header p | 4 | 0.5 | 1
article p | 70 | 0 | 1
article div.ad.advert.advertisement | 25 | 0 | 0
article p | 15 | 0 | 1
article div.share.social.sharing | 4 | 1 | 0
article section.comments h3 | 2 | 0 | 0
article section.comments p | 20 | 0 | 0
article div.comment.reply p | 60 | 0 | 0
article div.comment-list p | 30 | 0 | 0
article div.related.recommended li | 6 | 1 | 0

nav li | 2 | 1 | 0
article h1 | 1 | 0 | 1
article p | 21 | 0 | 1
article p | 3 | 0 | 1
article p | 1 | 0 | 1
nav.related li | 5 | 1 | 0
article p | 4 | 0 | 1
aside.related li | 6 | 1 | 0
main p | 2 | 0 | 1
div.related li | 4 | 1 | 0

header.masthead.banner div | 2 | 0 | 0
form.search.login.signup | 9 | 0 | 0
div.cookie.cookies.notice.consent p | 22 | 0 | 0
div.content.post h1 | 5 | 0 | 1
div.content p | 50 | 0 | 1
div.post.entry p | 4 | 0 | 1
div.content p | 8 | 0 | 1
div.content div.sponsored.promo.promotion | 45 | 0 | 0
div.content p | 64 | 0.05 | 1
div.sidebar.widget h3 | 2 | 0 | 0
div.sidebar p | 55 | 0 | 0
div.newsletter.subscribe.popup p | 18 | 0 | 0
div.copyright.legal.contentinfo | 30 | 0.2 | 0

div.breadcrumb.breadcrumbs.navigation.navbar | 4 | 0.8 | 0
div.social-science h1 | 6 | 0 | 1
div.social-science p | 55 | 0 | 1
div.social-science p | 40 | 0 | 1
div.social-science p | 75 | 0.1 | 1
div.trending.popular.tags li | 2 | 1 | 0
div.pagination.pager | 3 | 1 | 0
div.site-footer | 11 | 0 | 0
div.ad-slot | 9 | 0 | 0

div.page.site.wrapper a | 1 | 1 | 0
div.page.site.wrapper a | 2 | 1 | 0
div.page.site.wrapper | 8 | 0 | 0
div.page.site.container h1 | 7 | 0 | 1
div.page.site.container p | 52 | 0 | 1
div.site.list li | 6 | 0 | 1
div.site.list li | 11 | 0 | 1
div.page.section.text p | 2 | 0 | 1
div.page.section.text p | 9 | 0 | 1
div.page.section p | 31 | 0.3 | 1
div.page h3 | 2 | 0 | 0
div.page.list li | 5 | 1 | 0
div.page.list li | 6 | 1 | 0
div.site-footer | 9 | 0.3 | 0

a | 1 | 1 | 0
a | 1 | 1 | 0
h2 | 6 | 0 | 1
p | 41 | 0 | 1
p | 7 | 0 | 1
a | 8 | 1 | 1
p | 22 | 0 | 1
h3 | 2 | 0 | 0
li | 9 | 1 | 0
li | 8 | 1 | 0
p | 10 | 0 | 0
li | 12 | 1 | 0
h3 | 3 | 0 | 0
li | 7 | 1 | 0

header h1 | 3 | 0 | 0
header p | 9 | 0 | 0
div.header p | 24 | 0 | 0
article header h1 | 5 | 0 | 1
article div.header p | 14 | 0 | 1
article p | 66 | 0 | 1
footer.post-footer | 30 | 0 | 0

div a | 2 | 1 | 0
div a | 3 | 1 | 0
p | 44 | 0 | 1
p | 13 | 1 | 1
p | 16 | 0 | 1
li | 8 | 0 | 1
p | 12 | 1 | 1
p | 9 | 0 | 1
p | 14 | 1 | 1
p | 20 | 0 | 1
p | 6 | 0 | 1
p | 9 | 1 | 1
p | 5 | 0 | 1
p | 95 | 0 | 1
a | 9 | 1 | 0
a | 12 | 1 | 0
a | 6 | 1 | 0

a | 3 | 1 | 0
p | 70 | 0 | 1
a | 9 | 1 | 1
p | 11 | 0 | 1
a | 4 | 1 | 0
a | 8 | 1 | 0
p | 33 | 0 | 1

div.header h2 | 4 | 0 | 0
div.site-header p | 16 | 0 | 0
p | 38 | 0 | 1
p | 5 | 0 | 1

div.social.share li | 1 | 1 | 0
div.social.follow | 5 | 0.4 | 0
div.social | 3 | 0 | 0
div.social.icons li | 2 | 1 | 0
div.toolbar.skip | 3 | 1 | 0
div.comment-list p | 26 | 0 | 0
div.reviews-list p | 30 | 0 | 0
div.widget-text p | 33 | 0 | 0

div.alert.dialog.modal.overlay | 12 | 0 | 0
div.hidden | 35 | 0 | 0
div | 2 | 0 | 0
div li | 1 | 1 | 0
div li | 1 | 1 | 0
main p | 19 | 0 | 1
main li | 3 | 1 | 0
main li | 5 | 1 | 0
main li | 4 | 1 | 0
aside article h3 | 6 | 1 | 0
aside article p | 16 | 0 | 0
div.respond.replies.discussion.reviews.disqus p | 28 | 0 | 0
figcaption | 7 | 0 | 0
menu li | 2 | 1 | 0
dialog p | 12 | 0 | 0
form p | 16 | 0 | 0
"""  # fmt: skip

#: What the tree sees of a block.
FEATURES = (
    "words", "words_before", "words_after", "links", "links_before", "links_after", "heading", "inner", "low", "high",
)
#: Below this a word of an attribute outweighs the element that it stands on.
TELLING = -0.75


@dataclass
class Node:
    """A leaf with a label, or a cut of one feature with the branches below and above it."""

    label: bool
    feature: int = -1
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None

    def marks(self, rows: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(rows), self.label)
        low = rows[:, self.feature] <= self.cut
        return np.where(low, self.below.marks(rows), self.above.marks(rows))

    def used(self) -> set[str]:
        """Names of the features that are cut."""
        if self.feature < 0:
            return set()
        return {FEATURES[self.feature]} | self.below.used() | self.above.used()


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> Node:
    """A decision tree by the largest fall of the Gini impurity; ties by feature and cut."""
    leaf = Node(bool(2 * labels.sum() >= len(labels)))
    if not depth or labels.all() or not labels.any():
        return leaf
    best = (1e-12, -1, 0.0)
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= cut
            parts = (labels[low], labels[~low])
            fall = _gini(labels) - sum(len(p) / len(labels) * _gini(p) for p in parts)
            if fall > best[0] + 1e-12:
                best = (fall, feature, float(cut))
    _, feature, cut = best
    if feature < 0:
        return leaf
    low = rows[:, feature] <= cut
    return Node(leaf.label, feature, cut, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def _gini(labels: np.ndarray) -> float:
    share = labels.mean()
    return 2 * share * (1 - share)


#: Names around a block: per telling element its own name (empty if not semantic) and the words of each attribute value.
Names = tuple[str, tuple[tuple[str, ...], ...]]
Evidence = tuple[float, float, float]


@dataclass
class Block:
    text: str
    words: int
    links: float
    heading: bool
    #: Worth of the names around it: of the innermost element with any worth, the least and the greatest.
    names: Evidence


NOTHING: Evidence = (0.0, 0.0, 0.0)


def within(around: Evidence, value: float) -> Evidence:
    """The evidence inside an element of the given worth."""
    if not value:
        return around
    return (value, value, value) if around == NOTHING else (value, min(around[1], value), max(around[2], value))


@dataclass
class Model:
    """What names are worth, from -1 (never around main text) to 1 (always), and the tree over ``FEATURES``."""

    worth: dict[str, float]
    tree: Node = field(default_factory=lambda: Node(False))

    def value(self, names: Names) -> float:
        """Of one element. Where a value of an attribute has a bad word, good ones beside it do not count."""
        element, values = names
        own = self.worth.get(element, 0.0)
        found = [self._mean(words) for words in values]
        attributes = min(found, default=0.0)
        if attributes >= 0:
            attributes = max(found, default=0.0)
        return attributes if attributes <= TELLING or not own else own

    def _mean(self, words: tuple[str, ...]) -> float:
        known = [self.worth.get(w, 0.0) for w in words]
        bad, unknown = [v for v in known if v < 0], known.count(0.0)
        chosen = bad or [v for v in known if v > 0]
        return sum(chosen) / (len(chosen) + unknown) if chosen else 0.0

    def block_of(self, example: Example) -> Block:
        names = NOTHING
        for each in example.around:
            names = within(names, self.value(each))
        return Block("", example.words, example.links, example.heading, names)

    def features(self, every: list[Block]) -> np.ndarray:
        """A row for each block of a page."""
        words = np.array([0, *(b.words for b in every), 0], dtype=float)
        links = np.array([0, *(b.links for b in every), 0], dtype=float)
        heading = np.array([b.heading for b in every], dtype=float)
        names = np.array([b.names for b in every], dtype=float).reshape(-1, 3)
        shallow = [words[1:-1], words[:-2], words[2:], links[1:-1], links[:-2], links[2:], heading]
        return np.column_stack([*shallow, names])

    def marks(self, every: list[Block]) -> np.ndarray:
        """Whether each block of a page is main text."""
        return self.tree.marks(self.features(every)) if every else np.zeros(0, dtype=bool)


@dataclass
class Example:
    """A block of the labelled table, with the names of the elements around it."""

    around: list[Names]
    words: int
    links: float
    heading: bool
    main: bool


def labelled_pages(text: str = LABELLED) -> list[list[Example]]:
    """The examples of each page of a table written as ``LABELLED``."""
    pages = []
    for page in text.strip().split("\n\n"):
        rows = []
        for line in page.splitlines():
            path, words, links, label = (part.strip() for part in line.split("|"))
            elements = [e.split(".") for e in path.split()]
            around = [n for n in (_names(name, values) for name, *values in elements) if n]
            rows.append(Example(around, int(words), float(links), elements[-1][0] in _HEADINGS, label == "1"))
        pages.append(rows)
    return pages


def train(pages: list[list[Example]] | None = None) -> Model:
    """The model of labelled pages. A block says what the innermost names around it are worth."""
    pages = labelled_pages() if pages is None else pages
    good, bad = Counter(), Counter()
    for example in (e for page in pages for e in page):
        if example.around:
            element, values = example.around[-1]
            (good if example.main else bad).update({element, *(w for words in values for w in words)} - {""})
    model = Model({w: (good[w] - bad[w]) / (good[w] + bad[w]) for w in good | bad})
    rows = np.concatenate([model.features([model.block_of(e) for e in page]) for page in pages])
    model.tree = grow(rows, np.array([e.main for page in pages for e in page]))
    return model


_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"""=\s*(["'])|>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_LONG_NUMBER = re.compile(r"&#([0-9]{8,})")
_RAW, _INLINE, _VOID, _SEMANTIC = set(RAW), set(INLINE), set(VOID), set(SEMANTIC)
_HEADINGS = {f"h{i}" for i in range(1, 7)}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Elements whose end tag may be missing without the rest of the page belonging to them.
_MAY_STAY_OPEN = set("svg math object select button noscript template".split())


def _names(element: str, values: Iterable[str]) -> Names | None:
    """The names of an element, None if it has none."""
    words = tuple(tuple(w.lower() for w in _WORDS.findall(v)) for v in values)
    words = tuple(w for w in words if w)
    element = element if element in _SEMANTIC else ""
    return (element, words) if element or words else None


def names_of(element: str, attributes: str) -> Names | None:
    """The names of an element by its tag; what can't be seen has the word ``hidden``."""
    values: list[str] = []
    for match in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = match[1].lower(), (match[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            values += value.split()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            values.append("hidden")
        elif name == "style" and _INVISIBLE.search(value):
            values.append("hidden")
    return _names(element, values)


def plain(text: str) -> str:
    """The text with its character references decoded."""
    if "&#" in text:
        # Numbers beyond any character, which may have any number of digits, are one such number.
        text = _LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0") or "0")[:8], text)
    return html.unescape(text)


def blocks(page: str, model: Model) -> list[Block]:
    """The text blocks of a page in order, without scripts, styles, comments of the source and markup.

    A tag ends at the first ``>`` outside quoted values. From the first tag on whose quotes do not
    pair up until the page ends, quotes are ignored. A tag that never ends is dropped with what follows.
    """
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    #: Open block elements with the evidence inside each, and how many of each are open.
    stack: list[tuple[str, Evidence]] = []
    opened: Counter[str] = Counter()
    never_end: set[str] = set()
    in_link = heading = False
    quotes = True

    def close_block() -> None:
        nonlocal parts
        if parts:
            text = " ".join(plain("".join(t for t, _ in parts)).split())
            if text:
                words = text.count(" ") + 1
                linked = len(plain(" ".join(t for t, link in parts if link)).split())
                found.append(Block(text, words, min(1.0, linked / words), heading, stack[-1][1] if stack else NOTHING))
            parts = []

    def tag_end(at: int) -> int:
        nonlocal quotes
        start = at
        while quotes:
            stop = _QUOTE_OR_END.search(page, at)
            if stop and not stop[1]:
                return stop.start()
            at = page.find(stop[1], stop.end()) + 1 if stop else 0
            quotes = at > 0
        return page.find(">", start)

    at, end = 0, len(page)
    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            parts.append((page[at:], in_link))
            break
        if begin > at:
            parts.append((page[at:begin], in_link))
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith(("<!", "<?"), begin):
            stop = page.find(">", begin)
            at = stop + 1 if stop >= 0 else end
            continue
        match = _NAME.match(page, begin)
        if not match:
            parts.append(("<", in_link))
            at = begin + 1
            continue
        stop = tag_end(match.end())
        if stop < 0:
            break
        closing, name, attributes = match[1], match[2].lower(), page[match.end() : stop]
        at = stop + 1
        if name in _RAW:
            if not closing and name not in never_end and not (name in ("svg", "math") and attributes.endswith("/")):
                last = _RAW_END[name].search(page, at)
                if last:
                    at = last.start()
                elif name in _MAY_STAY_OPEN:
                    never_end.add(name)
                else:
                    at = end
            continue
        if name in _INLINE:
            if name == "a":
                in_link = not closing
            continue
        if name == "br":
            parts.append((" ", in_link))
            continue
        close_block()
        heading = name in _HEADINGS and not closing
        if name in _VOID:
            continue
        if closing:
            if opened[name]:
                while True:
                    last, _ = stack.pop()
                    opened[last] -= 1
                    if last == name:
                        break
                in_link = False
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
            opened["p"] -= 1
        around = stack[-1][1] if stack else NOTHING
        names = None if name in ("html", "body") else names_of(name, attributes)
        stack.append((name, within(around, model.value(names)) if names else around))
        opened[name] += 1
    close_block()
    return found


def main_text(page: str, model: Model) -> str:
    """Text of the blocks that the model takes for main text, joined by blanks."""
    every = blocks(page, model)
    return " ".join(b.text for b, main in zip(every, model.marks(every), strict=True) if main)


def extracted(html_col: str = "html", model: Model | None = None) -> Column:
    """Main text of a column of pages; null counts as an empty page."""
    model = model or train()

    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), model) for p in pages], pa.string())

    return of(text_of(html_col))


def with_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", model: Model | None = None) -> DataFrame:
    """``pages`` with the main text in ``out_col``, empty if there is none.

    Null and empty pages have none. Repeated rows are treated alike; other columns are carried
    along, one named ``out_col`` is overwritten.
    """
    import_on_workers(pages.sparkSession)
    return pages.withColumn(out_col, extracted(html_col, model))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    done = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    # Its length is taken from what the function returned, in a step of its own.
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
