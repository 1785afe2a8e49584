"""Main text of web pages by tag-path ratios.

Every text node has a tag path, from the root to its element (tags with their classes). Per path the
text length and the punctuation of all its nodes are added up; the ratios of these to the number of
nodes tell prose, which comes in long punctuated nodes on one path, from menus and notices. The
ratios are put in page order, smoothed over neighbouring blocks, fused into one score and compared
with one threshold that depends on the page. All blocks are scored alike; an article or main element
only raises the scores in it. Headings and, in an article, short list items, cells, quotes and the
like, which are too short for ratios, go with the blocks next to them. Classes and ids that name
other parts of a page lower the scores in their elements; long punctuated prose can win against them.
So do forms, unless they are wrapped around an article or most of the page. Only elements that never
hold an article (scripts, controls, navigation and the like, by tag or role) and hidden ones are left
out before.

Paths are numbers in a table of (parent path, label), so memory grows with the elements of a page and
not with their depth.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekeep.llm.common import col, slices, text_column

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li"
    " main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead"
    " title tr ul".split()
)
# an opening tag ends these open elements
CLOSES = {
    **{t: ("p",) for t in BLOCK - {"option", "optgroup", "legend", "caption", "body", "html"}},
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "tbody": ("thead", "tbody", "tr", "td", "th", "p"),
    "tfoot": ("thead", "tbody", "tr", "td", "th", "p"),
    "option": ("option",),
    "body": ("head",),
}
# a search for an element to end stops here
SCOPES = frozenset("table ul ol dl select div article section main body html td th".split())
STOPS = {
    "li": frozenset(("ul", "ol", "menu")),
    "dt": frozenset(("dl",)),
    "dd": frozenset(("dl",)),
    "tr": frozenset(("table",)),
    "td": frozenset(("table", "tr")),
    "th": frozenset(("table", "tr")),
    "tbody": frozenset(("table",)),
    "tfoot": frozenset(("table",)),
}
# elements that hold no article text
NEVER = frozenset(
    "script style noscript template svg math canvas object embed iframe head title meta nav footer"
    " aside button select textarea input menu audio video map xmp noembed noframes datalist".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog menu menubar toolbar"
    " tooltip status".split()
)
# elements and roles that hold controls, but may be wrapped around all of a page
FORMS = frozenset("form fieldset label dialog".split())
# names of parts of a page that are no article; compared with the words of class and id
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner bottombar breadcrumb"
    " breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright"
    " dialog disclaimer discussion disqus donate feedback flash follow footer form gdpr header"
    " login masthead menu menus modal nav navbar navigation newsletter notice notices notification"
    " overlay pager pagination paywall popup popups promo promos promotion recommendations"
    " recommended related replies reply respond review reviews rail search share sharing sidebar"
    " sidebars signup skip social sponsor sponsored subscribe subscription tagcloud taboola"
    " toolbar topbar tracking widget widgets warning outbrain".split()
)
# those of them that as often name something in an article, such as a section on reviews
AMBIGUOUS = frozenset(
    "banner copyright dialog disclaimer discussion donate feedback flash follow form header notice"
    " notices promotion rail recommendations recommended related reply replies respond review reviews"
    " search subscription tracking warning".split()
)
# words that only say where a part stands
PLACES = frozenset(
    "site page global top bottom left right upper lower post article entry user reader blog news web"
    " the my main primary secondary inner outer sticky fixed mobile desktop js wp td tc block"
    " section area box container wrapper wrap holder list item module panel bar slot unit row col"
    " content body thread".split()
)
UNLIKE = ("has", "with", "no", "without", "is", "not")
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# short by nature: in an article such blocks go with the prose that they stand beside
ITEMS = frozenset("li dt dd td th caption figcaption pre blockquote".split())
ATTRIBUTES = frozenset(("class", "id", "role", "hidden", "style", "aria-hidden"))

PUNCTUATION = frozenset(".,;:!?…。，、；：！？·¿¡\"'“”‘’«»()-–—")
SMOOTHING = (0.25, 0.5, 1.0, 0.5, 0.25)
THRESHOLD = 0.25  # of the page's usual score
RAISED = 8.0  # times the score where an element says that it is the article
NAMED, PERHAPS = 0.1, 0.4  # times the score where a name tells of another part, or may do so
LINKED = 0.5  # share of a path's text in links from which on it is a list of links

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
# a whole attribute: its name up to white space, / or =, and its value
_ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s+")


def _judged_attributes(attributes: str) -> list[tuple[str, str]]:
    """The attributes of a tag that tell what it is; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ATTRIBUTES and name not in found:
            if value[:1] in ("'", '"'):
                value = value[1:-1]
            found[name] = html.unescape(value)
    return list(found.items())


def _lowered(name: str) -> float:
    """What a class or id leaves of the scores in its element: 1 if it names no other part."""
    words = [w.lower() for w in _NAME_WORDS.findall(name)]
    if not words or words[0] in UNLIKE:
        return 1.0
    telling = [w for w in words if w not in PLACES and not w.isdigit()]
    if not telling or not (telling[0] in PARTS or telling[-1] in PARTS):
        return 1.0
    return NAMED if any(w in PARTS and w not in AMBIGUOUS for w in telling) else PERHAPS


def _names_part(name: str) -> bool:
    """Whether a class or id names a part of the page that is no article."""
    return _lowered(name) < 1


def _made_from(name: str, text: str) -> bool:
    """Whether an id is made from the first words of a text, as anchors of headings are."""
    wanted, start = "".join(_WORD.findall(name.lower())), ""
    for word in _WORD.findall(text[: 4 * len(name) + 20].lower()):
        start += word
        if len(start) >= len(wanted):
            break
    return start == wanted


class _Mark:
    """What a name leaves of the scores in its element; an id counts once its text is known."""

    __slots__ = ("factor", "id", "above")

    def __init__(self, factor: float, ident: str, above: _Mark | None):
        self.factor, self.id, self.above = factor, ident, above


class _Paths:
    """The tag paths of a page, by number; parents come before their children."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.parents = [0]
        self.factors: list[list[_Mark] | None] = [None]  # from names of its own element
        self.ids: list[_Mark | None] = [None]  # the innermost mark of an id, here or above
        self.forms: dict[int, bool] = {}  # forms, and whether they hold an article
        self.form = [0]  # the innermost form, here or above
        self.sizes = [0]  # of the text on the path

    def number(self, parent: int, label: str, own: list[tuple[float, str]], form: bool) -> int:
        key = parent, label
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.parents)
            self.parents.append(parent)
            self.sizes.append(0)
            marks, chain = [], self.ids[parent]
            for factor, ident in own:
                marks.append(_Mark(factor, ident, chain))
                if ident:
                    chain = marks[-1]
            self.factors.append(marks or None)
            self.ids.append(chain)
            if form:
                self.forms[found] = False
            self.form.append(found if form else self.form[parent])
        return found

    def first_text(self, path: int, text: str) -> None:
        """The text decides the ids above it that had none before."""
        mark = self.ids[path]
        while mark is not None and mark.id:  # above one that is decided all are
            if _made_from(mark.id, text):
                mark.factor = 1.0
            mark.id, mark = "", mark.above

    def holds_article(self, path: int) -> None:
        form = self.form[path]
        while form and not self.forms[form]:
            self.forms[form] = True
            form = self.form[self.parents[form]]

    def finish(self) -> tuple[list[float], list[tuple[int, int]]]:
        """What names and forms leave of the score of each path, and its place and that of the last
        path below it in an order that has each path right before the ones below."""
        inside, below = self.sizes, [1] * len(self.parents)
        for path in range(len(self.parents) - 1, 0, -1):
            inside[self.parents[path]] += inside[path]
            below[self.parents[path]] += below[path]
        left, spans, free = [1.0], [(0, below[0] - 1)], [1] * len(self.parents)
        for path in range(1, len(self.parents)):
            parent = self.parents[path]
            own = [mark.factor for mark in self.factors[path] or ()]
            if path in self.forms and not self.forms[path] and 2 * inside[path] < inside[0]:
                own.append(NAMED)
            left.append(min([left[parent], *own]))
            first = spans[parent][0] + free[parent]
            free[parent] += below[path]
            spans.append((first, first + below[path] - 1))
        return left, spans


class _Element:
    __slots__ = ("tag", "path", "place", "out", "linked", "article", "heading", "item", "quote")

    def __init__(
        self, tag: str, path: int, place: int, out: bool, linked: bool, article: bool, heading: bool,
        item: bool, quote: bool,
    ):
        self.tag, self.path, self.place, self.out = tag, path, place, out
        self.linked, self.article, self.heading, self.item = linked, article, heading, item
        self.quote = quote


class _Block(NamedTuple):
    text: str
    nodes: list[tuple[int, int, int, int]]  # path, length, punctuation, linked length
    place: int  # the path that its element stands in
    article: bool
    heading: bool
    item: bool


class _Blocks:
    """The blocks of a page in order."""

    def __init__(self) -> None:
        self.stack = [_Element("", 0, 0, False, False, False, False, False, False)]
        self.opened: Counter[str] = Counter()  # open elements by tag
        self.parts: list[str] = []
        self.nodes: list[tuple[int, int, int, int]] = []
        self.found: list[_Block] = []
        self.paths = _Paths()

    def end_block(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                top = self.stack[-1]
                self.paths.first_text(self.nodes[0][0], text)
                for path, size, _, _ in self.nodes:
                    self.paths.sizes[path] += size
                self.found.append(
                    _Block(text, self.nodes, top.place, top.article, top.heading, top.item)
                )
            self.parts, self.nodes = [], []

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.out:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        size = len(text.strip())
        if size:
            signs = sum(c in PUNCTUATION for c in text)
            linked = size if top.linked else 0
            if self.nodes and self.nodes[-1][0] == top.path:  # one run of text
                _, *before = self.nodes.pop()
                size, signs, linked = size + before[0], signs + before[1], linked + before[2]
            self.nodes.append((top.path, size, signs, linked))

    def open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag in BLOCK:
                self.end_block()
            return
        if tag in BLOCK:
            self.end_block()
        for other in CLOSES.get(tag, ()):
            if self.opened[other]:
                self._end_implied(other, tag)
        top = self.stack[-1]
        # the foot of a quotation names its source
        out = top.out or (tag in NEVER and not (tag == "footer" and top.quote))
        label, own, form = tag, [], tag in FORMS
        article = top.article or tag in ARTICLE
        if not out and tag == "header" and not top.article:
            out = True
        if attributes and not out:
            for name, value in _judged_attributes(attributes):
                if name == "role":
                    role = value.lower()
                    out = out or role in ROLES
                    article = article or role in ARTICLE
                    if role in FORMS:
                        form, label = True, f"{label}@{role}"
                elif name == "hidden":
                    out = True
                elif name == "aria-hidden":
                    out = out or value.lower() == "true"
                elif name == "style":
                    out = out or re.search(r"display\s*:\s*none", value, re.I) is not None
                else:
                    if name == "class":
                        label += "".join("." + c for c in sorted(value.split()))
                    if tag in ("html", "body", "main", "article"):
                        continue
                    if name == "id" and (top.heading or tag in HEADINGS):
                        continue  # an anchor
                    for one in value.split():
                        if (factor := _lowered(one)) < 1:
                            own.append((factor, one if name == "id" and article else ""))
                            label += f"#{one}" if name == "id" else ""
        # plain inline elements, such as bold words, are of the path around them
        path = top.path
        if tag in BLOCK or form or label != tag:
            path = self.paths.number(path, label, own, form)
        if not out and (tag == "h1" or (article and not top.article)):
            self.paths.holds_article(path)
        self.opened[tag] += 1
        self.stack.append(
            _Element(
                tag,
                path,
                top.path if tag in BLOCK else top.place,
                out,
                top.linked or tag == "a",
                article,
                top.heading or tag in HEADINGS,
                top.item or tag in ITEMS,
                top.quote or tag == "blockquote",
            )
        )

    def _cut(self, height: int) -> None:
        """Leave the elements from this height of the stack on."""
        for element in self.stack[height:]:
            self.opened[element.tag] -= 1
        del self.stack[height:]

    def _end_implied(self, tag: str, by: str) -> None:
        stops = STOPS.get(by, SCOPES)
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._cut(i)
                return
            if self.stack[i].tag in stops:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        if not self.opened[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._cut(i)
                return
            if tag not in BLOCK and self.stack[i].tag in BLOCK:
                return  # an inline end tag does not close blocks


def page_blocks(page: str) -> tuple[list[_Block], list[float], list[tuple[int, int]]]:
    """The blocks outside of excluded elements, what names leave of the score of each path, and the
    span of each path."""
    blocks, at = _Blocks(), 0
    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            break
        if token.start() > at:
            blocks.text(page[at : token.start()])
        at = token.end()
        if token[1]:
            tag = token[1].lower()
            blocks.open(tag, token[2])
            if tag in RAW:  # what follows is no markup up to the end tag
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                blocks.close(tag)
        elif token[3]:
            blocks.close(token[3].lower())
    if at < len(page):
        blocks.text(page[at:])
    blocks.end_block()
    return blocks.found, *blocks.paths.finish()


def _smooth(values: np.ndarray) -> np.ndarray:
    """Weighted mean over neighbouring blocks; at the ends over those there are."""
    weights = np.array(SMOOTHING)
    wide = len(weights) // 2
    total = np.convolve(values, weights)[wide : wide + len(values)]
    return total / np.convolve(np.ones_like(values), weights)[wide : wide + len(values)]


def _beside(
    blocks: list[_Block], scored: list[bool], left: list[float], spans: list[tuple[int, int]]
) -> set[int]:
    """The items of articles that stand beside chosen text: only items and headings are between.

    Items whose names tell against them more than those of the text do not go with it.
    """
    found = set()
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        places: set[tuple[int, float]] = set()
        for i in order:
            block = blocks[i]
            if not block.article or not (block.item or block.heading):
                places = set()
            elif block.item and any(
                left[i] >= own and spans[place][0] <= spans[block.place][0] <= spans[place][1]
                for place, own in places
            ):
                found.add(i)
            if scored[i] and block.article:
                places.add((block.place, left[i]))
    return found


def main_text(page: str) -> str:
    """The blocks of a page whose paths score above the threshold, joined by line feeds."""
    blocks, lowered, spans = page_blocks(page)
    if not blocks:
        return ""
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for block in blocks:
        for path, size, signs, linked in block.nodes:
            one = sums[path]
            one[0] += 1
            one[1] += size
            one[2] += signs
            one[3] += linked
    lengths, signs, links, left = [], [], [], []
    for block in blocks:  # a block stands on the path that holds most of it
        by_path: dict[int, int] = defaultdict(int)
        for path, size, _, _ in block.nodes:
            by_path[path] += size
        path = max(by_path, key=by_path.get)
        left.append(lowered[path])
        n, size, sign, linked = sums[path]
        own, own_linked = sum(x[1] for x in block.nodes), sum(x[3] for x in block.nodes)
        lengths.append(size / n)
        signs.append(sign / n)
        links.append(max(linked / size, own_linked / own))
    length, sign = np.array(lengths), np.array(signs)
    # fused: the path's own ratios and those around it, length and punctuation together
    plain = np.sqrt(length * (1 + sign))
    fused = 0.5 * plain + 0.5 * _smooth(plain)
    fused *= np.array([RAISED if block.article else 1.0 for block in blocks]) * np.array(left)
    weight = np.array([len(block.text) for block in blocks], float)
    usual = float((fused * weight).sum() / weight.sum())
    text = np.array(links) < LINKED
    scored = ((fused >= THRESHOLD * usual) & text).tolist()
    beside = _beside(blocks, scored, left, spans)
    chosen = [one or bool(text[i]) and i in beside for i, one in enumerate(scored)]
    # a heading goes with the text that follows it
    for i in range(len(blocks) - 2, -1, -1):
        own, after = blocks[i], blocks[i + 1]
        if own.heading and text[i] and own.article == after.article and left[i] >= left[i + 1]:
            chosen[i] = chosen[i] or chosen[i + 1]
    return "\n".join(block.text for block, keep in zip(blocks, chosen) if keep)


def extract(
    pages: DataFrame, ident: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of each page's main text.

    A page without text, or null, gives an empty text. Pages stand by themselves, so repeated rows
    and null ids are extracted like others; other columns are not returned.
    """
    narrow = pages.select(
        col(pages, ident).alias("page_id"), col(pages, url).alias("url"), col(pages, source).alias("h")
    )
    kinds = [narrow.schema[n].dataType.simpleString() for n in ("page_id", "url")]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [main_text(page) for page in text_column(batch, 2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    found = narrow.mapInArrow(extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
