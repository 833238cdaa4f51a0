"""Main text of HTML pages by two passes over blocks.

A tolerant scanner turns a page into blocks: text between block-level tags, with its length, the share of it that is link
text, the share of its words that are function words, and what encloses it. Pass one decides. What stands in navigation,
headers, footers, asides, forms, hidden elements or reader comments is boilerplate; so are blocks that are mostly links.
Class, id and role names are weighed: an element whose names speak of parts beside the article alone ("related-posts") hides
its blocks, unless it encloses an article or has most of the page's function words; names with other words too
("share-prices") count against open blocks only; names that deny or describe ("no-sidebar") count for nothing. Long blocks with enough function words are text. Short blocks, and long ones with almost no function
words, stay open. In an article (article, main, or itemprop articleBody) fewer function words are enough.

In pass two open blocks inherit from the nearest decided blocks before and after. Of two that differ the one counts that
shares the deeper enclosing element, then the one with fewer blocks between, then the one before; headings go with what follows. A
long block with almost no function words needs text on both sides, or beside it in the same element. In an article an open
block is text unless both neighbours there are not. On a page whose blocks have almost no function words of a known
language, long blocks are text by length and links alone; where no block is decided to be text, long ones are, or paragraphs
if there are none. If a page marks an article that has text, nothing outside counts.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: HTML elements by what they do to the text around them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas select option textarea button audio video datalist map".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"html", "body"}
#: words of class, id and role names that mark parts beside the article
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense banner banners sponsor sponsored sponsors promo promos promotion promotions sidebar sidebars aside menu menus nav navbar navigation navigations breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments commentlist respond replies reply disqus cookie cookies consent gdpr notice notices alert notification notifications popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations recirc widget widgets pagination pager tags tagcloud skip search form copyright disclaimer legal contentinfo complementary".split()
)
#: function words by language
FUNCTION_WORDS = {
    "en": frozenset("a about after all also an and any are as at be been but by can could did do for from had has have he her him his how i if in into is it its more most my no not of on one or our out she so some than that the their them then there these they this to up us was we were what when where which who will with would you your".split()),
    "de": frozenset("aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich im in ist ja kann mit nach nicht noch nur oder sich sie sind so über um und unter vom von vor war was wenn wer wie wir wird zu zum zur".split()),
    "fr": frozenset("au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais me même ne nous on ou où par pas pour plus qu que qui sa se ses si son sont sur un une vous y".split()),
    "es": frozenset("al algo como con de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus también un una y ya".split()),
}
ANY_FUNCTION_WORD = frozenset().union(*FUNCTION_WORDS.values())
#: of these, the words of reader comments
COMMENTS = frozenset("comment comments commentlist respond replies reply disqus".split())
#: words that say where or in what such a part stands, and words that deny it or tell that a page has one
LAYOUT = frozenset("area bar block body bottom box button buttons col column container content group holder inner item items layout left link links list main module outer panel post posts primary right row secondary section site slot the top unit wrap wrapper zone".split())
TELLING = frozenset("has hide is no not show with without".split())
PARAGRAPH = HEADINGS | frozenset("p li dt dd pre blockquote td th figcaption caption summary".split())
SHORT, LONG = 70, 200  # characters
LINKED = 0.5  # link share from which a block is boilerplate
DENSE, SPARSE = 0.25, 0.1  # function word shares; long blocks and those of an article need the smaller one

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"'=]+|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+(?:>|$))",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WORDS = re.compile(r"[^\W\d_]+")

GOOD, BAD, OPEN = 1, 0, -1


class Block:
    __slots__ = ("text", "label", "heading", "region", "words", "known", "sparse", "depth", "low", "paragraph", "names", "doubtful")

    def __init__(self, text: str, linked: int, beside: bool, article: int, heading: bool, depth: int, low: int, paragraph: bool, names: tuple[int, ...] = (), doubtful: bool = False):
        """``depth``: of the enclosing block elements; ``low``: the least depth since the block before; ``paragraph``: whether the innermost is one; ``names``: the enclosing elements that are named as beside the article; ``doubtful``: whether one is in part."""
        self.names, self.doubtful = names, doubtful
        self.text, self.heading, self.region, self.sparse = text, heading, article, False
        self.depth, self.low, self.paragraph = depth, low, paragraph
        words = _WORDS.findall(text.lower())
        self.words, self.known = len(words), sum(w in ANY_FUNCTION_WORD for w in words)
        self.label = BAD if beside else self._judge(text, linked / max(1, len(text)), article)

    def _judge(self, text: str, linked: float, article: int) -> int:
        if article:
            if linked > 0.9 and len(text) < SHORT and self.words < 3:
                return BAD
        elif linked > LINKED:
            return BAD
        if len(text) < SHORT:
            return OPEN
        dense = self.known / self.words if self.words else 0.0
        if dense >= (SPARSE if article or len(text) >= LONG else DENSE):
            return GOOD
        self.sparse = dense < SPARSE and len(text) >= LONG
        return OPEN


NONE, PARTLY, NAMED, HIDDEN = range(4)


def _named(word: str) -> int:
    """What a name of an element says about its being beside the article."""
    parts = [p.lower() for p in _PARTS.findall(word)]
    if not parts or parts[0] in TELLING or not (parts[0] in BESIDE or parts[-1] in BESIDE):
        return NONE
    if parts[0] in COMMENTS or parts[-1] in COMMENTS:
        return HIDDEN
    return NAMED if all(p in BESIDE or p in LAYOUT for p in parts) else PARTLY


def _marks(attributes: str) -> tuple[int, bool]:
    """How far an element's names and attributes say that it stands beside the article, and whether it is the article's body."""
    beside, body = NONE, False
    for name, *values in _NAMES.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "itemprop":
            body |= value.lower() == "articlebody"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            beside = HIDDEN
        elif name in ("class", "id", "role"):
            beside = max(beside, *map(_named, value.split()), NONE)
    return beside, body


class _Open:
    """An open element."""

    __slots__ = ("tag", "beside", "article", "blocks", "level", "outer")

    def __init__(self, tag: str, beside: bool, article: bool, blocks: int, level: int):
        self.tag, self.beside, self.article, self.blocks, self.level, self.outer = tag, beside, article, blocks, level, 0


class _Scanner:
    """Reads a page once. The open elements are a stack, with the places of each tag in it, so that no step goes through the stack."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.forms: list[_Open] = []  # open forms that count as beside the article
        self.article = self.articles = self.beside = self.skipping = self.linked_in = self.depth = self.low = 0
        self.names: list[int] = []  # numbers of the open elements that are named as beside the article
        self.elements = self.doubtful = 0
        self.around: set[int] = set()  # of those, the ones around an article
        self.teasers: set[int] = set()  # articles in such elements
        self.buffer: list[str] = []
        self.linked, self.heading = 0, False

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                inner = self.stack[-1].tag if self.stack else ""
                paragraph = inner in PARAGRAPH or (inner not in BLOCK and any(self.places.get(t) for t in ("p", "li", "pre")))
                self.out.append(Block(text, self.linked, self.beside > 0, self.article if self.beside == 0 else 0, self.heading, self.depth, min(self.low, self.depth), paragraph, tuple(self.names), self.doubtful > 0))
                self.low = self.depth
            self.buffer.clear()
        self.linked = 0

    def push(self, tag: str, attributes: str) -> None:
        level, body = _marks(attributes) if attributes.strip() else (NONE, False)
        is_article = tag in ("article", "main") or body
        if is_article or tag in ("html", "body"):
            level = NONE
        apart = level == HIDDEN or tag in BOILERPLATE or (tag == "header" and not self.article)
        if is_article:
            for form in self.forms:  # a form around an article does not hide it
                form.beside = False
                self.beside -= 1
            self.forms.clear()
        block = tag in BLOCK
        self.depth += block
        element = _Open(tag, apart, is_article and not self.article, self.depth, level)
        if element.article:
            self.articles += 1
            self.article = self.articles
            element.outer, self.doubtful = self.doubtful, 0  # what stands around an article says nothing about its inside
            if self.names:
                self.around.update(self.names)
                self.teasers.add(self.article)
        if level == NAMED:
            self.elements += 1
            self.names.append(self.elements)
        self.doubtful += level == PARTLY
        if apart and tag == "form":
            self.forms.append(element)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(element)
        self.beside += apart
        self.skipping += tag in SKIPPED
        self.linked_in += tag == "a"

    def pop(self) -> None:
        element = self.stack.pop()
        if self.places.get(element.tag):
            self.places[element.tag].pop()
        self.beside -= element.beside
        self.doubtful -= element.level == PARTLY
        if element.level == NAMED:
            self.names.pop()
        if element.beside and self.forms and self.forms[-1] is element:
            self.forms.pop()
        if element.article:
            self.article, self.doubtful = 0, element.outer
        if element.tag in BLOCK:
            self.depth -= 1
            self.low = min(self.low, self.depth)
        self.skipping -= element.tag in SKIPPED
        self.linked_in -= element.tag == "a"

    def close_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        at = self.places.get(tag)
        if at:
            place = at[-1]
            inside = self.stack[-1].blocks > self.stack[place].blocks
            if tag in BLOCK or tag in SKIPPED or not inside:
                self.close_to(place)
            elif tag == "a":  # an inline end tag does not close blocks around it, but the link ends
                at.pop()
                self.stack[place].tag = "a-closed"
                self.linked_in -= 1
        if tag in HEADINGS:
            self.heading = False

    def begin(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            self.heading = tag in HEADINGS
            if tag in CLOSES_P and self.places.get("p"):
                self.close_to(self.places["p"][-1])
            elif tag in ("li", "dt", "dd", "tr", "td", "th") and self.places.get(tag):
                place = self.places[tag][-1]
                if not any(at and at[-1] > place for at in map(self.places.get, ("ul", "ol", "dl", "table", "tbody", "menu"))):
                    self.close_to(place)
        if tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path")):
            self.push(tag, attributes)

    def text(self, s: str) -> None:
        if self.skipping or not s:
            return
        s = html.unescape(s)
        self.buffer.append(s)
        if self.linked_in:
            self.linked += len("".join(s.split()))


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order. Unclosed tags end where their parents end; a lone < is text."""
    scan, at, n = _Scanner(), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            scan.text(page[at:])
            break
        if m.start() > at:
            scan.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3].removesuffix(">")
        if m[1]:
            scan.end(tag)
        elif tag == "br":
            scan.text(" ")
        elif tag in RAW:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else n
        elif tag != "wbr":
            scan.begin(tag, attributes)
    scan.flush()
    _weigh(scan)
    return scan.out


def _weigh(scan: _Scanner) -> None:
    """The end of pass one: what names say, beside articles and function words."""
    total, held = sum(b.known for b in scan.out if b.label != BAD), {}
    for b in scan.out:
        for name in b.names:
            held[name] = held.get(name, 0) + (b.known if b.label != BAD else 0)
    excused = scan.around | {name for name, known in held.items() if known and 2 * known >= total}
    # an article in such an element is a teaser if there is one outside
    whole = any(b.region and b.region not in scan.teasers and b.label == GOOD for b in scan.out)
    for b in scan.out:
        if any(name not in excused for name in b.names) or (whole and b.region in scan.teasers):
            b.label, b.region, b.sparse = BAD, 0, False
        elif b.doubtful and b.label == OPEN and not (b.heading and b.region):
            b.label = BAD


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def _nearest(found: list[Block], labels: list[int], step: int) -> list[tuple[int, int, int] | None]:
    """For each block the label of the nearest decided one on one side, the depth of what encloses both, and how far it is."""
    out: list[tuple[int, int, int] | None] = [None] * len(found)
    last = shared = far = None
    order = range(len(found)) if step > 0 else range(len(found) - 1, -1, -1)
    for k in order:
        if last is not None:
            # the elements that enclose two blocks are those of the lowest place between them
            low = found[k].low if step > 0 else found[k + 1].low
            shared, far = min(shared, low), far + 1
            out[k] = (last, shared, far)
        if labels[k] != OPEN:
            last, shared, far = labels[k], found[k].depth, 0
    return out


def _inherited(b: Block, left: tuple[int, int, int] | None, right: tuple[int, int, int] | None) -> int:
    beside = [x for x in (left, right) if x is not None]
    if b.region:
        return BAD if len(beside) == 2 and left[0] == right[0] == BAD else GOOD
    if not beside:
        return BAD
    # in the same element as a paragraph or list item beside it
    close = [x for x in beside if x[1] >= b.depth - b.paragraph]
    if b.sparse:
        return GOOD if (len(beside) == 2 and left[0] == right[0] == GOOD) or any(x[0] == GOOD and b.paragraph for x in close) else BAD
    if b.heading:
        return GOOD if right is not None and right[0] == GOOD and (right[2] <= 2 or right in close) else BAD
    if len(beside) == 1:
        x = beside[0]
        return x[0] if x[2] == 1 or (b.paragraph and x in close) else BAD
    return min(beside, key=lambda x: (-x[1], x[2]))[0]


def settle(found: list[Block]) -> list[Block]:
    """Pass two: open blocks take the kind of decided neighbours."""
    if any(b.sparse for b in found) and sum(b.known for b in found) < SPARSE * sum(b.words for b in found):
        for b in found:  # the page's language has no list
            if b.sparse and b.label == OPEN and b.words:
                b.label = GOOD
    if not any(b.label == GOOD for b in found):  # code or names, else short paragraphs: no more is there to decide by
        long_ones = [b for b in found if b.label == OPEN and b.sparse]
        for b in long_ones or found:
            if b.label == OPEN and (b.sparse or b.paragraph):
                b.label = GOOD
    labels = [b.label for b in found]
    inside = [label if b.region else BAD for b, label in zip(found, labels, strict=True)]
    before, after = _nearest(found, labels, 1), _nearest(found, labels, -1)
    if any(b.region for b in found):  # neighbours in the article alone
        kept = [k for k, b in enumerate(found) if b.region]
        part = [found[k] for k in kept]
        own = [inside[k] for k in kept]
        for k, x, y in zip(kept, _nearest(part, own, 1), _nearest(part, own, -1), strict=True):
            before[k], after[k] = x, y
    for b, label, left, right in zip(found, labels, before, after, strict=True):
        if label == OPEN:
            b.label = _inherited(b, left, right)
    return found


def main_text(page: str | None) -> str:
    """The text of the page's article, one block per line; empty if it has none."""
    found = settle(blocks(page or ""))
    if any(b.region and b.label == GOOD for b in found):  # a page that marks its article says what is not in it
        found = [b for b in found if b.region]
    return "\n".join(b.text for b in found if b.label == GOOD)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row, in one pass without a shuffle. Null or empty pages have an empty text; repeated rows stay."""
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
