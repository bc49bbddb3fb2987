"""Main text of web pages by two passes over their blocks.

First pass: a page is cut into blocks at block-level tags, and each is classified by itself. Blocks of menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, told by their tags, roles, classes and ids, are bad, and so are
blocks that consist of links. Long blocks with a share of stop words as in running text are good. All others, the
short ones above all, are undecided.

Second pass: an undecided block takes the label of its nearest decided neighbours in its region (the article, or
what lies outside of it). Where these differ and are equally far, or where there are none, the region decides: in an article
it is good, elsewhere bad. In an article bad blocks say nothing about others. A page without an article, and without a block that
has the stop words of a known language, takes its longest blocks for good, whatever the language.

Scripts, styles and the page's head are no text. Character references are decoded, white space inside a block becomes
one space, and the good blocks are joined in page order by line ends. Nothing else is dropped or cut.

Cases: null and empty pages, and pages without good blocks, give an empty text. Unclosed tags, comments and scripts
end where the page ends. Text outside of any element is undecided. A page of any length is read whole. Repeated rows are rows of
their own. Other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.llm.common import replaced, slices, texts_of, with_column

MOST_LINKED = 0.5
LONG_CHARS = 70
STOP_SHARE = 0.2
GOOD, BAD = 1, -1

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: elements whose content is no text of the page
SILENT = frozenset("script style noscript template head title textarea select button svg math iframe object canvas audio video".split())
#: elements that begin and end a block
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
BAD_TAGS = frozenset("nav aside footer form menu dialog search".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: words in classes and ids of what is not the article
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentary consent cookie "
    "cookies copyright dialog discussion disqus footer form gdpr legal login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies respond share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
#: words before such a one, and behind it, that tell something else
QUALIFIERS = frozenset("has have with no not without is".split())
STATES = frozenset("open opened closed enabled disabled on off".split())
#: names of page layouts: an article inside of such an element is the article all the same
LAYOUT_NAMES = frozenset("sidebar nav navbar menu header masthead banner toolbar overlay notice notices social share sharing login cookie cookies consent".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: frequent words of running text, by language
STOP_WORDS = frozenset(
    (
        "a an and are as at be been but by can did do for from had has have he her his i if in into is it its more my no not of on one "
        "or our out she so some than that the their them then there they this to up was we were what when which who will with would you "
        "aber als am an auch auf aus bei bin bis da das dass dem den der des die du durch ein eine einem einen einer eines er es für "
        "hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so um und uns unter vom von vor war was wenn wer "
        "werden wie wir wird zu zum zur über "
        "au aux avec ce ces cette dans de des donc du elle en est et eu il ils je la le les leur lui mais me même mes ne nous on ont ou "
        "où par pas plus pour qu que qui sa sans se ses son sont sur un une vous y "
        "al algo como con cuando de del desde donde el ella en entre era es esta este ha hay la las lo los más me mi muy no nos o para "
        "pero por que se ser si sin sobre su sus también un una y ya"
    ).split()
)


@dataclass
class Block:
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    bad: bool = False
    article: bool = False
    element: bool = False
    text: str = ""
    label: int = 0


# what an element's names tell of it: nothing, a layout that may hold the article, or no part of the article
PLAIN, LAYOUT, OTHER = 0, 1, 2


def named(attributes: str, in_article: bool) -> int:
    """What roles, classes and the id tell of an element."""
    worst = PLAIN
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or name == "role" and value.lower() in BAD_ROLES:
            return OTHER
        if name in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in NAME_PART.findall(word)]
                if parts == ["header"] and not in_article:
                    worst = max(worst, LAYOUT)
                for i, part in enumerate(parts):
                    if part in BAD_NAMES and QUALIFIERS.isdisjoint(parts[:i]) and STATES.isdisjoint(parts[i + 1 :]):
                        worst = max(worst, LAYOUT if part in LAYOUT_NAMES else OTHER)
    return worst


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, with what their elements tell."""
    found, now = [], Block()
    # open block-level elements: name, how bad what they stand in is, whether in an article
    open_: list[tuple[str, int, bool]] = []
    links = at = 0
    name = ""

    def close() -> None:
        nonlocal now
        now.text = " ".join(html.unescape("".join(now.pieces)).split())
        if now.text:
            found.append(now)
        now = Block(bad=bool(open_ and open_[-1][1]), article=bool(open_ and open_[-1][2]), element=bool(open_) or name == "p")

    def say(text: str) -> None:
        if text:
            now.pieces.append(text)
            if links:
                now.linked += len(text)

    while True:
        tag = MARKUP.search(page, at)
        if tag is None:
            say(page[at:])
            break
        say(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        if name in SILENT:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            now.pieces.append(" ")
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br" or name == "img":
            now.pieces.append(" ")
        elif name in BLOCKS:
            if closing:
                if any(o[0] == name for o in open_):
                    while open_.pop()[0] != name:
                        pass
            elif name not in VOID and name != "p" and not attributes.endswith("/"):
                bad, article = (open_[-1][1], open_[-1][2]) if open_ else (PLAIN, False)
                if name in ("article", "main"):
                    # it lifts the mark of a layout around it
                    bad, article = (bad, article) if bad == OTHER else (PLAIN, True)
                elif name not in ("body", "html"):
                    outside = name in BAD_TAGS or name == "header" and not article
                    bad = max(bad, OTHER if outside else named(attributes, article))
                open_.append((name, bad, article))
            hidden = name == "p" and not closing and attributes and named(attributes, bool(open_ and open_[-1][2]))
            close()
            now.bad = now.bad or bool(hidden)
            links = 0
    close()
    return found


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def is_bad(block: Block) -> bool:
    return block.bad or block.linked > MOST_LINKED * len(block.text)


def classify(block: Block) -> int:
    """The first pass: a block by itself."""
    if is_bad(block):
        return BAD
    if len(block.text) >= LONG_CHARS and stop_share(block.text) >= STOP_SHARE:
        return GOOD
    return 0


def seeds(region: list[Block], article: bool) -> list[int]:
    """Labels of the first pass. Outside of an article at least one block of text is good, if there is any.

    Where no block has the stop words of a known language, the long ones are good, and where there is none, all blocks of
    elements are. What counts as long is half the length of the longest: a script that writes many words in few characters
    has shorter blocks.
    """
    labels = [classify(b) for b in region]
    if article or GOOD in labels:
        return labels
    open_ = [i for i, label in enumerate(labels) if not label and region[i].element]
    most = max((len(region[i].text) for i in open_), default=0)
    for i in open_:
        if most < LONG_CHARS / 2 or len(region[i].text) >= most / 2:
            labels[i] = GOOD
    return labels


def decide(page_blocks: list[Block]) -> None:
    """The second pass, region by region: undecided blocks take over labels of decided neighbours.

    Inside an article a bad block says nothing about its neighbours: what is not bad by itself is good. What lies outside of an
    article that has text is only good by itself or beside good blocks.
    """
    has_article = any(b.article and not is_bad(b) for b in page_blocks)
    for article in (True, False):
        region = [b for b in page_blocks if b.article == article]
        labels = seeds(region, article or has_article)
        decided = [label if label == GOOD or not article else 0 for label in labels]
        before, after, last = [], [], None
        for i, label in enumerate(decided):
            last = i if label else last
            before.append(last)
        last = None
        for i in range(len(decided) - 1, -1, -1):
            last = i if decided[i] else last
            after.append(last)
        after.reverse()
        for i, block in enumerate(region):
            near = [(abs(i - k), decided[k]) for k in (before[i], after[i]) if k is not None]
            least = min((d for d, _ in near), default=0)
            nearest = {label for d, label in near if d == least}
            taken = nearest.pop() if len(nearest) == 1 else (GOOD if article else BAD)
            block.label = labels[i] or taken


def main_text(page: str) -> str:
    found = blocks(page)
    decide(found)
    return "\n".join(b.text for b in found if b.label == GOOD)


def extract(pages: DataFrame, name: str = "main_text") -> DataFrame:
    """All rows and columns of ``pages`` and the main text of ``html``, which takes the place of a column of its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            yield replaced(batch, name, pa.array(map(main_text, texts_of(batch, "html")), pa.string()))

    pages = pages.withColumn("html", F.col("html").cast("string"))
    return pages.mapInArrow(run, with_column(pages, name, T.StringType()))
