"""Main text of web pages by two-pass block rules.

A page is read once, tag by tag, into blocks of text with what their place in the
page says about them. Pass one looks at each block alone:

* inside a menu, header, footer, sidebar, notice, advert, form or comment section
  (by element, role, class or id): bad;
* mostly links, and outside the article or in a list: bad;
* long and rich in stop words: good; long without stop words and outside the
  article: bad;
* anything else, above all short blocks: undecided.

Pass two gives an undecided block the label of its nearest decided neighbours. In
an ``article`` or ``main`` only neighbours of that container count, and with none
the block is good. Elsewhere a block between two kinds of neighbours takes the
nearer one (the better at a tie), and a page without any decided block keeps none.

A header inside the article holds its title and counts as text. White space of a
block becomes one space; blocks are joined by one space in page order.

Defined cases: null or empty html, and html without text, give an empty text; a
tag, comment or script that is never closed ends with the page; a stray ``<`` is
text; repeated and null ids are kept as rows; an empty table gives an empty
result; columns that are not named are ignored unless carried.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import schema_of

# Elements of HTML by their role here.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes svg math select button object "
                "canvas audio video head datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog search label fieldset dir".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu "
                              "menubar toolbar tablist note status".split())
#: What an opening tag ends if it is the innermost open block.
CLOSES = {name: frozenset(closed.split()) for name, closed in {
    "p": "p", "div": "p", "ul": "p", "ol": "p", "h1": "p", "h2": "p", "h3": "p", "h4": "p", "table": "p", "section": "p",
    "aside": "p", "nav": "p", "footer": "p", "form": "p", "article": "p", "blockquote": "p", "header": "p", "pre": "p",
    "li": "li p", "dt": "dt dd p", "dd": "dt dd p", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th"}.items()}
CONTAINERS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id names that mark what is not the main text.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion promos "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar "
    "sidebar sidebars side aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup signin login register search share sharing social follow "
    "related recommend recommended recommendations recirculation comment comments commentlist commentary-list disqus "
    "respond reply replies discussion feedback copyright legal disclaimer skip toc outbrain taboola paywall".split())
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could did do does for from had has have he "
    "her him his how i if in into is it its just like more most my no not of on one only or other our out over said she "
    "should so some such than that the their them then there these they this to up was we were what when which who will "
    "with would you your "
    "aber als am an auch auf aus bei bin bis bist da damit das dass dem den der des die dies diese dieser doch du durch ein "
    "eine einem einen einer es für hat hatte ich ihr im in ist ja kann kein mit nach nicht noch nur ob oder sehr sein sich "
    "sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur lui mais même ne nos "
    "notre nous on ont ou où par pas plus pour qu que qui sa sans se ses son sont sur te tu un une vos votre vous y "
    "al algo como con contra cuando de del desde donde el ella ellos en entre era es esta este fue ha hay la las lo los me "
    "mi muy más no nos o para pero por porque que quien se ser si sin sobre son su sus también tan te tiene todo un una uno "
    "y ya".split())

ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES}>|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
#: Names of an article's own parts, and names that only say what else a page has.
OF_ARTICLES = frozenset(["header"])
NEGATED = re.compile(r"\b(?:no|has|with|without|is|js)[-_]\S+", re.I)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG, RICH, LINKED = 70, 200, 0.12, 0.5
GOOD, BAD, OPEN = 1, -1, 0


class Block:
    __slots__ = ("parts", "linked", "marked", "box", "heading", "item")

    def __init__(self, marked: bool, box: int, heading: bool, item: bool):
        self.parts: list[str] = []
        self.linked, self.marked, self.box, self.heading, self.item = 0, marked, box, heading, item


def marks(name: str, attributes: str, box: int) -> bool:
    """Whether an element is boilerplate by its kind or its names."""
    if name in BOILERPLATE or (name == "header" and not box):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for kind, value in NAMES.findall(attributes):
        kind, value = kind.lower(), value.strip("\"'")
        if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true"):
            return True
        if kind == "role":
            if value.lower() in BOILERPLATE_ROLES:
                return True
        elif kind in ("class", "id"):
            words = {w.lower() for w in NAME_WORDS.findall(NEGATED.sub("", value))}
            if words & BOILERPLATE_WORDS - (OF_ARTICLES if box else frozenset()):
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # element, inside boilerplate, number of its article
    marked, box, boxes, links, heading = False, 0, 0, 0, False
    block = Block(False, 0, False, False)

    def close() -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        block = Block(marked, box, heading, any(e[0] == "li" for e in stack[-4:]))

    at, end = 0, len(page)
    while at < end:
        token = TOKEN.search(page, at)
        text = page[at:token.start() if token else end]
        if text:
            text = html.unescape(text) if "&" in text else text
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())
        if token is None:
            break
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if not token[1]:
            attributes = token[3][:-1]
            if name in RAW and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                if name != "head":
                    at = stop.end() if stop else end
                    continue
                at = stop.end() if stop else at
                continue
            if name in BLOCKS:
                for open_name, _, _ in reversed(stack) if name in CLOSES else ():
                    if open_name in CLOSES[name]:
                        while stack.pop()[0] != open_name:
                            pass
                        marked, box = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                    if open_name in BLOCKS:
                        break
                heading = name in HEADINGS
                if name not in VOID:
                    if name in CONTAINERS and not marked and not box:
                        boxes += 1
                        box = boxes
                    marked = marked or marks(name, attributes, box)
                    stack.append((name, marked, box))
                close()
            elif name == "a":
                links = 1
            elif name not in VOID and not attributes.endswith("/") and attributes and marks(name, attributes, box):
                stack.append((name, True, box))
                marked = True
                close()
        else:
            if name == "a":
                links = 0
            elif name in BLOCKS or any(e[0] == name for e in stack[-8:]):
                if any(e[0] == name for e in stack):
                    while stack.pop()[0] != name:
                        pass
                    marked, box = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                heading, links = False, 0
                close()
    close()
    return out


def first_pass(text: str, block: Block) -> int:
    if block.marked or (block.linked > LINKED * len(text) and (block.item or not block.box)):
        return BAD
    if len(text) < SHORT or block.heading:
        return OPEN
    words = WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words)
    if stops >= RICH * len(words) and words:
        return GOOD if len(text) >= LONG or block.box else OPEN
    return OPEN if block.box or len(text) < LONG else BAD


def second_pass(labels: list[int], boxes: list[int]) -> list[int]:
    """Undecided blocks take the label of the nearest decided one."""
    before: list[tuple[int, int]] = []
    last: dict[int, tuple[int, int]] = {}
    everywhere = (-1, OPEN)
    for i, (label, box) in enumerate(zip(labels, boxes)):
        if label != OPEN:
            last[box] = everywhere = (i, label)
        before.append(last.get(box, (-1, OPEN)) if box else everywhere)
    out, last, everywhere = list(labels), {}, (-1, OPEN)
    for i in range(len(labels) - 1, -1, -1):
        label, box = labels[i], boxes[i]
        if label != OPEN:
            last[box] = everywhere = (i, label)
            continue
        (a, left), (b, right) = before[i], last.get(box, (-1, OPEN)) if box else everywhere
        if left == OPEN or right == OPEN or left == right:
            out[i] = left or right
        else:
            out[i] = left if i - a < b - i else right if b - i < i - a else GOOD
        if box and out[i] != GOOD:  # inside an article only links and marked parts are bad
            out[i] = GOOD
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found = [(" ".join("".join(b.parts).split()), b) for b in blocks_of(page)]
    found = [(text, b) for text, b in found if text]
    labels = second_pass([first_pass(t, b) for t, b in found], [b.box for _, b in found])
    return " ".join(t for (t, _), label in zip(found, labels) if label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", carry=()) -> DataFrame:
    """``page_id, url, text, n_chars`` (and ``carried``), a row per page."""
    columns = [F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
               F.col(f"`{html_col}`").cast("string").alias("html")]
    if carry := list(carry):
        columns.append(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried"))
    pages = pages.select(*columns)

    def read(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            names = ["page_id", "url", "text", "n_chars"]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                      pa.array([len(t) for t in texts], pa.int64())]
            if "carried" in batch.schema.names:
                names.append("carried")
                arrays.append(batch.column("carried"))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return pages.mapInArrow(read, schema_of("page_id long, url string, text string, n_chars long", pages))
