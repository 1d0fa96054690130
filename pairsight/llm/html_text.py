"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags (one <br> is white space, two end a block). Whole
elements that never hold the article are left out: scripts, styles, forms, menus, headers (but for
the article's own), footers, sidebars, notices, adverts and reader comments, known by their tag,
role or by words of their class or id. Words of class or id, a form's and a header's tag are evidence
only: such an element stays if it holds the page's <main>, an <article> of more text than all that
isn't left out, or most of the page's text (comments: if nothing good is outside). Classes that state
what a page has or allows (has-sidebar, comments-open) say nothing, nor do headings' classes or ids; within
an article an id counts only if it says nothing else (comments, not related-work). Softer words (share,
related) leave an element out only if it is short or has many links.

First pass, each block by itself: link density, length in code points and stop-word density (the
best of the languages listed) make it good, bad, nearly good, or short (undecided). A page's mark of its
article (<article>, <main>, role=main) is one more feature, if it holds a quarter as much text as the good
blocks outside: then blocks outside are bad, and inside a nearly good block, or a short one without links,
is good and one of too few stop words nearly good. Second pass: undecided blocks take the label of the
nearest decided neighbours (within the mark, if it counts); if those differ, the nearer one's by blocks
in between, and good when as near for a
nearly good block; before the first and after the last decided block, that block's label; good if
a page has none.

Stop words judge only what the lists cover. If blocks of many stop words hold less than a quarter of a
page's prose, no listed language fits it, and its long blocks of few links are good if they are over
``Rules.long`` or hold the end of a sentence, or else undecided. The same goes
for a block whose letters are mostly not Latin, where stop words don't make it good. If no block of
a page is good, the nearly good ones are.

Null or empty pages give an empty text. Broken markup never fails: an unclosed element ends with
its parent, an unclosed comment or script at the end of the page. Repeated rows repeat; only the
named columns are kept. Work is linear in the page, and each page is a row's own work.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Frequent function words.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be been but by can could do for from had has have he her his i if in into is it its more no not of on one or other our she so some than that the their them then there these they this to was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du ein eine einem einen einer er es für hat hatte ich ihr im in ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur",
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et été être eu il ils je la le les leur lui mais même ne nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur tout un une vous y",
    "it": "a ad al alla anche che chi ci come con da dal dalla dei del della delle di dove e è ed era essere fu gli ha hanno i il in io la le lei lo loro ma mi nei nel nella noi non o per perché più quando quella quello questa questo se si sono su sua suo tra tu tutti un una uno",
    "pt": "a ao aos as até com como da das de do dos e é ela ele eles em entre era essa esse está eu foi há isso já mais mas me muito na nas não no nos o os ou para pela pelo por quando que quem se sem ser seu sua são também tem um uma você",
    "nl": "aan al als bij dan dat de der deze die dit door een en er had heb heeft het hij hoe ik in is je kan maar me meer met mijn na naar niet nog nu of om omdat onder ook op over te tot uit van veel voor was wat we wel wij wordt ze zich zij zijn zo zou",
    "ru": "а без бы был была были было быть в вы где да для до его ее её если есть еще ещё же за и из или им их к как когда кто ли мы на не него нет но о об он она они от по под при с со так там то только у уже что чтобы это этот я",
    "es": "a al algo como con cuando de del desde donde el ella ellos en entre era es esta este esto ha han hasta hay la las le les lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también un una uno y ya yo",
}
#: Of each word, the languages (by number) that list it.
STOP: dict[str, list[int]] = {}
for _number, _words in enumerate(STOP_WORDS.values()):
    for _word in _words.split():
        STOP.setdefault(_word, []).append(_number)

SKIP = frozenset("script style noscript template svg math iframe object select textarea button canvas audio video head title".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
BLOCK = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr td th blockquote pre section article main header footer aside nav form fieldset figure figcaption address body html hr center details summary menu dialog hgroup search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never left out by their class, but for an <article> that is a comment.
WHOLE = frozenset("html body article main".split())
#: An open element that a new one of the group ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HINTS = r"ads?|adverts?|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|cookies?|consent|gdpr|notice|notices|alert|nav|navbar|navigation|menu|menus|sidebar|breadcrumbs?|footer|masthead|comments?|commentlist|disqus|respond|replies|reply|newsletter|subscribe|subscription|signup|login|popup|modal|pagination|pager"
HINT = re.compile(rf"(?:^|[\s_-])(?:{HINTS})(?=$|[\s_-])", re.I)
SOFT = re.compile(r"(?:^|[\s_-])(?:share|sharing|social|related|recommended|overlay|widget|widgets|toolbar|skip|tags|disclaimer)(?=$|[\s_-])", re.I)
#: An id that holds nothing but such words.
ONLY_HINT = re.compile(rf"(?:(?:{HINTS}|section|area|box|list|bar|block|wrapper|container|top|bottom|left|right|main|site|page|\d+)(?:[\s_-]|$))+", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol dl table td tr span figure details p center article".split())
#: Classes that tell a state of the page, not what an element is.
STATE = re.compile(r"(?:has|no|with|without)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled)", re.I)
READERS = re.compile(r"comment|disqus|respond|repl(?:y|ies)", re.I)
HEADER_HINT = re.compile(r"(?:^|[\s_-])(?:site|page|top|main|global)?[_-]?header(?:$|\s)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
SHUT = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?…](?=[\s\"'»”’)]|$)|[。！？．।؟۔።]")


@dataclass(frozen=True)
class Rules:
    short: int = 70
    long: int = 200
    links: float = 0.4
    stop_low: float = 0.15
    stop_high: float = 0.25


@dataclass(eq=False)
class Node:
    """An element that marks the article (mark: 1 article, 2 main) or may be left out.

    kind: always, or unless it holds the page's text: named, readers (comments), soft.
    """

    kind: str
    mark: int
    parent: Node | None
    kept: bool = False
    gone: bool = False
    free: bool = True
    held: int = 0
    linked: int = 0
    article: int = 0
    main: bool = False


@dataclass
class Block:
    text: str
    linked: int
    article: bool
    left_out: bool
    node: Node | None = None


class Element:
    __slots__ = ("alive", "at", "node", "tag")

    def __init__(self, tag: str, at: int, node: Node | None):
        self.tag, self.at, self.node, self.alive = tag, at, node, True


def hinted(tag: str, attrs: dict[str, str], in_article: bool) -> str:
    """Whether an element is left out with all it holds: always, named, readers, soft, or empty for no."""
    whole = tag in WHOLE
    role = attrs.get("role", "").strip().lower()
    if not whole and ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or (role in ROLES and role != "form")):
        return "always"
    if tag in BOILER and tag != "form":
        return "always"
    if tag in HEADINGS:
        return ""
    if not whole or tag == "article":
        words = [x for x in re.sub(r"([a-z])([A-Z])", r"\1-\2", attrs.get("class", "")).split() if not STATE.fullmatch(x)]
        ident = re.sub(r"([a-z])([A-Z])", r"\1-\2", attrs.get("id", "")).strip()
        if ident and not STATE.fullmatch(ident) and (tag in CONTAINERS or tag == "header") and (not in_article or ONLY_HINT.fullmatch(ident)):
            words.append(ident)
        plain = " ".join(words)
        if HINT.search(plain) or (not in_article and HEADER_HINT.search(plain)):
            readers = READERS.search(plain)
            if readers or not whole:
                return "readers" if readers else "named"
        elif not whole and SOFT.search(plain):
            return "soft"
    return "named" if tag == "form" or role == "form" or (tag == "header" and not in_article) else ""


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Parser:
    """Cuts a page into blocks. What is open is counted when it opens and closes, so the work is linear."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.nodes: list[Node] = []
        self.parts: list[str] = []
        self.linked = self.skips = self.links = self.marks = self.breaks = 0
        self.stack: list[Element] = []
        self.by_tag: dict[str, list[Element]] = {}
        self.blocks: list[Element] = []
        self.around: list[Node] = []

    def node(self) -> Node | None:
        while self.around and self.around[-1].gone:
            self.around.pop()
        return self.around[-1] if self.around else None

    def end_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.found.append(Block(text, min(self.linked, len(text)), self.marks > 0, False, self.node()))
            self.parts.clear()
        self.linked = 0

    def add(self, raw: str) -> None:
        if self.skips:
            return
        if self.links or self.breaks:
            n = len(SPACE.sub(" ", html.unescape(raw)).strip())
            if n:
                self.breaks = 0
            if self.links:
                self.linked += n
        self.parts.append(raw)

    def open(self, tag: str, attrs: dict[str, str]) -> None:
        mark = 0
        kind = ""
        if not self.skips:
            mark = 2 if tag == "main" or attrs.get("role", "").strip().lower() == "main" else 1 if tag == "article" else 0
            kind = hinted(tag, attrs, self.marks > 0)
        node = None
        if mark or kind:
            node = Node(kind, mark, self.node())
            self.nodes.append(node)
            self.around.append(node)
        x = Element(tag, len(self.stack), node)
        self.stack.append(x)
        self.by_tag.setdefault(tag, []).append(x)
        if tag in BLOCK:
            self.blocks.append(x)
        self.count(x, 1)

    def count(self, x: Element, by: int) -> None:
        if x.tag in SKIP:
            self.skips += by
        elif x.tag == "a":
            self.links += by
        if x.node is not None and x.node.mark:
            self.marks += by

    def leave(self, x: Element) -> None:
        """``x`` ends; it is the last open element of its tag."""
        self.by_tag[x.tag].pop()
        self.count(x, -1)
        x.alive = False
        if x.node is not None:
            x.node.gone = True

    def pop_through(self, at: int) -> None:
        while len(self.stack) > at:
            x = self.stack.pop()
            if x.alive:
                self.leave(x)
            if self.blocks and self.blocks[-1] is x:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        known = self.by_tag.get(tag)
        if not known:
            return
        x = known[-1]
        if tag in BLOCK or not self.blocks or self.blocks[-1].at < x.at:
            self.pop_through(x.at)
        else:
            self.leave(x)

    def feed(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            m = TOKEN.search(page, at)
            if m is None:
                self.add(page[at:])
                break
            if m.start() > at:
                self.add(page[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self.add(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
            if tag == "br":
                self.breaks += 1
                if self.breaks > 1:
                    self.end_block()
                else:
                    self.parts.append(" ")
                continue
            if tag in BLOCK:
                self.end_block()
            if closing:
                self.close(tag)
                continue
            if tag in RAW:
                shut = SHUT[tag].search(page, at)
                at = shut.end() if shut else size
                continue
            if tag in VOID or attrs.endswith("/"):
                continue
            if tag == "body":
                html_at = self.by_tag.get("html")
                self.pop_through(html_at[-1].at + 1 if html_at else 0)
            elif tag in BLOCK and self.blocks and (self.blocks[-1].tag == "p" or self.blocks[-1].tag in CLOSES.get(tag, ())):
                self.pop_through(self.blocks[-1].at)
            self.open(tag, attributes(attrs) if attrs else {})
        self.end_block()


def blocks_of(page: str) -> list[Block]:
    parser = Parser()
    parser.feed(page)
    settle(parser.found, parser.nodes)
    return parser.found


def settle(found: list[Block], nodes: list[Node]) -> None:
    """Decides which elements are left out: never one that holds the article or most of the page's text.

    ``nodes`` come in the order of their beginnings, a parent before its children.
    """
    shown: dict[int, bool] = {}
    for x in nodes:
        shown[id(x)] = x.kind != "always" and (x.parent is None or shown[id(x.parent)])
    seen = [(b, max(len(b.text) - b.linked, 0)) for b in found if b.node is None or shown[id(b.node)]]
    total = sum(n for _, n in seen)
    for b, n in seen:
        if b.node is not None:
            b.node.held += n
            b.node.linked += b.linked
    for x in reversed(nodes):
        if x.mark:
            x.article, x.main = max(x.article, x.held), x.main or x.mark == 2
        if x.parent is not None:
            x.parent.held += x.held
            x.parent.linked += x.linked
            x.parent.article = max(x.parent.article, x.article)
            x.parent.main = x.parent.main or x.main
    live = [x for x in nodes if shown[id(x)]]

    def free() -> list[tuple[Block, int]]:
        for x in nodes:
            x.free = (not x.kind or x.kept) and (x.parent is None or x.parent.free)
        return [(b, n) for b, n in seen if b.node is None or b.node.free]

    free()
    for x in live:
        x.kept = x.kind == "soft" and x.held >= 200 and x.linked <= 0.3 * (x.held + x.linked)
    # an article beside a hinted element: that element holds the page only if it dwarfs the article
    beside = max((x.held for x in live if x.mark and x.kind == "" and (x.parent is None or x.parent.free)), default=0)
    for kinds, by_text in ((("named", "soft"), True), (("named", "soft"), False), (("readers",), True), (("readers",), False)):
        rest = free()
        outside = sum(n for _, n in rest)
        if kinds == ("readers",) and any(first_pass(b, Rules()) == "good" for b, _ in rest):
            break
        for x in live:
            if x.kind in kinds and ((2 * x.held > total and (x.article or x.held > 8 * beside)) or x.main if by_text else x.article > outside):
                x.kept = True
    free()
    for b in found:
        b.left_out = b.node is not None and not b.node.free


def stop_density(text: str) -> float:
    words = [w.lower() for w in WORD.findall(text)]
    counts = [0] * len(STOP_WORDS)
    for hits in filter(None, map(STOP.get, words)):
        for k in hits:
            counts[k] += 1
    return max(counts) / max(len(words), 1)


def foreign(text: str) -> bool:
    """Whether most letters are beyond the Latin ones."""
    letters = [c > "\u024f" for c in text if c.isalpha()]
    return 2 * sum(letters) > len(letters)


def unlisted(blocks: list[Block], r: Rules) -> bool:
    """Whether no listed language fits the page: most of its prose has few stop words."""
    prose = [b for b in blocks if not b.left_out and len(b.text) >= r.short and b.linked <= r.links * len(b.text)]
    fits = sum(len(b.text) for b in prose if stop_density(b.text) >= r.stop_high)
    return 4 * fits < sum(len(b.text) for b in prose)


def first_pass(block: Block, r: Rules, no_list: bool = False) -> str:
    """good, bad, near (nearly good) or short (both undecided); ``no_list``: of a page in no listed language."""
    n = len(block.text)
    density = block.linked / n
    if block.left_out or density > r.links:
        return "bad"
    if n < r.short:
        return "short" if block.linked == 0 else "bad"
    stop = stop_density(block.text)
    if stop >= r.stop_high and not no_list:
        return "good" if n > r.long else "near"
    if no_list or foreign(block.text):
        return "good" if n > r.long or SENTENCE.search(block.text) else "near"
    return "near" if stop >= r.stop_low else "bad"


def raised(label: str, block: Block, r: Rules) -> str:
    """The label of a block within the page's marked article."""
    n = len(block.text)
    if block.left_out:
        return "bad"
    if block.linked > r.links * n:
        return "bad" if n >= r.short or block.linked > 0.9 * n else "short"
    if label == "bad":
        return "near" if n >= r.short else "short"
    return "good" if label != "short" or block.linked == 0 else label


def second_pass(labels: list[str]) -> list[bool]:
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    if not decided:
        return [True] * len(labels)
    before, after, out = [-1] * len(labels), [-1] * len(labels), []
    last = -1
    for i, x in enumerate(labels):
        last = i if x in ("good", "bad") else last
        before[i] = last
    last = -1
    for i in range(len(labels) - 1, -1, -1):
        last = i if labels[i] in ("good", "bad") else last
        after[i] = last
    for i, x in enumerate(labels):
        b, a = before[i], after[i]
        if x in ("good", "bad"):
            out.append(x == "good")
        elif b < 0 or a < 0 or labels[a] == labels[b]:
            out.append(labels[max(a, b) if min(a, b) < 0 else a] == "good")
        elif i - b == a - i:
            out.append(x == "near")
        else:
            out.append(labels[b if i - b < a - i else a] == "good")
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """Blocks of the article, joined by line feeds."""
    if not page:
        return ""
    blocks = blocks_of(page)
    no_list = unlisted(blocks, rules)
    labels = [first_pass(b, rules, no_list) for b in blocks]
    inside = sum(len(b.text) - b.linked for b in blocks if b.article and not b.left_out)
    outside = sum(len(b.text) for b, x in zip(blocks, labels, strict=True) if x == "good" and not b.article)
    if inside and 4 * inside >= outside:
        labels = [raised(x, b, rules) for b, x in zip(blocks, labels, strict=True) if b.article]
        blocks = [b for b in blocks if b.article]
    if "good" not in labels:
        labels = ["good" if x == "near" else x for x in labels]
    keep = second_pass(labels)
    return "\n".join(b.text for b, ok in zip(blocks, keep, strict=True) if ok)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points) of every page."""
    source = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))

    def fn(batch: pa.RecordBatch):
        texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
        yield {k: batch.column(i) for i, k in enumerate(keep)} | {"text": texts, "n_chars": [len(x) for x in texts]}

    fields = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep)
    return map_batches(source, fn, f"{fields}, text string, n_chars long", "__html")
