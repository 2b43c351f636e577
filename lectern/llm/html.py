"""Main text of web pages by two-pass block rules (operator 8).

A page is cut into blocks at its block-level tags.  The first pass decides blocks by what they are and hold:
those in menus, headers, footers, sidebars, forms, notices, adverts and reader comments, and those full of
links, go; long ones dense with stop words stay.  Short blocks, and those of an article whose words say nothing,
are undecided.  The second pass gives them the label of the nearest decided block, of their article if they are
in one; in an article without decided blocks they stay.

Where a page marks its articles or its main part, blocks elsewhere go, unless the running text stands there: a page may
mark up teasers only.  On a page in a language without a stop list, ends of sentences stand for stop words.

A page is read once from its beginning to its end, however its tags are nested or left open.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters below which a block is short, and above which stop words alone decide (those of scripts with a sign a word count double).
SHORT, LONG = 70, 200
#: Shares: of stop words in running text, of link text in lists of links, of stop words under which a page's language is unknown.
STOP_DENSITY, LINK_DENSITY, UNKNOWN_DENSITY = 0.3, 0.34, 0.1
#: Characters for each end of a sentence in running text, at most.
SENTENCE = 300
#: An article whose text is less than this share of the largest one's, and holds no running text, is a teaser.
TEASER = 0.25

#: Frequent function words of some languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on
    one only or our out she so than that the their them then there these they this to up was we were what when which
    who will with would you your
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus
    pour qu que qui sa se ses son sont sur un une vous
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat
    ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war was wie wird zu
    zum zur
    al como con cuando de del el ella ellos en entre era es esta este fue ha hay la las lo los más me mi muy no nos
    o para pero por porque que se ser si sin sobre son su sus también un una uno y ya
    ai che da dei della di e gli ha i il le nel non per più sono
    à ao com da do dos e em foi mais na não nas nos o os ou pela pelo por que seu sua um uma
    de een en het ik is met niet op te van voor zijn
    """.split()
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul title".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and goes.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas audio video select".split())
#: Elements that never hold the main text.
_GONE = frozenset("head nav footer aside form menu dialog button fieldset search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Names (class, id) of parts that are not the main text.
_NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising advertorial adbox adslot sponsored promo promotion promoted sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs comment comments commentlist disqus footer masthead cookie cookies consent gdpr notice notices "
    "popup modal newsletter subscribe signup sharing pagination pager toolbar login signin paywall replies respond".split()
)
#: Names that articles also use for parts of their own: there a long block of running text stays.
_DOUBTFUL = frozenset("banner sponsor alert overlay social share related recommended recommendations widget survey disclaimer copyright".split())
#: Names of parts of the page that an article may use for its own.
_PAGE_NAMES = frozenset("header topbar sidenav aside".split())
#: Words that only say where or in what form a part stands: "comment-list" is a name like "comment", "share-price" is none.
_FORM_WORDS = frozenset(
    "area bar block blocks body bottom box btn button buttons card cards center col column container content desktop feed fixed footer form global group header "
    "head icon icons image inner item items label layout left link links list main message mobile outer page panel policy post posts primary region right "
    "row secondary section site slot small sticky strip text thread title top unit wide wrap wrapper zone".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[^\W\d_]+")
#: Characters of scripts that write about a word a sign, and ends of sentences.
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_END = re.compile("[.!?…](?=\\s|$)|[。！？؟।]")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_PIECE = re.compile(r"[a-z]+")

GOOD, BAD, OPEN = 1, -1, 0
#: Whether an element is part of the text, not, or not unless it holds running text inside an article.
STAYS, GOES, DOUBTFUL = 0, 1, 2


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _named(attributes: dict[str, str], names: frozenset[str]) -> bool:
    """Whether a class or the id is one of the names, alone or with words of form."""
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        pieces = _PIECE.findall(_CAMEL.sub(r"\1 \2", token).lower())
        if not names.isdisjoint(pieces) and all(p in names or p in _FORM_WORDS or p in _NAMES or p in _DOUBTFUL or len(p) == 1 for p in pieces):
            return True
    return False


def _excluded(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """What an element's tag and attributes say about its content."""
    if tag in ("html", "body", "main"):
        return STAYS
    if tag in _GONE or (tag == "header" and not in_article):
        return GOES
    if not attributes:
        return STAYS
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return GOES
    if attributes.get("role", "").lower() in _ROLES:
        return GOES
    if "class" not in attributes and "id" not in attributes:
        return STAYS
    if tag == "article" and not in_article:
        return GOES if _named(attributes, frozenset(("comment", "comments", "ad", "advert", "promo"))) else STAYS
    if _named(attributes, _NAMES) or (not in_article and _named(attributes, _PAGE_NAMES)):
        return GOES
    if _named(attributes, _DOUBTFUL):
        return DOUBTFUL if in_article else GOES
    return STAYS


class _Block:
    """A block's text, how much of it is links, and the region it stands in."""

    __slots__ = ("dense", "full", "heading", "in_header", "label", "links", "parts", "region", "size", "text")

    def __init__(self, region: int, heading: bool, in_header: bool):
        self.region, self.heading, self.in_header = region, heading, in_header
        self.parts: list[str] = []
        self.links = self.size = 0
        self.label, self.text, self.full, self.dense = OPEN, "", False, False


class _Reader:
    """Cuts one page into blocks.

    Regions: 0 is the page, positive numbers are articles and main parts, negative ones excluded elements.  ``kind``
    has the tag of each positive region, ``inside`` the region around each; ``doubtful`` of excluded elements that may
    hold running text the article around them.
    """

    def __init__(self):
        self.out: list[_Block] = []
        self.kind: dict[int, str] = {}
        self.inside: dict[int, int] = {}
        self.doubtful: dict[int, int] = {}
        self.stack: list[tuple[str, int, bool]] = []  # open elements, the region around each, and whether in an article's header
        self.places: dict[str, list[int]] = {}  # of each tag, where it stands on the stack
        self.blocks_open: list[int] = []  # where block elements stand on the stack
        self.region, self.regions, self.in_header, self.heading, self.link = 0, 0, False, False, 0
        self.now = _Block(0, False, False)

    def flush(self) -> None:
        text = " ".join("".join(self.now.parts).split())
        if text:
            self.now.text = text
            self.out.append(self.now)
        self.now = _Block(self.region, self.heading, self.in_header)

    def place(self) -> None:
        """An empty block stands where the reader is."""
        if not self.now.full:
            self.now.region, self.now.heading, self.now.in_header = self.region, self.heading, self.in_header

    def open(self, tag: str) -> None:
        k = len(self.stack)
        self.stack.append((tag, self.region, self.in_header))
        self.places.setdefault(tag, []).append(k)
        if tag in _BLOCKS:
            self.blocks_open.append(k)

    def close(self, k: int) -> None:
        """Leaves the elements from the k-th on."""
        while len(self.stack) > k:
            tag, self.region, self.in_header = self.stack.pop()
            self.places[tag].pop()
            if self.blocks_open and self.blocks_open[-1] == len(self.stack):
                self.blocks_open.pop()
            if tag == "a":
                self.link -= 1
            elif tag[0] == "h" and tag[1:].isdigit():
                self.heading = False

    def words(self, text: str) -> bool:
        """Takes text between tags; says whether it is more than white space."""
        if self.region < 0 <= self.now.region:  # an excluded element inside a line
            return False
        text = unescape(text) if "&" in text else text
        self.now.parts.append(text)
        if text.isspace():
            return False
        self.now.full = True
        if self.link:
            self.now.links += len(" ".join(text.split()))
        return True

    def end(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.flush()
        at = self.places.get(tag)
        if at and not (tag not in _BLOCKS and self.blocks_open and self.blocks_open[-1] > at[-1]):
            self.close(at[-1])
            self.place()

    def imply(self, tag: str) -> None:
        """Ends what cannot hold a block of this kind: an open paragraph, or the list item or cell before it."""
        if self.blocks_open:
            k = self.blocks_open[-1]
            last = self.stack[k][0]
            if (last == "p" and (tag in _ITEMS or self.stack[-1][0] != tag or tag == "p")) or (last == tag and tag in _ITEMS):
                self.flush()
                self.close(k)

    def begin(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in _BLOCKS:
            self.imply(tag)
            self.flush()
        self.open(tag)
        around = self.doubtful.get(self.region, self.region)  # inside what is doubtful parts may yet go for sure
        verdict = _excluded(tag, attributes, around > 0) if around >= 0 else STAYS
        if verdict == GOES or (verdict == DOUBTFUL and self.region >= 0):
            self.regions += 1
            if verdict == DOUBTFUL:
                self.doubtful[-self.regions] = self.region
            self.region = -self.regions
        elif self.region >= 0 and self.kind.get(self.region) != "article":
            kind = "article" if tag == "article" or attributes.get("role") == "article" or attributes.get("itemprop") == "articleBody" else "main" if tag == "main" or attributes.get("role") == "main" else None
            if kind == "article" or (kind == "main" and self.region == 0):
                self.regions += 1
                self.kind[self.regions], self.inside[self.regions] = kind, self.region
                self.region = self.regions
            elif tag == "header" and self.region > 0:
                self.in_header = True
        elif tag == "header" and self.region > 0:
            self.in_header = True
        if tag == "a":
            self.link += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.heading = True
        if tag in _BLOCKS:
            self.place()

    def read(self, html: str) -> None:
        at, n, breaks = 0, len(html), 0
        unending: set[str] = set()  # raw elements that nothing ends from here on
        while at < n:
            m = _TOKEN.search(html, at)
            if self.words(html[at : m.start() if m else n]):
                breaks = 0
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag in _RAW:
                end = None
                if tag not in unending and not m[0].endswith("/>"):
                    end = _RAW_END[tag].search(html, at)
                    if not end:
                        unending.add(tag)
                if end:
                    at = end.end()
                elif tag in ("script", "style", "textarea"):
                    at = n
                self.now.parts.append(" ")
            elif tag == "br":
                breaks += 1
                self.now.parts.append(" ")
                if breaks == 2:
                    self.flush()
            elif tag in _VOID:
                if tag == "hr":
                    self.flush()
            else:
                self.begin(tag, _attributes(m[3]))
        self.flush()


_ITEMS = frozenset("li dt dd tr td th option".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}


def _measure(page: list[_Block]) -> None:
    """Sizes of blocks, and whether they are running text: dense with stop words, or with sentences where no stop list fits the page."""
    counts = []
    for b in page:
        words = _WORD.findall(b.text.lower())
        counts.append((sum(w in STOP_WORDS for w in words), len(words)))
        b.size = len(b.text) + (0 if b.text.isascii() else len(_WIDE.findall(b.text)))
    long = [c for b, c in zip(page, counts, strict=True) if b.size >= SHORT and b.links <= LINK_DENSITY * len(b.text)]
    known = sum(s for s, _ in long) >= UNKNOWN_DENSITY * sum(n for _, n in long)
    for b, (stops, n) in zip(page, counts, strict=True):
        b.dense = stops >= STOP_DENSITY * n > 0 if known else len(_END.findall(b.text)) * SENTENCE >= b.size > 0


def _first_label(b: _Block, in_article: bool) -> int:
    """What a block's place and words decide."""
    if b.in_header and not b.heading:
        return BAD
    if b.links > LINK_DENSITY * len(b.text):
        return BAD
    if in_article:
        return GOOD if b.size >= SHORT and b.dense else OPEN
    if "©" in b.text:
        return BAD
    if b.size < SHORT:
        return BAD if b.links else OPEN
    if b.dense:
        return GOOD if b.size >= LONG else OPEN
    return BAD if b.size >= LONG or not any(c.isalpha() for c in b.text) else OPEN


def _containers(page: list[_Block], reader: _Reader) -> dict[int, int]:
    """Of each region whose blocks may stay, the region they are judged in.

    Articles are the text if they hold at least as much as the running text outside them; else the main part with all in
    it is, by the same measure; else the page.
    """
    kind, inside = reader.kind, reader.inside
    held: dict[int, int] = dict.fromkeys(kind, 0)  # characters of each region's own blocks
    running: dict[int, int] = {}  # of long running text
    for b in page:
        if b.region >= 0 and b.links <= LINK_DENSITY * len(b.text):
            held[b.region] = held.get(b.region, 0) + b.size
            if b.size >= LONG and b.dense:
                running[b.region] = running.get(b.region, 0) + b.size
    articles = [r for r in kind if kind[r] == "article"]
    mains = [r for r in kind if kind[r] == "main"]
    if articles and sum(held[r] for r in articles) >= sum(v for r, v in running.items() if r not in kind or kind[r] == "main"):
        most = max(held[r] for r in articles)
        return {r: r for r in articles if r in running or held[r] >= TEASER * most}
    if mains and sum(held[r] for r in mains) + sum(held[r] for r in articles if inside[r]) >= running.get(0, 0):
        return {r: r for r in mains} | {r: inside[r] for r in articles if inside[r]}
    return dict.fromkeys((0, *kind), 0)


def _second_labels(blocks: list[_Block], decided: list[tuple[int, int]], places: list[int], otherwise: int) -> None:
    """Gives undecided blocks (at ``places``) the label of the nearest decided one; of two as near the better one."""
    at = 0
    for b, k in zip(blocks, places, strict=True):
        if b.label != OPEN:
            continue
        while at < len(decided) and decided[at][0] < k:
            at += 1
        before, after = decided[at - 1] if at else None, decided[at] if at < len(decided) else None
        if before is None or after is None:
            one = before or after
            b.label = one[1] if one else otherwise
        elif k - before[0] == after[0] - k:
            b.label = max(before[1], after[1])
        else:
            b.label = (before if k - before[0] < after[0] - k else after)[1]


def classify(reader: _Reader) -> list[_Block]:
    """The blocks with their labels: first what decides itself, then the rest by the nearest decided block."""
    page = reader.out
    _measure(page)
    judged = _containers(page, reader)
    own: dict[int, list[int]] = {}
    for k, b in enumerate(page):
        region = b.region
        if region < 0:
            region = reader.doubtful.get(region, -1)
            if not (region > 0 and b.size >= LONG and b.dense):
                region = -1
        where = judged.get(region, -1)
        if where < 0:
            b.label = BAD
        else:
            b.label = _first_label(b, where > 0)
            own.setdefault(where, []).append(k)
    everything = [(k, b.label) for k, b in enumerate(page) if b.label != OPEN and not b.in_header]
    for where, places in own.items():
        blocks = [page[k] for k in places]
        decided = everything if where == 0 else [(k, b.label) for k, b in zip(places, blocks, strict=True) if b.label != OPEN and not b.in_header]
        _second_labels(blocks, decided, places, GOOD if where > 0 else BAD)
    return page


def main_text(html: str | None) -> str:
    """The blocks of the main text in page order, joined by a blank line; empty if there are none."""
    if not html:
        return ""
    reader = _Reader()
    reader.read(html)
    return "\n\n".join(b.text for b in classify(reader) if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page.

    Null and empty pages, and pages without main text, give the empty text with 0 characters.  Nothing of a long
    page is cut, and its time grows with its length only.  Of two neighbours as near as each other, one that stays decides.
    Repeated rows, and rows without page_id, each give a row; other columns play no part; an empty table gives no rows.
    """

    def step(batches):
        for batch in common.pieces(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield common.batch_of(page_id=batch.column("page_id"), url=batch.column("url"), text=texts, n_chars=pa.array([len(t) for t in texts], pa.int64()))

    return common.arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), step, "page_id long, url string, text string, n_chars long")
