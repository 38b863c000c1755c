"""Main text of web pages by two passes of rules over blocks."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow

# Stop words, block tags, and what the parts that aren't main text are called.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you",
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im in ist mit nach nicht oder sich sie sind so und von war wie wird zu zum zur",
    "fr": "à au aux avec ce ces cette d dans de des du elle en est et être il ils je la le les leur mais ne nous ont ou par pas plus pour que qui sa se ses son sont sur un une vous",
    "es": "a al como con de del el ella en entre era es esta este ha la las le lo los más me no o para pero por que se ser si sin sobre son su sus un una y ya",
    "it": "a al che con da del della di e è gli i il in la le lo ma nel non o per più se si sono un una",
    "pt": "a ao as com como da das de do dos e em é for mais na nas no nos não o os ou para por que se sem seu sua um uma",
    "nl": "aan als bij dat de den der die een en er het hij ik in is je met naar niet of om op te uit van voor was wat ze zijn",
}
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = set("head script style noscript template iframe object svg math canvas audio video map datalist".split())
VERBATIM = set("pre table".split())
ZONES = set("nav footer aside form menu button select textarea fieldset dialog".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = set("article main".split())
ZONE_NAME = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|comments?|commentlist|disqus|respond|repl(?:y|ies)|nav\w*|menu\w*|breadcrumbs?|pag(?:er|ination)|sidebars?|aside|widgets?|footer|masthead|topbar|header|related|recommend\w*|share\w*|sharing|social|subscri\w*|newsletter|signup|login|popup|modal|overlay|copyright|legal|skip|toolbar|tags)(?:$|[_-])|^(?:left|right)?[_-]?side$",
    re.I,
)
ZONE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Parts of a name that say what a page or its layout has, or hasn't, and not what an element is.
MODIFIERS = set("has no with without is not show hide hidden".split())
LAYOUTS = set("layout page template grid".split())
CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:$|[\s_-])", re.I)
WORD = re.compile(r"[^\W\d_]+")

#: Of each stop word the languages that have it, by number.
_stops: dict[str, list[int]] = {}
for _n, _words in enumerate(STOP_WORDS.values()):
    for _w in set(_words.split()):
        _stops.setdefault(_w, []).append(_n)
# Thresholds of the first pass.
LONG, STOPS, LINKS, SHORT = 70, 0.12, 0.33, 200


#: What an element is in that isn't main text: a form, something by its name, something by its tag or role.
FORM, NAMED, TAGGED = 1, 2, 3

Block = tuple[str, int, int, int, bool]

# One token from "<" on: a comment, what browsers treat as one, or a tag with its attributes. No part of
# a match is given back, so a page is read in time linear in its length.
TOKEN = re.compile(
    r"""<(?:!--(?:-?>|[\s\S]*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/[^a-zA-Z>][^>]*+(?:>|\Z)|/>
    |(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+(?>"[^"]*+"|'[^']*+')|["'=])*+)(?:>|\Z))""",
    re.X,
)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
RAW = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in ("script", "style")}
#: Decimal references of more digits than Python turns into a number; no character has such a one.
ENDLESS = re.compile(r"&#[0-9]{4000,};?")


def decoded(text: str) -> str:
    return unescape(ENDLESS.sub("\ufffd", text)) if "&" in text else text


def names_zone(token: str, in_content: bool) -> bool:
    """Whether a class or id says that an element isn't main text; in an article a header is part of it."""
    found = ZONE_NAME.search(token)
    if not found:
        return False
    parts = [x for x in re.split("[_-]+", token.lower()) if x]
    at = len([x for x in re.split("[_-]+", token[: found.end()].lower()) if x])
    if parts[-1] in LAYOUTS or any(x in MODIFIERS for x in parts[: max(0, at - 1)]):
        return False
    return not (in_content and parts[at - 1] == "header")


class Blocks:
    """Blocks of a page in order: [text, characters in links, zone, content part, code or table]."""

    def __init__(self, html: str) -> None:
        self.out: list[Block] = []
        self.open: list[tuple[str, bool, int, int]] = []  # tag, skipped, zone, content part
        self.count: Counter[str] = Counter()  # open elements by tag
        self.text: list[str] = []
        self.linked = 0
        self.parts = 0
        at = 0
        while found := TOKEN.search(html, at):
            self.data(html[at : found.start()])
            at = found.end()
            close, tag, attributes = found.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if close:
                self.end(tag)
                continue
            self.start(tag, attributes)
            if tag in RAW:
                raw = RAW[tag].search(html, at)
                at = raw.start() if raw else len(html)
            last = (attributes.split() or [""])[-1]
            if tag not in VOID and last.endswith("/") and ("=" not in last or last[-2:-1] in ("'", '"')):
                self.end(tag)
        self.data(html[at:])
        self.end_block()

    def state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0)

    def end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            verbatim = any(self.count[x] for x in VERBATIM)
            self.out.append((text, min(self.linked, len(text)), *self.state()[1:], verbatim))
        self.text, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("br", "hr"):
            self.text.append(" ")
        if tag in BLOCKS:
            self.end_block()
        if tag in VOID:
            return
        if tag == "p" and any(x[0] == "p" for x in self.open[-3:]):
            self.leave("p")
        skipped, zone, part = self.state()
        have: dict[str, str] = {}
        for name, *value in ATTRIBUTE.findall(attributes):
            have.setdefault(name.lower(), decoded("".join(value)))
        named = f"{have.get('class', '')} {have.get('id', '')}".strip()
        hidden = "hidden" in have or have.get("aria-hidden") == "true" or "display:none" in have.get("style", "").replace(" ", "").lower()
        out_of_place = any(names_zone(x, part > 0) for x in named.split())
        if tag in CONTENT or (not part and CONTENT_NAME.search(named) and not out_of_place):
            self.parts += 1
            part = self.parts
            if zone == FORM or (zone == NAMED and tag == "main"):  # a form may be around a page, and names around its main part say little
                zone = 0
        role = have.get("role", "").lower()
        if tag == "form" or role == "form":
            zone = max(zone, FORM)
        elif tag in ZONES or (tag == "header" and not part) or role in ZONE_ROLES:
            zone = TAGGED
        elif out_of_place and tag not in ("html", "body", *CONTENT):
            zone = max(zone, NAMED)
        self.open.append((tag, skipped or hidden or tag in SKIPPED, zone, part))
        self.count[tag] += 1

    def leave(self, tag: str) -> None:
        """Close the last open ``tag`` and what is open in it; nothing if none is open."""
        if self.count[tag]:
            inner = ""
            while inner != tag:
                inner = self.open.pop()[0]
                self.count[inner] -= 1

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_block()
        self.leave(tag)

    def data(self, text: str) -> None:
        if text and not self.state()[0]:
            text = decoded(text)
            self.text.append(text)
            if self.count["a"]:
                self.linked += len(text.strip())


def width(text: str) -> int:
    """Characters of ``text``, those of double width twice; there are none of these before U+1100."""
    return len(text) if max(text) < "\u1100" else len(text) + sum(unicodedata.east_asian_width(c) in "WF" for c in text)


def stop_share(text: str) -> float:
    """The share of stop words among the words of ``text``, in the language that has most of them."""
    words = WORD.findall(text.lower())
    count = [0] * len(STOP_WORDS)
    for w in words:
        for n in _stops.get(w, ()):
            count[n] += 1
    return max(count) / max(1, len(words))


def labels(blocks: list[Block]) -> list[bool]:
    """Whether each block is main text.

    First pass: parts that are named as something else and blocks that are mostly links are
    not; blocks with enough stop words are, if long, or if they stand in an article; long
    blocks outside any article without stop words are not, unless they are code or a table. What
    is left is ambiguous.

    Where less than half of the long text outside such parts has enough stop words, the page is in a
    language without a list, and length decides in their place: long blocks are main text, and
    so are the short ones of an article that has no long one.

    Second pass: an ambiguous block takes the label of the nearest decided block of its article, or
    outside articles of the page; of two equally near ones the one before. Where nothing is
    decided, blocks of an article are main text and others are not.
    """
    apart = [zone or linked > LINKS * len(text) for text, linked, zone, _, _ in blocks]
    stopped = [not out and stop_share(b[0]) >= STOPS for b, out in zip(blocks, apart, strict=True)]
    size = [width(b[0]) for b in blocks]
    prose = [i for i, b in enumerate(blocks) if not apart[i] and not b[4]]
    known = sum(size[i] for i in prose if stopped[i])
    listed = 2 * known >= sum(size[i] for i in prose if stopped[i] or size[i] >= LONG) > 0
    with_long = {blocks[i][3] for i in range(len(blocks)) if not apart[i] and size[i] >= LONG}
    first: list[bool | None] = []
    for i, (text, _, _, part, verbatim) in enumerate(blocks):
        if apart[i]:
            first.append(False)
        elif stopped[i] and (len(text) >= LONG or part):
            first.append(True)
        elif not listed and (size[i] >= LONG or (part and part not in with_long)):
            first.append(True)
        elif len(text) >= SHORT and not part and not verbatim:
            first.append(False)
        else:
            first.append(None)
    before, after = nearest_decided(first, blocks, 1), nearest_decided(first, blocks, -1)
    out = []
    for i, label in enumerate(first):
        if label is None:
            near = [(abs(j - i), j) for j in (before.get(i), after.get(i)) if j is not None]
            label = first[min(near)[1]] if near else blocks[i][3] > 0
        out.append(bool(label))
    return out


def nearest_decided(first: list[bool | None], blocks: list[Block], step: int) -> dict[int, int]:
    """Of each ambiguous block, the last decided one that is met before it in steps of ``step``, of its part or, outside parts, of all."""
    seen: dict[int, int] = {}
    out = {}
    for i in range(len(first))[::step]:
        part, zone = blocks[i][3], blocks[i][2]
        if first[i] is not None:
            seen[0] = i
            if not zone:
                seen[part] = i
        elif part in seen:
            out[i] = seen[part]
    return out


def main_text(html: str) -> list[str]:
    blocks = Blocks(html).out
    return [b[0] for b, kept in zip(blocks, labels(blocks), strict=True) if kept]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id``, ``url``, ``blocks`` (main text in page order).

    Character references are decoded and white space inside a block is one space. Any text is a page: a comment or
    script that is not closed, and a tag without its end, go on to the page's end, as in browsers; marked
    sections are comments. The time is linear in a page's length, however its elements are nested. Null and empty
    pages, and pages without main text, have no blocks. Rows are judged alone, so repeated rows
    agree. An empty table gives an empty result. Columns not named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) if x.is_valid else [] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["page_id", "url", "blocks"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return map_arrow(rows, run, f"page_id {kind}, url string, blocks array<string>")


def pages_digest(found: DataFrame) -> DataFrame:
    text = F.array_join("blocks", "\n")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
