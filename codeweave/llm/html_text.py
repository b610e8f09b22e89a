"""Main text of web pages by two-pass block rules.

Pass one looks at each block alone: its place (article, or menus, footers,
adverts, forms, comments and the like), its length, link density and stop-word
density make it text, boilerplate or, if short, undecided. Where the page's words
are hardly any of the stop words, its language isn't listed, and the ends of sentences
stand for them; characters of scripts without spaces count as three. Pass two lets an
undecided block inherit the label of the nearest decided neighbour, of its own
section first; on equal distance text wins. If no block of a page is decided to be text,
undecided ones that aren't short or end a sentence are.

A page that marks its article keeps all of it. Names in class, id or role mark boilerplate only as a whole: each of a name's words
is one of boilerplate or of place; and most of them only outside the article. Text is hidden by the attribute, by a class of just that name or by
its style. A form outside a marked article may hold the whole page, so its blocks are judged by pass one.

Nulls, empty pages and pages of boilerplate only give an empty text. Unclosed elements end with what holds them,
unclosed comments and scripts with the page. Very long pages are read in one pass, in linear time. Repeated rows are extracted each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, unused

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be by for from have in is it not of on or that the this to was were with you "
    "auf aus das dem den der des die ein eine für ich im ist mit nicht sich sie sind und von wie zu "
    "au avec ce dans de du elle en est et il la le les ne pas par pour que qui sur un une "
    "al como con del el es las los más no para pero por se su y".split()
)
#: Elements whose text is never shown or never prose.
RAW = frozenset("script style template noscript textarea title svg math iframe object canvas audio video select option datalist".split())
#: Those whose content runs to the page's end if they aren't closed.
TO_END = frozenset("script style template textarea title".split())
#: Elements that hold boilerplate.
OUTSIDE = frozenset("nav footer aside dialog menu button fieldset".split())
#: Words of names that mark boilerplate anywhere, readers' and related items among them.
STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices newsletter newsletters "
    "subscribe subscription sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs comment comments reply replies disqus share sharing related recommended".split()
)
HARD_WORDS = frozenset("comment comments related recommended reply replies disqus sidebar sidebars".split())
#: Words that mark boilerplate outside the article.
WEAK_WORDS = frozenset(
    "banner banners alert alerts popup modal overlay footer masthead respond social widget widgets toolbar legal login signup search pagination pager skip contentinfo complementary".split()
)
#: Words of place or kind, which names of boilerplate also hold.
PLACE_WORDS = frozenset(
    "site page main top bottom left right upper lower primary secondary global inner outer box bar area block section container wrapper wrap list items item group panel slot unit "
    "text message form buttons button links link posts post articles stories thread body content header head title icons bar1 bar2 col column row".split()
)
#: Marks that stand for boilerplate only outside the article.
PAGE_HEADER = frozenset(["header", "topbar"])
MAIN_WORDS = frozenset(["article", "main"])
_KNOWN = STRONG_WORDS | WEAK_WORDS | PLACE_WORDS | PAGE_HEADER | MAIN_WORDS
#: Words of place that say something if they are the whole name.
_ALONE = MAIN_WORDS | PAGE_HEADER
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPENS_NOTHING = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li tr td th thead tbody tfoot pre address".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|<(/?)([a-zA-Z][^\s/<>]*)[^<>]*>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?")
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Characters of scripts that write no spaces, and ends of sentences.
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_END = re.compile(r"[.!?…]+(?=[\s\"'»”’)\]]|$)|[。！？।؟۔]")
_WORD = re.compile(r"[^\W_]+")


@dataclass(slots=True)
class Block:
    text: str
    zone: str  # main, out, form or open
    link_chars: int
    heading: bool = False


@dataclass(slots=True)
class _Open:
    tag: str
    zone: str
    hard: bool = False  # holds comments, related items: no article inside counts
    marks: frozenset = field(default_factory=frozenset)


def _marks(attributes: str) -> tuple[set[str], bool, bool]:
    """(whole names of boilerplate as their words, whether it is hidden, whether it is hidden from readers' aids)."""
    words: set[str] = set()
    hidden = unread = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            unread = value.lower() == "true"
        elif name == "style":
            hidden = hidden or bool(_UNSHOWN.search(value))
        elif name in ("class", "id", "role"):
            for whole in value.split():
                parts = {w.lower() for w in _PIECES.findall(whole)}
                hidden = hidden or name == "class" and parts == {"hidden"}
                if parts and parts <= _KNOWN:
                    words |= parts - PLACE_WORDS | (parts & _ALONE if len(parts) == 1 else set())
    return words, hidden, unread


def blocks(page: str) -> Iterator[Block]:
    """The page's visible blocks in order, each with the section it stands in."""
    stack = [_Open("", "open")]
    parts: list[str] = []
    linked = 0
    in_link = heading = False
    at, size = 0, len(page)
    unclosed: set[str] = set()
    depth: Counter[str] = Counter()

    def flush() -> Iterator[Block]:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                yield Block(text, stack[-1].zone, linked, heading)
            parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if not end:
                    unclosed.add(tag)
                at = end.end() if end else size if tag in TO_END else at
            continue
        if tag == "a":
            in_link = not closing
        if tag in INLINE:
            continue
        if tag in ("br", "wbr"):
            parts.append(" ")
            continue
        yield from flush()
        if tag in VOID:
            continue
        if tag in _OPENS_NOTHING:
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag not in ("li", "td", "th", "dd", "dt"):
                in_link = False
            continue
        heading = in_link = False
        if closing:
            while depth[tag]:
                done = stack.pop().tag
                depth[done] -= 1
                if done == tag:
                    break
            continue
        if attributes.endswith("/"):
            continue
        if tag == "body":
            stack[:] = [o for o in stack if o.tag != "head"]
            depth["head"] = 0
        above = stack[-1]
        marks, hidden, unread = _marks(attributes) if tag not in ("html", "body") else (set(), False, False)
        zone, hard = above.zone, above.hard
        main = tag in MAIN_WORDS or bool(marks & MAIN_WORDS) and tag in ("div", "section")
        outside = marks & STRONG_WORDS or zone != "main" and marks & WEAK_WORDS
        if tag == "head" or hidden or unread and zone != "main":
            zone, hard = "out", tag != "head"
        elif tag in OUTSIDE or outside and not (tag in MAIN_WORDS and not marks & HARD_WORDS):
            zone = "out"
            hard = hard or tag in ("aside", "footer", "dialog") or bool(marks & HARD_WORDS)
        elif main:
            zone = zone if hard else "main"
        elif tag == "form" and zone != "out":
            zone = "form"
        elif zone != "main" and (tag == "header" or marks & PAGE_HEADER):
            zone = "out"
        stack.append(_Open(tag, zone, hard))
        depth[tag] += 1
    yield from flush()


def density(text: str) -> tuple[float, int]:
    words = _WORD.findall(text.lower())
    return (sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0), len(words)


def main_blocks(found: list[Block], short: int = 70, long: int = 200, links: float = 0.33, stops: float = 0.3) -> list[Block]:
    """Pass one and pass two over a page's blocks; what is text, in page order."""
    marked = any(b.zone == "main" for b in found)
    judged = [] if marked else [i for i, b in enumerate(found) if b.zone != "out"]
    shares = {i: density(found[i].text) for i in judged}
    words = sum(n for _, n in shares.values())
    listed = sum(share * n for share, n in shares.values()) >= stops / 3 * words
    labels: list[bool | None] = []
    for i, b in enumerate(found):
        n = len(b.text)
        if b.zone == "out" or marked and b.zone != "main":
            labels.append(False)
        elif b.zone == "main":
            labels.append(True if n >= short and not b.heading else None)
        elif b.link_chars > links * n:
            labels.append(False)
        else:
            labels.append(_alone(b, shares[i][0], listed, short, long, stops))
    if judged and True not in labels:
        labels = [True if label is None and not b.heading and (len(b.text) >= short or _END.search(b.text)) else label for b, label in zip(found, labels, strict=True)]
    near = _nearest(found, labels)
    out = []
    for b, label, n in zip(found, labels, near, strict=True):
        if label is None:
            label = not min(n)[1] if n else b.zone == "main"
        if label:
            out.append(b)
    return out


def _alone(b: Block, share: float, listed: bool, short: int, long: int, stops: float) -> bool | None:
    """A block's label by its own length and density, stop words standing aside for ends of sentences where the language isn't listed."""
    n = len(b.text) + 2 * len(_WIDE.findall(b.text))
    if n < short or b.heading:
        return None
    ends = len(_END.findall(b.text))
    if not listed:
        return True if ends else None
    if share >= stops or ends and share >= stops / 2 or n >= long and (share >= stops / 2 or ends > 1):
        return True
    return False if n < long and not ends else None


def _nearest(found: list[Block], labels: list[bool | None]) -> list[list[tuple[int, bool]]]:
    """(distance, whether boilerplate) of each undecided block's decided neighbours of its section, one on either side; two linear passes."""
    near: list[list[tuple[int, bool]]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[str, int] = {}
        for i in order:
            zone, label = found[i].zone, labels[i]
            if label is not None:
                last[zone] = i
            elif zone in last:
                near[i].append((abs(last[zone] - i), not labels[last[zone]]))
    return near


def main_text(page: str | None) -> tuple[str, int, int]:
    """(main text, its blocks, all blocks) of a page."""
    found = list(blocks(page or ""))
    kept = main_blocks(found)
    return " ".join(b.text for b in kept), len(kept), len(found)


def visible_text(page: str | None) -> str:
    """All shown text, a line for each block."""
    return "\n".join(b.text for b in blocks(page or ""))


def extract(df: DataFrame, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all but the page) with main_text string, n_main_blocks and n_blocks int; one narrow pass."""
    new = ["main_text", "n_main_blocks", "n_blocks"]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {html_col.lower(), *new}]
    page = unused(keep, "html")[0]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias(page))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, page):
                got = [main_text(x) for x in batch.column(page).to_pylist()]
                cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], names=[*keep, *new])

    return source.mapInArrow(run, source.drop(page).schema.add("main_text", "string").add("n_main_blocks", "integer").add("n_blocks", "integer"))
