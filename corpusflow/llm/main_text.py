"""HTML extraction by line-block distribution.

Markup is stripped into lines, one per block of the page. Text lengths are summed over sliding windows
of lines; where the sum rises to that of a text is a surge, where it falls to nothing a dive, and the
text between belongs together. Link texts weigh nothing. Containers that never hold main text (menus,
footers, adverts, forms, scripts ...) and the borders of sections count as empty lines; an article is
evidence that adds to the sums.
"""
from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.arrays import struct

#: Lines of one window; as many empty lines stand for a stripped container.
WINDOW = 3
#: Text a window needs for a run to count as main text where a page names no article.
SURGE = 80

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.S)
#: Elements whose content is skipped up to their end tag, or the end of the page.
_RAW = re.compile(r"script|style|noscript|template|textarea|title", re.I)
#: Elements inside lines that hold no text of theirs; one that is left open ends with the element around it or before
#: one that cannot be inside it.
_SKIPPED = frozenset("select datalist optgroup option button label annotation annotation-xml".split())
_ENDS_SKIPPED = frozenset("article main section header nav p h1 h2 h3 h4 h5 h6 ul ol table blockquote pre".split())
_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_APART = frozenset("nav footer aside form menu dialog head fieldset".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose bare text may be a menu as well as a paragraph.
_BARE = frozenset("div section center td th header address".split())
#: Lists and tables, whose items stand in the element around them; an item's own text too.
_THROUGH = frozenset("ul ol li dl dd dt table thead tbody tfoot tr caption blockquote".split())
_ITEMS = frozenset("h1 h2 h3 h4 h5 h6 p li dd dt pre td th caption summary figcaption div address blockquote".split())
#: Headings, paragraphs and the like: text, however they are named.
_TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p dt dd pre blockquote figcaption caption legend summary".split())
#: Names of containers that hold no main text, as a whole class, also inside an article.
_WHOLE = frozenset("""ad ads advert adverts advertisement advertising adsense advert-box sponsor sponsored promo promotion sidebar nav navbar navigation menu
 breadcrumb breadcrumbs cookie cookies cookie-notice cookie-banner consent popup modal newsletter subscribe signup login share sharing social related
 recommended comment comments comment-list comments-area replies respond disqus widget toolbar pagination pager hidden""".split())
#: The same outside an article, there also as a whole id.
_OUTSIDE = _WHOLE | frozenset("side header masthead footer foot banner notice notices alert overlay search legal copyright skip form dialog".split())
#: Roles of such containers, anywhere.
_ROLES = frozenset("navigation search complementary contentinfo banner dialog alertdialog menu menubar toolbar".split())
#: Parts of a class, or of a div's id, that tell such a container outside an article.
_PARTS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs
 masthead footer cookie cookies consent popup modal newsletter subscribe signup login share sharing related recommended comments disqus widget toolbar
 pagination pager copyright""".split())
#: Words that tell such a container inside an article where all words of a class, or of an id, are of these or the next.
_TELLING = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo sidebar navbar breadcrumb breadcrumbs cookie cookies
 consent popup modal newsletter subscribe notice notices comments disqus respond replies pagination pager widget toolbar""".split())
_LAYOUT = frozenset("""left right top bottom inner outer box wrapper wrap container block area section list slot unit item small large wide main site page
 post article reader readers user users the thread form bar text content""".split()) | {""}
#: Items of a list that are links and nothing else, from so many on, are a menu.
MENU = 3
#: An article that is named so is a reader's comment, a teaser or an advert.
_NO_ARTICLE = frozenset("comment comments reply replies related recommended teaser ad advert advertisement sponsored promo".split())
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)


def _attributes(text: str) -> dict[str, str]:
    """Attributes by name; of those that repeat, the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return out


def _has_part(names: list[str]) -> bool:
    """Whether a hyphened name has a telling part; ``has-sidebar`` tells what a container holds, not what it is."""
    return any(not _PARTS.isdisjoint(parts) for parts in (re.split(r"[-_\d]+", n) for n in names) if parts[0] not in ("has", "with", "no", "without"))


def _tells(names: list[str]) -> bool:
    """Whether a name says nothing but that it holds no main text: ``sidebar-left``, ``advert-300``, ``reader-comments``."""
    words = [set(re.split(r"[-_\d]+", n)) for n in names]
    return any(w <= _TELLING | _LAYOUT and not w.isdisjoint(_TELLING) for w in words)


def _is_unseen(own: dict[str, str]) -> bool:
    return "hidden" in own or bool(_UNSEEN.search(own.get("style", "")))


def _is_apart(name: str, text: str, in_main: bool) -> bool:
    """Whether a block holds no main text: by its element, as hidden, or, for containers, by name."""
    if name in _APART or (name == "header" and not in_main):
        return True
    if not text or name in ("html", "body", "main"):
        return False
    own = _attributes(text)
    if _is_unseen(own) or own.get("aria-hidden", "").strip().lower() == "true":
        return True
    if name in _TEXTS:
        return False
    classes, roles = own.get("class", "").lower().split(), own.get("role", "").lower().split()
    if not _ROLES.isdisjoint(roles):
        return True
    if name == "article":
        return not _NO_ARTICLE.isdisjoint(classes)
    ids = [own["id"].strip().lower()] if "id" in own else []
    if in_main:
        return name != "header" and (not _WHOLE.isdisjoint(classes) or _tells(classes + ids))
    return not _OUTSIDE.isdisjoint(classes + ids) or _has_part(classes + (ids if name in ("div", "ul", "ol", "table") else []))


class Line(NamedTuple):
    """A block of a page; its text is empty where something was stripped or a section ends."""
    text: str
    #: Characters outside links.
    own: int = 0
    #: Where it stands: "article", "main" or neither.
    inside: str = ""
    #: Its element, and the number of the element around it (lists and tables are looked through).
    name: str = ""
    around: int = 0
    #: The number of the list it is an item of.
    of_list: int = 0


def lines_of(page: str) -> tuple[list[Line], bool]:
    """The blocks of a page, and whether an article was opened outside what is stripped."""
    lines: list[Line] = []
    parts: list[str] = []
    linked: list[str] = []
    open_tags: list[str] = []
    # of each open block, the nearest block at or above it that is no list or table, and the nearest list
    around: list[tuple[int, int]] = [(0, 0)]
    opened = link = False
    count = 0
    main = article = apart = 0  # depths of open articles; depth of the stack where a stripped container began
    at, size = 0, len(page)

    def add(text: str) -> None:
        parts.append(text)
        if link:
            linked.append(text)

    def close_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        shared = len(" ".join(html.unescape("".join(linked)).split())) if linked else 0
        parts.clear()
        linked.clear()
        if text:
            name = open_tags[-1] if open_tags else ""
            lines.append(Line(text, max(len(text) - shared, 0), "article" if article else "main" if main else "", name,
                              around[-2 if name in _ITEMS and len(around) > 1 else -1][0], around[-1][1]))

    def gap() -> None:
        close_block()
        if lines and lines[-1].text:
            lines.append(Line(""))

    while at < size:
        tag = _TAG.search(page, at)
        if tag is None:
            if not apart:
                add(page[at:])
            break
        if not apart:
            add(page[at:tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if not closing and _RAW.fullmatch(name) and not tag[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "iframe" and not closing:  # one that is never closed hides nothing
            end = re.compile(r"</iframe\s*>", re.I).search(page, at)
            at = end.end() if end else at
            continue
        if name == "br" and not apart:
            add(" ")
        if name == "a" and not apart:
            link = not closing and "href" in _attributes(tag[3])
        inline = name not in _BLOCKS
        if inline and not (name in _SKIPPED or apart and name == open_tags[apart - 1]
                           or not closing and not apart and tag[3] and name not in _VOID and _is_unseen(_attributes(tag[3]))):
            continue
        if inline and not closing:
            if name == "option" and open_tags and open_tags[-1] == "option":
                open_tags.pop()  # the next option ends the one before
                around.pop()
                apart = 0 if apart > len(open_tags) else apart
            if not tag[3].endswith("/"):
                open_tags.append(name)
                around.append(around[-1])
                apart = apart or len(open_tags)
            continue
        if closing:
            if name not in open_tags:
                if name == "p" and not apart:
                    close_block()
                continue
            while True:  # what was left open inside ends too
                if not apart:
                    close_block()
                done = open_tags.pop()
                around.pop()
                if apart and len(open_tags) < apart:
                    apart = 0
                    link = False
                if done in _MAIN and not apart:
                    gap()
                    main -= 1
                    article -= done == "article"
                if done == name:
                    break
            continue
        if apart and open_tags[apart - 1] in _SKIPPED and (name in _ENDS_SKIPPED or open_tags[apart - 1] not in ("button", "label")):
            del open_tags[apart - 1:], around[apart:]
            apart = 0
        if name == "p" and open_tags and open_tags[-1] == "p":
            if not apart:
                close_block()
            open_tags.pop()
            around.pop()
        if not apart:
            close_block()
        if name in _VOID or tag[3].endswith("/"):
            continue
        open_tags.append(name)
        count += 1
        around.append((around[-1][0] if name in _THROUGH else count, count if name in ("ul", "ol") else around[-1][1]))
        if not apart and _is_apart(name, tag[3], main > 0):
            gap()
            apart = len(open_tags)
        elif not apart and name in _MAIN:
            gap()
            main += 1
            article += name == "article"
            opened = True
    if not apart:
        close_block()
    return lines, opened


def runs_of(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Runs of lines (start, end, largest window sum) between a surge and the dive after it.

    A window begins at its line; an empty line counts as a whole window of them.
    """
    runs, start, peak = [], None, 0
    for i in range(len(lengths) + 1):
        inside = i < len(lengths) and lengths[i] > 0
        if inside:
            end = i
            while end < min(len(lengths), i + window) and lengths[end]:
                end += 1
            block = sum(lengths[i:end])
            start, peak = (i, block) if start is None else (start, max(peak, block))
        elif start is not None:
            runs.append((start, i, peak))
            start, peak = None, 0
    return runs


def _weight(line: Line) -> int:
    """What a line counts in the window sums: its characters, none for links, more inside an article."""
    if line.inside == "article":
        return len(line.text) + SURGE
    if 2 * line.own < len(line.text):
        return 0
    return line.own + SURGE * (line.inside == "main")


def _kept(lines: list[Line], weights: list[int], runs: list[tuple[int, int, int]], least: int) -> set[int]:
    """Lines between a surge and a dive.

    Where a window's sum reaches ``least``, its longer lines and headings are text. Text goes on over shorter lines up
    to the next such window, unless a whole window of lines weighs nothing, and to the paragraphs and items
    that stand in the same element as a longer line, also past a stripped container.
    """
    core: set[int] = set()
    dense: set[int] = set()
    between: set[int] = set()
    for start, end, _ in runs:
        for i in range(start, max(start + 1, end - WINDOW + 1)):
            window = range(i, min(i + WINDOW, end))
            if sum(weights[k] for k in window) >= least:
                dense.update(window)
                core.update(k for k in window if weights[k] * WINDOW >= least)
        last, nothing = None, 0
        for i in range(start, end):
            nothing = 0 if weights[i] else nothing + 1
            if nothing == WINDOW:
                last = None
            if i in core:
                if last is not None:
                    between.update(range(last + 1, i))
                last = i
    places = {(lines[i].around, lines[i].name in _BARE) for i in core}
    near = {i for i, line in enumerate(lines) if weights[i] and (line.around, line.name in _BARE) in places and (line.name not in _BARE or i in dense)}
    return core | between | near | {i for i in dense if lines[i].name in _HEADINGS and weights[i]}


def _menus(lines: list[Line]) -> set[int]:
    """Lines of lists whose items, ``MENU`` or more in a row, are links and nothing else."""
    out: set[int] = set()
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or lines[i].name != "li" or lines[i].own or not lines[i].text or lines[i].of_list != lines[start].of_list:
            if i - start >= MENU:
                out.update(range(start, i))
            start = i if i < len(lines) and lines[i].name == "li" and lines[i].text and not lines[i].own else i + 1
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, one line per block."""
    if not page:
        return ""
    lines, opened = lines_of(page)
    runs = runs_of([len(line.text) for line in lines])
    if not runs:
        return ""
    weights = [_weight(line) for line in lines]
    for i in _menus(lines):
        weights[i] = 0
    if not any(weights) and not opened:
        weights = [len(line.text) for line in lines]  # nothing but links
    least = SURGE
    if not opened:  # beside an article without text, no other text is main text for being the longest
        least = max(1, min(SURGE, max(sum(weights[i:min(i + WINDOW, end)]) for start, end, _ in runs for i in range(start, end))))
    kept = _kept(lines, weights, runs, least) - _menus(lines)
    inside = {i for i in kept if lines[i].inside}
    # an article that has most of the text is the main text; a teaser is not
    if 2 * sum(lines[i].own for i in inside) >= sum(lines[i].own for i in kept):
        kept = inside or kept
    return "\n".join(lines[i].text for i in sorted(kept))


def text_of(page: Column) -> Column:
    """Main text and its length in code points."""
    @F.arrow_udf("text string, n_chars long")
    def extract(column: pa.Array) -> pa.Array:
        texts = [main_text(page) for page in column.to_pylist()]
        return struct(text=pa.array(texts, pa.string()), n_chars=pa.array(map(len, texts), pa.int64()))

    return extract(page)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, main text and its length.

    Window sums of ``WINDOW`` lines place the text: it begins where a sum reaches ``SURGE`` characters (or, where no
    article was opened, the largest sum there is) and ends where sums fall to nothing. Links weigh nothing; lines
    in an article count as full windows, whatever their length, and stand alone where they have most of the text. Null, empty and
    textless pages give an empty text; broken and cut-off markup ends where the page ends. Repeated
    rows are read each for itself, an empty table gives no rows, other columns are left out. No shuffle.
    """
    return pages.select("page_id", "url", text_of(F.col(html_col)).alias("_t")).select("page_id", "url", "_t.*")
