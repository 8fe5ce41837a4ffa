"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.llm.arrow_text import slices, texts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*'|["'])*)(/?)>|<[!?][^>]*(?:>|\Z)""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that never hold main text, and words in class, id or role that say the same.
_ASIDE = set("nav footer aside form button select option dialog menu head".split())
_ASIDE_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent contentinfo disclaimer "
                   "complementary footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted "
                   "promotion related recommended replies reply respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget "
                   "copyright login signup alert".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCES = {"ul", "ol", "table", "div", "article", "section", "main", "body", "dl", "blockquote", "aside", "nav", "header", "footer", "form"}
_PUNCTUATION = re.compile(r"[.,;:!?。，、]")


def _marks(attributes: str) -> tuple[set[str], set[str]]:
    """Words in class, id and role, and the whole names there."""
    words: set[str] = set()
    names: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            words.add("\0hidden")
        elif name != "style":
            words.update(re.split(r"[^a-z]+", value))
            names.update(value.split())
    return words, names


def blocks(page: str) -> list[tuple[tuple, int, str]]:
    """(tag path, serial number of the element around, text) of every block of text, in page order.

    A path is made of tag names with their classes; the last element is the innermost block element. Inline
    elements belong to their block. `p`, list and table items close by themselves, as in HTML.
    """
    out: list[tuple[tuple, int, str]] = []
    stack: list[tuple[str, str, int, int]] = []       # tag, path step, aside (2: surely, 1: by a part of a name), serial
    text: list[str] = []
    serial = 0

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                held = [x for x in stack if x[0] not in _INLINE]
                out.append((tuple(x[1:4] for x in held), held[-1][3] if held else 0, " ".join(words)))

    def close(upto: int) -> None:
        if any(x[0] not in _INLINE for x in stack[upto:]):
            flush()
        del stack[upto:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[3].lower() if m[3] else ""
        if not tag:
            if m[0][:9].upper() == "<![CDATA[":
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE:
                    break
            else:
                if tag not in _INLINE:
                    flush()
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag not in _INLINE:
            flush()
            shut = _CLOSES.get(tag, {"p"} if tag in _FENCES | _HEADINGS else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    close(i)
                    break
                if stack[i][0] in _FENCES:
                    break
        marks, names = _marks(m[4]) if m[4].strip() else (set(), set())
        inside = any(x[1].split(".")[0] in ("article", "main") for x in stack)
        whole = tag in ("body", "html", "article", "main")

        def says(found: set[str], whole: bool = whole) -> bool:
            return bool(found & _ASIDE_WORDS) and not whole or bool(found & {"comment", "comments"})

        aside = 2 if tag in _ASIDE or tag == "header" and not inside or "\0hidden" in marks or says(names) else 1 if says(marks) else 0
        serial += 1
        stack.append((tag, ".".join([tag, *sorted(marks - {"", "\0hidden"})]), aside, serial))
    if at < len(page):
        rest = page[at:]
        text.append(rest[: cut.start()] if (cut := re.search(r"<[/!a-zA-Z][^>]*\Z", rest)) else rest)
    flush()
    return out


def main_text(page: str, threshold: float = 0.5) -> str:
    """The blocks of a page's main text, joined by line ends.

    Per root-to-leaf tag path: text length and punctuation over its blocks (the ratios). Blocks take the ratios of
    their path, smoothed over their neighbours by a Gaussian; the fused score is the geometric mean of both. Paths
    whose score reaches `threshold` times the length-weighted mean are content. The element that holds all of them, or the
    article around it, is the main part: what stands in it and in no aside element (menus, adverts, forms, comments and the like) is kept, so
    that headings and short paragraphs between content stay. A class that only has such a word in its name (`has-sidebar`,
    `comments-open`) makes no aside of an element that holds four fifths of the text that is surely in none.
    """
    some = [b for b in blocks(page) if not any(aside == 2 for _, aside, _ in b[0])]
    held: dict[int, int] = {}
    for b in some:
        for _, aside, serial in b[0]:
            if aside:
                held[serial] = held.get(serial, 0) + len(b[2])
    most = 0.8 * sum(len(b[2]) for b in some)
    free = [b for b in some if not any(aside and held[serial] < most for _, aside, serial in b[0])]
    if not free:
        return ""
    paths = [tuple(step for step, _, _ in b[0]) for b in free]
    lengths = np.array([len(b[2]) for b in free], float)
    marks = np.array([len(_PUNCTUATION.findall(b[2])) for b in free], float)
    index = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    which = np.array([index[p] for p in paths])
    paths_of = list(index)
    nodes = np.bincount(which)
    ratios = [np.bincount(which, v) / nodes for v in (lengths, marks + 0.1)]
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones(len(free)), kernel)[2 : len(free) + 2]
    smooth = [np.convolve(r[which], kernel)[2 : len(free) + 2] / weight for r in ratios]
    fused = np.sqrt(smooth[0] * smooth[1])
    score = np.bincount(which, fused) / nodes
    bound = threshold * np.average(score[which], weights=lengths)
    content = score >= bound
    own = np.sqrt(ratios[0] * ratios[1]) >= bound             # not by their neighbours alone, but for the title
    chosen = [b for b, w in zip(free, which) if content[w] and (own[w] or paths_of[w] and paths_of[w][-1].split(".")[0] == "h1")] or [b for b, w in zip(free, which) if content[w]]
    # The deepest element that holds all content; an article is not entered, since its heading may stand beside the content.
    box, depth = 0, 0
    while True:
        inside = {b[0][depth][2] if len(b[0]) > depth else 0 for b in chosen}
        best = inside.pop()
        if inside or not best or all(b[0][-1][2] == best for b in chosen):       # parted, or a single block
            break
        box, depth = best, depth + 1
        if chosen[0][0][depth - 1][0].split(".")[0] == "article":
            break
    kept = [b[2] for b in free if depth == 0 or len(b[0]) >= depth and b[0][depth - 1][2] == box]
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null, empty or text-less page has the empty text. Repeated rows are kept, an empty table gives no rows,
    further columns are not carried. Very long pages are read whole, one at a time. Paths of equal scores are kept or left
    together.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [main_text(t.decode("utf-8", "replace")) for t in texts(part.column("html"))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
