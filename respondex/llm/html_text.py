"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element; parts that say by tag, role or class
that they are no article are left out. The text lengths of the lines are summed over sliding
windows of lines; where the sums rise above a bar the text surges, where they fall below it
the text dives, and the lines between are kept, also those full of links. Where the page
marks its article, lines inside it weigh more; those outside keep their own weight.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
BAR = 80

#: Elements that never hold text of an article.
DROPPED = frozenset(
    "aside button canvas datalist dialog embed fieldset footer form head header iframe input "
    "label map menu nav noscript object option select svg template".split()
)
#: Elements whose content is no markup.
RAW = "script|style|textarea|title|xmp|noembed|noframes"
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br cite code data del dfn em font i img ins kbd mark "
    "picture q rp rt ruby s samp small source span strike strong sub sup time track tt u var "
    "video wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the next block ends if they aren't closed.
LOOSE = frozenset("dd dt li p td th tr".split())
#: Words of class, id and role that name something other than the article.
NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts advertorial alert banner "
    "breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo "
    "cookie cookies copyright disclaimer discussion disqus footer gdpr header hidden legal "
    "login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "outbrain overlay pager pagination paywall popup promo promoted promotion recommended "
    "related reply replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription taboola teaser toolbar tooltip warning widget".split()
)
#: Of these, what holds no article even if it is most of the page.
CERTAIN = frozenset(
    "ad ads adsense advert advertisement advertising adverts breadcrumb breadcrumbs comment "
    "commentlist comments consent cookie cookies copyright disclaimer discussion disqus footer "
    "gdpr menu menubar nav navbar navigation notice notices outbrain pager pagination promo "
    "related replies reply respond sponsored taboola".split()
)
#: Words of a name that say nothing of what is inside.
PLACES = frozenset(
    "area bar block bottom box buttons col column container content group icons inner items "
    "left link links list main outer panel post posts primary right secondary section site "
    "slot thread top user users wrap wrapper".split()
)
#: Words that turn a name into a remark about the page.
ABOUT = frozenset("has no not with without".split())
_MAIN = frozenset(["article", "main"])

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_QUOTED_REST = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>")
_RAW_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW.split("|")}
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")


def _names_of(rest: str) -> set[str]:
    """The listed words by which a class, an id or a role names an element.

    A name counts if all its words are listed but for those that say where and what kind of
    box it is. ``with-sidebar`` says what else there is, and ``post-header`` has the title.
    """
    out: set[str] = set()
    for _, value in _NAMED.findall(rest):
        for name in value.strip("\"'").lower().split():
            words = set(_WORD.findall(name))
            telling = words - PLACES
            if not telling or words & ABOUT or not NAMES.issuperset(telling):
                continue
            if telling == {"header"} and "post" in words:
                continue
            out |= telling
    return out


def _dropped(tag: str, rest: str, in_main: bool) -> bool:
    if tag in ("html", "body"):
        return False
    if tag in DROPPED:
        return not (tag == "header" and in_main)
    if not rest.strip(" /"):
        return False
    return bool(_names_of(rest)) or bool(_UNSEEN.search(rest))


def _tokens(page: str) -> list[tuple[str, str, str]]:
    """kind (text, open, close), value, attributes; comments and raw elements are blanks.

    One pass: a search that finds nothing up to the end of the page is never made again.
    """
    out: list[tuple[str, str, str]] = []
    text_from = at = 0
    last = page.rfind(">")
    # Up to here quotes can't be trusted, as one of them is never closed.
    unquoted = -1

    def end_text(upto: int) -> None:
        if upto > text_from:
            out.append(("text", page[text_from:upto], ""))

    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= len(page):
            break
        if page.startswith("<!--", at):
            end_text(at)
            end = page.find("-->", at + 4)
            text_from = at = len(page) if end < 0 else end + 3
            continue
        if at > last:
            # Comments may still come, tags can't.
            at += 1
            continue
        closing = page[at + 1] == "/"
        name = _NAME.match(page, at + 1 + closing)
        if not name:
            if page[at + 1] not in "!?/":
                at += 1
                continue
            end_text(at)
            text_from = at = page.find(">", at) + 1
            continue
        found = None
        if at > unquoted:
            found = _QUOTED_REST.match(page, name.end())
            if not found:
                unquoted = max(page.rfind('"'), page.rfind("'"))
        end = found.end() if found else page.find(">", name.end()) + 1
        end_text(at)
        tag, rest = name[0].lower(), page[name.end() : end - 1]
        if tag in _RAW_ENDS and not closing:
            closed = _RAW_ENDS[tag].search(page, end)
            end = closed.end() if closed else len(page)
            out.append(("text", " ", ""))
        else:
            out.append(("close" if closing else "open", tag, rest))
        text_from = at = end
    end_text(len(page))
    return out


def _unlinked(tokens: list[tuple[str, str, str]], ends: dict[int, int]) -> list[int]:
    """Characters of text before each token, outside links and elements dropped by their tag."""
    out = [0]
    in_link, skip_until = False, -1
    for k, (kind, value, rest) in enumerate(tokens):
        own = 0
        if k >= skip_until:
            if kind == "text":
                own = 0 if in_link else len(value.strip())
            elif value == "a":
                in_link = kind == "open"
            elif value not in INLINE and value != "br":
                in_link = False
            if kind == "open" and value in DROPPED and value != "header":
                skip_until = ends.get(k, -1)
        out.append(out[-1] + own)
    return out


def _rest(
    tokens: list[tuple[str, str, str]], ends: dict[int, int], mains: list[int], before: list[int]
) -> int:
    """Unlinked characters outside all elements that a name could cut."""
    out, until, main = before[-1], 0, 0
    for k, (kind, _, rest) in enumerate(tokens):
        while main < len(mains) and mains[main] <= k:
            main += 1
        if k < until or kind != "open" or k not in ends or not rest.strip(" /"):
            continue
        holds_main = main < len(mains) and mains[main] < ends[k]
        if not holds_main and _names_of(rest):
            out -= before[ends[k]] - before[k]
            until = ends[k]
    return out


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Text, number of characters in links, whether in the marked article; one per block."""
    tokens = _tokens(page)

    # Ends of elements; a loose one without end ends before the next block, others nowhere.
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    loose: list[int] = []
    mains: list[int] = []
    for k, (kind, value, rest) in enumerate(tokens):
        if kind == "text":
            continue
        if value not in INLINE or value == "br":
            if value != "br":
                while loose:
                    ends[loose.pop()] = k
        if kind == "open":
            if value in LOOSE:
                loose.append(k)
            if value not in VOID and not rest.rstrip().endswith("/"):
                waiting.setdefault(value, []).append(k)
            if value in _MAIN and not _names_of(rest):
                mains.append(k)
        elif waiting.get(value):
            ends[waiting[value].pop()] = k
    for k in loose:
        ends.setdefault(k, len(tokens))
    marked = [(k, ends.get(k, len(tokens))) for k in mains]
    before = _unlinked(tokens, ends)
    text_left = _rest(tokens, ends, mains, before) > 0

    def cut(k: int, in_main: bool) -> bool:
        """Whether an element is left out.

        What is named as comments, adverts, notices or navigation goes however long it is, if
        any text is left then. Other names are also given to wrappers of whole pages, so they
        don't count where most of the text is; in a page of few words a mark elsewhere decides.
        """
        _, tag, rest = tokens[k]
        if not _dropped(tag, rest, in_main):
            return False
        if tag in DROPPED or (text_left and CERTAIN & _names_of(rest)):
            return True
        held = before[ends[k]] - before[k]
        short = not in_main and marked and held < WINDOW * BAR
        return 2 * held <= before[-1] or bool(short)

    blocks: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    in_link = linked = 0
    main_until = -1
    skip_until = -1

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append((text, min(linked, len(text)), main_until >= 0))
        parts.clear()
        linked = 0

    starts = dict(marked)
    firsts = sorted(starts)
    for k, (kind, value, rest) in enumerate(tokens):
        if k < skip_until:
            continue
        if main_until >= 0 and k >= main_until:
            flush()
            main_until = -1
        if kind == "text":
            parts.append(value)
            if in_link:
                linked += len(value.strip())
            continue
        if value == "a":
            in_link = int(kind == "open")
        if value == "br":
            parts.append(" ")
        if value in INLINE:
            if kind != "open" or not _dropped(value, rest, main_until >= 0):
                continue
        else:
            flush()
            in_link = 0
        if kind != "open":
            continue
        if k in starts and main_until < 0:
            main_until = starts[k]
            continue
        if k not in starts and k in ends and cut(k, main_until >= 0):
            if not any(k < f < ends[k] for f in firsts):
                skip_until = ends[k]
    flush()
    return blocks


def _level(lines: list[tuple[str, int, bool]], window: int, bar: int) -> tuple[float, float]:
    """The level that the sums of windows have to pass, and the added weight of a marked window.

    With half of the page's text marked the added weight passes the level whatever the
    window holds; with a smaller share it is less.
    """
    own = [len(text) - linked for text, linked, _ in lines]
    sums = [sum(own[max(i, 0) : i + window]) for i in range(1 - window, len(own))]
    level = min(bar, max(sums, default=0) / 4)
    marked = sum(x for x, (_, _, inside) in zip(own, lines) if inside)
    share = marked / sum(own) if sum(own) else 1
    return level, min(1, 2 * share) * (level + 1)


def main_text(page: str, window: int = WINDOW, bar: int = BAR) -> str:
    lines = lines_of(page)
    level, added = _level(lines, window, bar)
    # Windows end where a marked part begins or ends.
    borders = [i for i in range(1, len(lines)) if lines[i][2] != lines[i - 1][2]]
    kept: list[int] = []
    for low, high in zip([0, *borders], [*borders, len(lines)] if lines else []):
        extra = added / min(window, high - low) if lines[low][2] else 0
        weights = [len(text) - linked + extra for text, linked, _ in lines[low:high]]
        runs: list[list[int]] = []
        for i in range(low + 1 - window, high):
            first, end = max(i, low), min(i + window, high)
            if sum(weights[first - low : end - low]) > level:  # the text has surged, and not dived before end
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = end
                else:
                    runs.append([first, end])
        # Short lines between two stretches of text are text, unless there are links among them.
        joined: list[list[int]] = []
        for run in runs:
            gap = range(joined[-1][1], run[0]) if joined else []
            if joined and not any(2 * lines[i][1] >= len(lines[i][0]) for i in gap):
                joined[-1][1] = run[1]
            else:
                joined.append(run)
        for first, end in joined:
            # Windows reach beyond the text; lists of links there are none of it.
            while first < end and _links(lines[first], weights[first - low], level / window):
                first += 1
            while first < end and _links(lines[end - 1], weights[end - 1 - low], level / window):
                end -= 1
            kept += range(first, end)
    return "\n".join(lines[i][0] for i in kept)


def _links(line: tuple[str, int, bool], weight: float, least: float) -> bool:
    return 2 * line[1] >= len(line[0]) and weight < least


def extract(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    markup: str = "html",
    window: int = WINDOW,
    bar: int = BAR,
) -> DataFrame:
    """page_id, url, text; one row per input row.

    A null or empty page, and one without an article, has the empty text. Broken markup is
    read as far as it goes: an element without end is no reason to leave anything out.
    Rows that repeat an id are read each; other columns are not looked at; an empty table
    gives an empty result. A page is one string in one task, however long.
    """
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.col(f"`{markup}`").alias("html"),
    )
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", window, bar) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    return rows.mapInArrow(task, schema)
