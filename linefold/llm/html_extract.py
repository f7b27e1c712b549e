"""Main-text extraction from HTML by two passes of block rules.

Pass 1 labels each block from its structure, stop-word density, length and link
density: ``good``, ``bad`` or undecided (``short``, ``near``).  Pass 2 lets undecided
blocks inherit the label of the nearest decided neighbours.  Inside article or main the
thresholds of pass 1 are lower, each side inherits from itself, and what has no decided
neighbour inside is article text.

Defined cases: null or empty html gives "" and 0; rows are independent, so repeated
rows repeat; extra columns of the input are ignored; a page without any good block
gives "".  Elements that never close end with the block around them, scripts, styles and
comments with the page; a tag without ``>`` ends at the next ``<``.  Time is linear in
the length of the page, whatever it holds.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship

# HTML element classes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noframes ol option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea noscript template iframe noframes xmp svg select button".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog head title search".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role attributes that mark boilerplate.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar side-bar menu nav navbar navigation "
    "navigation-bar breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social comment comments comment-list commentlist disqus reply replies respond discussion related "
    "recommended recommendations teaser teasers widget widgets toolbar pagination pager copyright legal disclaimer complementary contentinfo "
    "search search-form skip-link tags hidden".split()
)
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or our she so than that the their them then there "
    "they this to was we were what when which who will with would you your au aux avec ce ces cette dans de des du elle en est et il ils la le les leur "
    "mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous als am auch auf aus bei bin bis das dass dem den der des die "
    "dies diese ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wird wir "
    "zu zum zur al como con del el ella entre era esta este ha hay las lo los más me mi muy no nos o para pero por sin sobre su sus también te tiene todo y ya".split()
)

#: Those of them that an article's own sections are named after too, as in legal-analysis: inside an article, parts of names
#: with these are a vote beside the text's density, no verdict.
DOUBTFUL_WORDS = frozenset(
    "ad banner consent copyright disclaimer discussion hidden legal login menu notice notices overlay promotion recommendations related replies respond "
    "search share sharing signup social subscription tags topbar widget widgets".split()
)
#: Parts of compound class names that speak of a page's layout or deny what follows.
LAYOUT_WORDS = frozenset("no not has have with without is overflow content main page site article post entry body wrap wrapper container layout inner outer row col".split())
#: Those that say whose comments follow, and deny nothing of them.
OWNERS = frozenset("page article post entry".split())
#: Text outside of boilerplate from which a page has an article without its marked wrappers.
RESCUE_CHARS = 200

# Whole blocks that call to act instead of telling something.
CALLS = frozenset(
    "advertisement|sponsored|click here|buy now|shop now|order now|sign up|sign in|log in|subscribe|subscribe now|read more|learn more|share this|tweet|download now|add to cart|"
    "continue reading|skip to content|back to top|follow us|jetzt kaufen|weiterlesen|hier klicken|cliquez ici|lire la suite|haga clic|leer más".split("|")
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: The first quote of a tag.
_QUOTE = re.compile(r"<[^<>\"']*+([\"'])")
#: A tag whose quotes or bracket never close: it ends at the next bracket.
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>?")
_BLOCK_EDGE = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS))})(?=[\s/>])", re.I)
_END_OF = {t: re.compile(rf"</{t}(?:\s[^<>]*)?/?>", re.I) for t in RAW_TAGS}
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math object q s samp small span strike strong sub sup time tt u var video audio".split())
#: A run of inline tags that no bracket closes.
_LOOSE_RUN = re.compile(rf"(?:</?(?:{'|'.join(sorted(INLINE_TAGS))})(?=[\s/<])[^<>]*(?=<|\Z))+", re.I)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_MAIN = re.compile(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody", re.I)
_WORD = re.compile(r"[^\W\d_]+", re.U)


def _boiler_attrs(attrs: str, tag: str = "div") -> tuple[bool, bool]:
    """Whether attributes mark boilerplate, and whether they only may: by a part of a name that articles use as well."""
    may = False
    if tag in ("html", "body") or not attrs or ("=" not in attrs and "hidden" not in attrs):
        return False, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, False
            continue
        if tag == "main":
            continue
        for w in value.split():
            if w in BOILER_WORDS:
                return True, False
            said = set(re.split(r"[-_]+", w))
            denied = said & (LAYOUT_WORDS - OWNERS if said & {"comment", "comments"} else LAYOUT_WORDS)
            if tag != "article" and said & BOILER_WORDS and not denied:
                if said & BOILER_WORDS - DOUBTFUL_WORDS:
                    return True, False
                may = True
    return False, may


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of tags; comments and declarations have no name.

    A generator that may be told, by send(), to go on from a later place.
    """
    at, n, no_cdata = 0, len(page), False
    last = {q: page.rfind(q) for q in "\"'"}
    while True:
        i = page.find("<", at)
        if i < 0 or i + 1 >= n:
            return
        c = page[i + 1]
        if c == "!" or c == "?":
            if page.startswith("<!--", i):
                end = i + 5 if page.startswith("<!-->", i) else page.find("-->", i + 4) + 3
                end = n if end < i + 4 else end
            else:
                end = -1
                if page.startswith("<![CDATA[", i) and not no_cdata:
                    end = page.find("]]>", i)
                    no_cdata = end < 0
                    end = end + 3 if end >= 0 else -1
                if end < 0:
                    end = page.find(">", i) + 1 or n
            sent = yield i, end, "", False, ""
        else:
            quote = _QUOTE.match(page, i)
            # a quote that is the page's last of its kind never closes: it is not looked for up to the end
            m = None if quote and last[quote[1]] == quote.start(1) else _TAG.match(page, i)
            if m is None:
                run = _LOOSE_RUN.match(page, i)
                m = None if run else _LOOSE_TAG.match(page, i)
                if run:
                    at = run.end()
                    yield i, at, "", False, ""
                    continue
                if m and not page.endswith(">", i, m.end()) and m[2].lower() not in BLOCK_TAGS | RAW_TAGS | VOID_TAGS | INLINE_TAGS:
                    m = None  # a sign of less-than in the text
            if m is None:
                at = i + 1
                continue
            end = m.end()
            sent = yield i, end, m[2].lower(), bool(m[1]), m[3]
        at = end if sent is None else sent
        if sent is not None:
            yield  # the answer to send()


def blocks_of(page: str) -> list[dict]:
    """Blocks in page order: text, linked characters, and where they stand."""
    out: list[dict] = []
    # tag, innermost block tag, innermost boilerplate element or 0, in main, innermost doubtful element or 0; all from the top down
    stack: list[tuple[str, str, int, bool, int]] = []
    doubts = 0
    opened: Counter[str] = Counter()
    # boilerplate elements, numbered from 1: the one around, whether it may wrap a whole page, first block, end
    marks: list[list] = [[0, False, 0, 0]]
    endless: set[str] = set()  # tags without an end tag in the rest of the page
    parts: list[str] = []
    linked = 0
    link: int | None = None  # how many elements were open when the link began

    def push(tag: str, attrs: str, main: bool = False) -> None:
        nonlocal doubts
        _, block, around, inside, doubt = stack[-1] if stack else ("", "body", 0, False, 0)
        own = tag in BOILER_TAGS or (tag == "header" and not inside)
        marked, may = _boiler_attrs(attrs, tag)
        if may and inside and not own and not marked:
            doubts += 1
            doubt = doubt or doubts
        elif own or marked or may:
            # marked by attributes, or a form: may wrap a whole page
            marks.append([around, tag == "form" or not own, len(out), -1])
            around = len(marks) - 1
        stack.append((tag, tag if tag in BLOCK_TAGS else block, around, inside or main, doubt))
        opened[tag] += 1

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                _, block, around, inside, doubt = stack[-1] if stack else ("", "body", 0, False, 0)
                out.append({"text": text, "linked": linked, "mark": around, "main": inside, "tag": block, "doubt": doubt})
            parts.clear()
        linked = 0

    def close(tag: str) -> None:
        """Close the innermost element of that name and all inside it."""
        nonlocal link
        while opened[tag]:
            name, _, around, *_ = stack.pop()
            opened[name] -= 1
            if around != (stack[-1][2] if stack else 0):
                marks[around][3] = len(out)
            if name == tag:
                break
        if link is not None and len(stack) < link:
            link = None

    def say(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if link is not None:
            linked += len(" ".join(_html.unescape(piece).split()))

    at = 0
    tags = _tags(page)
    for start, end, tag, closing, attrs in tags:
        if start > at:
            say(page[at:start])
        at = end
        if not tag:
            continue
        if not closing and tag in RAW_TAGS and not attrs.rstrip().endswith("/"):
            # the content of these is never article text; jump behind the end tag
            found = None if tag in endless else _END_OF[tag].search(page, at)
            if found is None:
                endless.add(tag)
            if tag in BLOCK_TAGS:
                flush()
            else:
                parts.append(" ")
            if found:
                at = found.end()
            elif tag in ("script", "style"):
                at = len(page)
            else:
                edge = _BLOCK_EDGE.search(page, at)
                at = edge.start() if edge else len(page)
            tags.send(at)
            continue
        if tag in RAW_TAGS:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            link = len(stack) if not closing and "href" in attrs.lower() else None
            continue
        if tag not in BLOCK_TAGS:
            if not closing and tag not in VOID_TAGS and any(_boiler_attrs(attrs)):
                flush()
                push(tag, attrs)
            elif closing and opened[tag]:
                flush()
                close(tag)
            continue
        flush()
        if tag in VOID_TAGS:
            continue
        if closing:
            close(tag)
            continue
        if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option") or tag in HEADING_TAGS:
            # an open paragraph-like element ends where the next begins
            if stack and stack[-1][0] in ("p", tag):
                close(stack[-1][0])
        elif stack and stack[-1][0] == "p":
            close("p")
        push(tag, attrs, tag in ("article", "main") or bool(attrs and _MAIN.search(attrs)))
    if at < len(page):
        say(page[at:])
    flush()
    _unwrap(out, marks)
    return out


def _unwrap(blocks: list[dict], marks: list[list]) -> None:
    """Decide ``boiler`` of each block; a wrapper of the page's article or of most of its text is no boilerplate.

    Wrappers fall from the outermost on, only while no article text stands outside of
    boilerplate, so comments behind an article stay out.
    """
    size = [0, *accumulate(len(b["text"]) for b in blocks)]
    mains = [0, *accumulate(b["main"] for b in blocks)]
    # an element is no hindrance if it and all around it may fall; elements around come first
    free = [True]
    for around, wrapper, first, end in marks[1:]:
        end = len(blocks) if end < 0 else end
        falls = wrapper and (mains[end] > mains[first] or 2 * (size[end] - size[first]) > size[-1])
        free.append(falls and free[around])
    # blocks come free with their innermost element; nothing falls any more once enough is free
    gain, article = [0] * len(marks), [False] * len(marks)
    for b in blocks:
        if free[b["mark"]]:
            gain[b["mark"]] += len(b["text"]) - b["linked"]
            article[b["mark"]] |= b["main"]
    upto, got = 0, gain[0]
    found = article[0]
    while upto + 1 < len(marks) and not found and got < RESCUE_CHARS:
        upto += 1
        got, found = got + gain[upto], article[upto]
    for b in blocks:
        mark = b.pop("mark")
        b["boiler"] = mark > upto or not free[mark]


def classify(blocks: list[dict], *, short: int = 70, long: int = 200, link_max: float = 0.5, stop_low: float = 0.10, stop_high: float = 0.25) -> list[bool]:
    """Whether each block is article text.

    What stands in article or main and what stands outside go through the two passes apart,
    so that undecided blocks inherit from their own side only.
    """
    rules = {"short": short, "long": long, "link_max": link_max, "stop_low": stop_low, "stop_high": stop_high}
    has_main = any(b["main"] and not b["boiler"] for b in blocks)
    keep = [False] * len(blocks)
    for inside in (True, False) if has_main else (False,):
        own = [i for i, b in enumerate(blocks) if not has_main or b["main"] == inside]
        for i, ok in zip(own, _passes([blocks[i] for i in own], inside, not any(keep), **rules), strict=True):
            keep[i] = ok
    return keep


def _passes(blocks: list[dict], inside: bool, lone: bool, *, short: int, long: int, link_max: float, stop_low: float, stop_high: float) -> list[bool]:
    """Both passes over blocks of one side; lone: nothing else of the page is article text."""
    labels: list[str] = []
    said = []
    for b in blocks:
        words = _WORD.findall(b["text"].lower())
        said.append((len(b["text"]), b["linked"] / len(b["text"]), sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0, " ".join(words)))
    # a doubtful element is the article's own if a paragraph of prose stands in it
    prose = {b.get("doubt", 0) for b, (n, density, stops, _) in zip(blocks, said, strict=True) if n >= short and stops >= stop_low and density <= 0.2}
    for b, (n, density, stops, words) in zip(blocks, said, strict=True):
        if b["boiler"] or words in CALLS or b.get("doubt", 0) not in prose | {0}:
            # inside, such blocks say nothing of their neighbours
            labels.append("out" if inside else "bad")
        elif inside and density <= link_max:
            # the page names its article: half the stop words, or the length of a paragraph with few links, will do
            labels.append("good" if stops >= stop_low / 2 or (n >= short and density <= 0.2) else "short")
        elif inside and (n < short or (b["tag"] == "p" and stops >= stop_low)):
            # short linked lines inside, and linked paragraphs of prose, stay undecided
            labels.append("short")
        elif density > link_max:
            labels.append("bad")
        elif n < short:
            labels.append("short")
        elif stops >= stop_high:
            labels.append("good" if n >= long else "near")
        elif stops >= stop_low:
            labels.append("near")
        else:
            labels.append("bad" if density > 0.2 else "short")
    if lone and not any(x == "good" for x in labels):
        labels = ["good" if x == "near" else x for x in labels]
        if "good" not in labels:
            # a page of short lines only: those in paragraphs of their own are its text
            labels = ["good" if x == "short" and not b["linked"] and (b["tag"] == "p" or b["tag"] in HEADING_TAGS) else x for x, b in zip(labels, blocks, strict=True)]
    edge = "good" if inside else "bad"
    before: list[tuple[int, str]] = []
    last = (-(10**9), edge)
    for i, x in enumerate(labels):
        if x in ("good", "bad"):
            last = (i, x)
        before.append(last)
    after: list[tuple[int, str]] = [(10**9, edge)] * len(labels)
    nxt = (10**9, edge)
    for i in range(len(labels) - 1, -1, -1):
        if labels[i] in ("good", "bad"):
            nxt = (i, labels[i])
        after[i] = nxt
    keep = []
    for i, (x, b) in enumerate(zip(labels, blocks, strict=True)):
        if x in ("good", "bad", "out"):
            keep.append(x == "good")
            continue
        (p, left), (q, right) = before[i], after[i]
        if left == right:
            keep.append(left == "good")
        elif inside and not b["linked"]:
            keep.append(True)  # where neighbours disagree, the page's own word for its article decides
        elif b["tag"] in HEADING_TAGS or x == "near":
            keep.append(right == "good" if b["tag"] in HEADING_TAGS else "good" in (left, right))
        else:
            keep.append((left if i - p < q - i else right if q - i < i - p else edge) == "good")
    return keep


def extract_text(page: str | None, **rules: float) -> str:
    """The article text of one page."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return " ".join(b["text"] for b, ok in zip(blocks, classify(blocks, **rules), strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""
    ship(pages.sparkSession)
    src = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = src.schema["page_id"].dataType.simpleString()
    return src.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
