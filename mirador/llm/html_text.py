"""Main text of HTML pages by two-pass block rules.

Pass one classifies each block by its length, the density of stop words and the density of linked text; where none of the
lists of stop words fits a page, by length and links alone, a character of a script without spaces counting as three. Blocks inside
menus, asides, adverts, comments and the like are bad from the start, but where only a part of a name tells so, long
and dense blocks are judged by their measures. Forms, dialogs and labels are bad unless they hold most of a page's long
blocks, or its article. Pass two gives ambiguous blocks the label of the nearest neighbour in the same container that was decided by
its measures: what is bad for its tag or name says nothing of its neighbours, wherever it stands. One linked block among
others in an article is ambiguous, several in a row are bad. Where a page marks its article, this is a prior: blocks in it are taken
for one step better than their measures, and for blocks outside it the edges count as bad; no block is dropped for its place.
A page without any decided block keeps its ambiguous ones.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from mirador.llm.common import small_batches

#: Frequent function words of English, Spanish, French and German.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son mais comme on tout nous sa cette ses ont aux elle leur même être fait été aussi bien peut ces y sans entre deux si après",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man",
}
_STOPS = [frozenset(x.split()) for x in STOP_WORDS.values()]

#: Elements by what they do.
_RAW = "script|style|textarea|title|noscript|iframe|noembed|noframes|xmp|template|svg|annotation|annotation-xml|object|select|canvas|audio|video|map|datalist"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_BAD_TAGS = frozenset("nav aside footer button menu head".split())
#: Elements that are bad unless they hold what a page is about.
_WRAPPING = frozenset("form fieldset dialog label".split())
_WRAPPING_ROLES = frozenset("form dialog".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog menu menubar toolbar tablist".split())
_BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menubar nav navbar navigation sidebar side footer header masthead topbar breadcrumb breadcrumbs"
    " comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " widget pagination pager skip toolbar copyright legal disclaimer".split()
)
_IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Name parts that say nothing of an element's purpose, or go with those above.
_PLAIN_NAMES = frozenset(
    "box block list wrapper wrap container section area bar link links button buttons icon icons inner outer top bottom left right center post page site primary secondary content item items row col column group body text thread form banner main"
    " stories posts articles news reading videos topics tags header title label feed card cards panel slot unit zone module tools text widget fixed sticky mobile desktop small large global user author count no".split()
)
#: How strongly an element's own tag, role or name tells that it is no main text.
_FINE, _WEAK, _BAD, _WRAPS = 0, 1, 2, 3
_RAW_TAGS = frozenset(_RAW.split("|"))
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+(?:>|\Z)", re.I) for t in _RAW_TAGS}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
_QUOTED_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"\w+")
#: Thai, Lao, Burmese, Khmer, kana, bopomofo and Chinese characters.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3100-\u312f\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f]")
_SPLIT_NAME = re.compile(r"[^a-z]+")
#: Names with these parts say what else there is on a page, not what the element is.
_ABOUT_OTHERS = frozenset("has have with without no".split())


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass: link density above which a block is bad; lengths in characters; stop-word densities, and that
    of a whole page from which on a list of stop words fits it."""

    most_links: float = 0.5
    short: int = 40
    long: int = 160
    stop_low: float = 0.12
    stop_high: float = 0.24
    fit: float = 0.12


@dataclass(slots=True)
class _Block:
    text: str
    linked: int
    bad: bool
    zone: int
    heading: bool
    held: bool = False  # bad only for the name of the article or of what holds it
    weak: bool = False  # in an element of which a part of the name alone says that it is no main text
    wrapper: int = 0  # the innermost form, dialog or label that holds it
    label: str = ""


@dataclass
class _Wrappers:
    """Forms, dialogs and labels by number: the next outer one, and whether an article begins in it. 0 is the page."""

    parent: list[int]
    article: list[bool]


def _tokens(page: str):
    """(start, end, closing, tag, attributes) of the markup in page, in order and in linear time; tag is None for comments,
    declarations and elements whose content is no text, which are one token each. Where quotes in a tag do not pair
    up before the page ends, quotes count for nothing from there on; a tag that does not end ends the page."""
    at, last, quotes = 0, page.rfind(">"), True
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        after = page[at + 1 : at + 4]
        if after == "!--":
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, None, ""
            at = end
            continue
        if after[:1] in ("!", "?"):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            yield at, end, False, None, ""
            at = end
            continue
        name = after[1:2] if after[:1] == "/" else after[:1]
        if not (name.isascii() and name.isalpha()):
            at += 1
            continue
        if at > last:
            yield at, len(page), False, None, ""
            return
        m = _TAG.match(page, at) or quotes and _QUOTED_TAG.match(page, at)
        if not m:
            quotes, m = False, _BARE_TAG.match(page, at)
        tag, end = m[2].lower(), m.end()
        if tag in _RAW_TAGS and not m[1]:
            close = _RAW_END[tag].search(page, end)
            end = close.end() if close else len(page)
            yield at, end, False, None, ""
        else:
            yield at, end, bool(m[1]), tag, m[3]
        at = end


def _bad_name(value: str) -> int:
    worst = _FINE
    for name in value.split():
        parts = set(_SPLIT_NAME.split(name)) - {""}
        if not _BAD_NAMES.isdisjoint(parts) and _ABOUT_OTHERS.isdisjoint(parts):
            worst = max(worst, _WEAK if parts - _BAD_NAMES - _PLAIN_NAMES else _BAD)
    return worst


def _badness(tag: str, attrs: str, inside: bool, names: bool = True) -> int:
    if tag in _BAD_TAGS or tag == "header" and not inside:
        return _BAD
    worst, wraps = _FINE, tag in _WRAPPING
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if names and name in ("class", "id") and tag not in ("body", "html"):
            worst = max(worst, _bad_name(value))
        if name == "role" and value in _BAD_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return _BAD
        wraps = wraps or name == "role" and value in _WRAPPING_ROLES
    return _WRAPS if wraps and worst != _BAD else worst


def _blocks(page: str) -> tuple[list[_Block], _Wrappers]:
    out: list[_Block] = []
    stack: list[tuple[str, int, bool, bool, int]] = []  # tag, badness, a main container, bad by name alone and not inside a main container, the wrapper around it
    wrappers = _Wrappers([0], [False])
    parts: list[str] = []
    state = {"links": 0, "bad": 0, "weak": 0, "named": 0, "main": 0, "zone": 0, "linked": 0, "heading": False, "wrapper": 0}
    opened: dict[str, int] = {}

    def close() -> None:
        text = " ".join(html_lib.unescape("".join(parts)).split()) if parts else ""
        if text:
            held = state["main"] > 0 and state["bad"] == state["named"] > 0
            out.append(_Block(text, state["linked"], state["bad"] > 0, state["zone"] if state["main"] else 0, state["heading"], held, state["weak"] > 0, state["wrapper"]))
        parts.clear()
        state["linked"] = 0

    def push(tag: str, bad: int, main: bool = False, named: bool = False) -> None:
        stack.append((tag, bad, main, named, state["wrapper"]))
        if bad == _WRAPS:
            wrappers.parent.append(state["wrapper"])
            wrappers.article.append(False)
            state["wrapper"] = len(wrappers.parent) - 1
        opened[tag] = opened.get(tag, 0) + 1
        state["bad"] += bad == _BAD
        state["weak"] += bad == _WEAK
        state["named"] += named
        state["main"] += main
        state["links"] += tag == "a"

    def pop() -> None:
        tag, bad, main, named, state["wrapper"] = stack.pop()
        opened[tag] -= 1
        state["bad"] -= bad == _BAD
        state["weak"] -= bad == _WEAK
        state["named"] -= named
        state["main"] -= main
        state["links"] -= tag == "a"

    def pop_to(tag: str) -> None:
        while stack[-1][0] != tag:
            pop()
        pop()

    at = 0
    for start, end, closing, tag, attrs in _tokens(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if state["links"]:
                state["linked"] += len(piece.strip())
        at = end
        if tag is None:
            continue
        if tag not in _BLOCKS:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                if closing:
                    while stack and stack[-1][0] == "a":
                        pop()
                elif not attrs.endswith("/"):
                    push("a", _FINE)
            elif tag not in _VOID and not closing and (bad := _badness(tag, attrs, True)):
                close()
                push(tag, bad)
            elif closing and opened.get(tag):
                close()
                pop_to(tag)
            continue
        close()
        while stack and stack[-1][0] == "a":
            pop()
        if closing:
            if opened.get(tag):
                pop_to(tag)
            state["heading"] = False
            continue
        while stack and stack[-1][0] in _IMPLIED.get(tag, ()):
            pop()
        if tag in _VOID:
            continue
        bad = _badness(tag, attrs, state["main"] > 0)
        main = tag in ("article", "main") or 'role="main"' in attrs or "articlebody" in attrs.lower()
        named = bad == _BAD and not state["main"] and _badness(tag, attrs, False, False) != _BAD
        main = main and (bad != _BAD or named)
        if main and not state["main"]:
            while any(opened.get(t) for t in ("nav", "header", "footer", "aside", "head")):  # left open before the article
                pop()
            state["zone"] += 1
            wrappers.article[state["wrapper"]] = True
        push(tag, bad, main, named)
        state["heading"] = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    if at < len(page):
        parts.append(page[at:])
    close()
    return out, wrappers


def _size(text: str) -> int:
    """Length in characters, those of scripts without spaces between words three times."""
    return len(text) + 2 * len(_UNSPACED.findall(text)) if not text.isascii() else len(text)


def _stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return max((sum(w in s for w in words) / len(words) for s in _STOPS), default=0.0) if words else 0.0


def _linked(b: _Block, rules: Rules) -> bool:
    return b.linked > rules.most_links * len(b.text)


def _first_pass(b: _Block, rules: Rules, fits: bool, marked: bool) -> str:
    if b.bad or _linked(b, rules):
        return "bad"
    size = _size(b.text)
    if size < rules.short:
        return "bad" if b.weak else "ambiguous"
    if not fits:
        if b.weak:
            return "ambiguous" if size > rules.long else "bad"
        return "good" if size > rules.long and (b.zone or not marked) else "ambiguous"
    density = _stop_density(b.text)
    if b.weak and (size <= rules.long or density < rules.stop_high):
        return "bad"
    if density >= rules.stop_high:
        return "good" if size > rules.long or b.zone else "near"
    if density >= rules.stop_low:
        return "good" if b.zone else "near"
    if size > rules.long:
        return "ambiguous" if b.zone else "bad"
    return "ambiguous"


def _unwrap(blocks: list[_Block], wrappers: _Wrappers, rules: Rules) -> None:
    """Blocks of forms, dialogs and labels are bad, but for wrappers that hold an article, or most of the page's long blocks."""
    sizes, total = [0] * len(wrappers.parent), 0
    for b in blocks:
        size = _size(b.text)
        if not b.bad and size > rules.long and not _linked(b, rules):
            total += size
            sizes[b.wrapper] += size
    bad = [False] * len(sizes)
    for w in range(len(sizes) - 1, 0, -1):  # inner ones first
        bad[w] = not wrappers.article[w] and 2 * sizes[w] <= total
        sizes[wrappers.parent[w]] += sizes[w]
        wrappers.article[wrappers.parent[w]] |= wrappers.article[w]
    for w in range(1, len(sizes)):
        bad[w] = bad[w] or bad[wrappers.parent[w]]
    for b in blocks:
        b.bad = b.bad or bad[b.wrapper]


def _lift(blocks: list[_Block], rules: Rules) -> None:
    """An article is not bad for its name, or that of a wrapper, if the page has no other and less good text elsewhere."""
    held = [b for b in blocks if b.held]
    if not held or any(b.zone and not b.bad for b in blocks):
        return
    if sum(len(b.text) for b in held) > sum(len(b.text) for b in blocks if not b.bad and _first_pass(b, rules, True, False) in ("good", "near")):
        for b in held:
            b.bad = False


def _second_pass(blocks: list[_Block]) -> None:
    """Ambiguous blocks take the label of the nearest block of their zone that was decided by its measures; blocks that are bad
    for a tag or name are passed over. Zone blocks are bad only between bad ones. On a tie others are good only if both sides are;
    with no decided block they are good if the page marks no article. Near-good blocks become good unless both sides are bad. For
    blocks outside the article of a page that has one, a side without a decided block is bad."""
    marked = any(b.zone and not b.bad for b in blocks)
    first = [b.label for b in blocks]
    votes = [x in ("good", "bad") and not b.bad for x, b in zip(first, blocks, strict=True)]
    before: list[int] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        before.append(last.get(b.zone, -1))
        if votes[i]:
            last[b.zone] = i
    last = {}
    for i in range(len(blocks) - 1, -1, -1):
        b, after = blocks[i], last.get(blocks[i].zone, len(blocks))
        if votes[i]:
            last[b.zone] = i
        if first[i] in ("good", "bad"):
            continue
        left = (first[before[i]], i - before[i]) if before[i] >= 0 else None
        right = (first[after], after - i) if after < len(blocks) else None
        if marked and not b.zone:
            left, right = left or ("bad", len(blocks)), right or ("bad", len(blocks))
        both_bad = left and right and left[0] == right[0] == "bad"
        if first[i] == "near" or b.zone:
            b.label = "bad" if both_bad else "good"
        elif not (left or right):
            b.label = "good"
        elif left and right and left[1] == right[1] and left[0] != right[0]:
            b.label = "bad"
        elif not (left and right) or left[0] == right[0]:
            b.label = (left or right)[0]
        else:
            b.label = right[0] if b.heading else min(left, right, key=lambda x: x[1])[0]


def classify(page: str, rules: Rules = Rules()) -> list[_Block]:  # noqa: B008
    """All blocks of a page with their labels, good or bad."""
    blocks, wrappers = _blocks(page)
    _unwrap(blocks, wrappers, rules)
    _lift(blocks, rules)
    fits = _stop_density(" ".join(b.text for b in blocks if not b.bad)) >= rules.fit
    marked = any(b.zone and not b.bad for b in blocks)
    for b in blocks:
        b.label = _first_pass(b, rules, fits, marked)
    # one linked block between others of an article is a sentence of it; several are a list of links
    lone = lambda i, j: not (0 <= j < len(blocks)) or blocks[j].zone != blocks[i].zone or not _linked(blocks[j], rules)
    for i, b in enumerate(blocks):
        if b.zone and not b.bad and not b.weak and _linked(b, rules) and lone(i, i - 1) and lone(i, i + 1):
            b.label = "ambiguous"
    _second_pass(blocks)
    return blocks


def extract(page: str | None, rules: Rules = Rules()) -> str:  # noqa: B008
    """The main text of one page: its good blocks in order, joined by a space."""
    return " ".join(b.text for b in classify(page, rules) if b.label == "good") if page else ""


def extract_pages(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html); further columns are ignored.

    Null and empty html give an empty text. Character references are decoded once; white space of any kind becomes one
    space. Broken markup is read as far as it goes: elements left open end with their parent, unknown end tags are
    passed over. Rows are independent: repeated rows, null ids and empty tables need no rule.
    """

    small_batches(pages.sparkSession)
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            text = [extract(x, rules) for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": [len(x) for x in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
