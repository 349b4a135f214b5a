"""Main text of web pages by scoring the element tree.

Each page is parsed into a tree by a small tolerant scanner. Elements that never hold the article (scripts, menus,
forms, adverts, notices, reader comments) are left out. Every remaining paragraph earns points for its length and
commas; its parent gets them in full, ancestors further up a falling share, all discounted by the share of text inside
links. The container with most points is the article; siblings that score well, or read like paragraphs, are kept.

Class and id names are hints. Reader comments go; another clear name (an advert, a sidebar) counts unless the element holds
most of the article around it; a name that an article may use itself (``discussion``, ``related-work``, ``header``) is set aside for scoring only,
and inside the chosen article such an element goes only if its text is mostly links, or a few words in a plain container.
Lists of links stay inside an article.
Trees are walked without recursion, so depth and length of a page are not limited; the work is linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

NAME = re.compile(r"</?[a-zA-Z][^\s/>]*")
IN_TAG = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of the HTML standard: elements without content, with raw content, and laid out as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body br head html option select tbody td tfoot th thead tr summary legend".split())
CLOSED_BY_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("article aside body blockquote button div footer header html li main nav section table td th".split())

NEVER_TEXT = RAW | frozenset(
    "head nav footer aside form button select option input dialog menu template object canvas svg math audio video "
    "applet map datalist".split())
NEVER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class and id names that mark what is not the article, and those that may name parts of an article, too.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsored promo promos sidebar sidebars menu menus nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert newsletter popup modal pagination pager paywall".split())
READERS = frozenset("comment comments commentlist disqus".split())
AMBIGUOUS = frozenset(
    "sponsor sponsors promotion banner banners footer masthead header topbar respond reply replies discussion share sharing social "
    "related recommended recommendations subscribe subscription signup login overlay widget widgets skip toolbar copyright".split())
#: Parts that make a name speak of a layout around something, and beginnings of names for the head of an article.
LAYOUT = frozenset("with has no without layout".split())
TITLED = frozenset("article post entry story content".split())
KEPT_TAGS = frozenset("html body main article".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption h1 h2 h3 h4 h5 h6 div section article main".split())
#: Points for the element itself, and the share of a paragraph's points that each ancestor gets.
BONUS = {"article": 25.0, "main": 15.0}
NAME_BONUS = 10.0
SHARES = (1.0, 0.5, 1 / 6, 1 / 9)
CHARS_A_POINT = 100
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0
SIBLING_CHARS, SIBLING_LINKS, LINK_LIST = 80, 0.25, 0.5
#: An element with more than this share of its article is no advert or notice, whatever its name.
MOST = 0.5
#: In an article, plain containers with an ambiguous name go if they hold at most so many characters.
FEW_CHARS = 100
PLAIN = frozenset("div span ul ol center".split())
ALWAYS, CLEAR, VAGUE, NEITHER = 3, 2, 1, 0


def name_hint(name: str) -> int:
    """Does a class or id name something beside the article, such as ``page-sidebar``, and not its title or a layout?"""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    if LAYOUT & set(parts) or parts[-1:] == ["header"] and TITLED & set(parts):
        return NEITHER
    return ALWAYS if READERS & set(parts) else CLEAR if UNLIKELY & set(parts) else VAGUE if AMBIGUOUS & set(parts) else NEITHER


def next_tag(html: str, at: int, last: int) -> tuple[int, int, str, bool, str] | None:
    """(begin, end, name, whether it closes, attributes) of the next tag or comment (no name) at or behind a place.

    ``last`` is the place of the last ``>``: nothing behind it is a tag. A quote without its partner is an ordinary letter.
    """
    while 0 <= (begin := html.find("<", at)) < last:
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            return begin, end + 3 if end >= 0 else len(html), "", False, ""
        if html.startswith("<![CDATA[", begin):
            end = html.find("]]>", begin)
            return begin, end + 3 if end >= 0 else len(html), "", False, ""
        if html.startswith(("<!", "<?"), begin):
            return begin, html.find(">", begin) + 1, "", False, ""
        if named := NAME.match(html, begin):
            place = named.end()
            while found := IN_TAG.search(html, place):
                if found[0] == ">":
                    end = found.end()
                    break
                partner = html.find(found[0], found.end())
                place = partner + 1 if partner >= 0 else found.end()
            else:
                end = html.find(">", named.end()) + 1
            name = named[0].lstrip("</").lower()
            return begin, end, name, named[0][1] == "/", html[named.end():end - 1]
        at = begin + 1
    begin = html.find("<!--", at)
    return (begin, len(html), "", False, "") if begin >= 0 else None


class Page:
    """Elements by number in page order (a parent before its children) and the sequence of texts and block borders."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attributes, self.block = ["#"], [0], [""], [0]
        self.items: list[tuple[int, str | None]] = []
        self._parse(html)

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attributes.append(attributes)
        self.block.append(len(self.block) if tag in BLOCK else self.block[parent])
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack, at, items, tags, last = [0], 0, self.items, self.tag, html.rfind(">")
        open_now: Counter[str] = Counter()

        def cut_back(wanted: set | frozenset, borders: set | frozenset) -> None:
            if not any(open_now[w] for w in wanted):
                return
            for k in range(len(stack) - 1, 0, -1):
                name = tags[stack[k]]
                if name in wanted:
                    open_now.subtract([tags[e] for e in stack[k:]])
                    del stack[k:]
                    return
                if name in borders:
                    return

        while at < len(html):
            found = next_tag(html, at, last)
            end = found[0] if found else len(html)
            if end > at:
                items.append((stack[-1], unescape(html[at:end])))
            if not found:
                break
            _, at, name, closes, attributes = found
            if not name:
                continue
            if closes:
                if name in BLOCK:
                    items.append((stack[-1], None))
                    cut_back({name}, frozenset(("html",)) if name == "body" else SCOPE - {name} if name in ("p", "li", "td") else frozenset())
                else:
                    cut_back({name}, BLOCK)
                continue
            if name in CLOSES_P:
                cut_back({"p"}, SCOPE)
            if name in CLOSED_BY_SAME:
                cut_back(*CLOSED_BY_SAME[name])
            if name == "br" or name == "hr":
                items.append((stack[-1], None))
                continue
            if name in VOID or attributes.endswith("/") and name not in BLOCK and name not in RAW:
                continue
            node = self._open(name, stack[-1], attributes)
            if name in BLOCK:
                items.append((node, None))
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else len(html)
            else:
                stack.append(node)
                open_now[name] += 1

    def _hint(self, node: int) -> int:
        tag, raw = self.tag[node], self.attributes[node]
        if not raw or tag in KEPT_TAGS:
            return NEITHER
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)}
        return max(map(name_hint, f"{found.get('class', '')} {found.get('id', '')}".split()), default=NEITHER)

    def _hidden(self, node: int) -> bool:
        tag, raw = self.tag[node], self.attributes[node]
        if not raw or tag in KEPT_TAGS:
            return False
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)}
        if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in NEVER_ROLES:
            return True
        return "display:none" in found.get("style", "").replace(" ", "").lower()

    def _amounts(self, dropped: list[bool], linked: list[bool]) -> tuple[list[int], ...]:
        """Characters, those in links and commas below every element, and characters of its own as a block."""
        n = len(self.tag)
        length, links, commas, own = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.items:
            if text is not None and not dropped[node] and (size := len(" ".join(text.split()))):
                length[node] += size
                links[node] += size * linked[node]
                commas[node] += text.count(",") + text.count("、") + text.count("，") + text.count("،")
                own[self.block[node]] += size
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            length[up] += length[k]
            links[up] += links[k]
            commas[up] += commas[k]
        return length, links, commas, own

    def main_text(self) -> str:
        tag, parent = self.tag, self.parent
        n = len(tag)
        never, linked, inside, around, home = [False] * n, [False] * n, [False] * n, [False] * n, [0] * n
        for k in range(n - 1, 0, -1):  # what holds an article is never left out for its name
            around[parent[k]] |= around[k] or tag[k] in ("article", "main")
        for k in range(1, n):
            up = parent[k]
            inside[k] = inside[up] or tag[up] in ("article", "main")
            home[k] = up if tag[up] in ("article", "main") else home[up]
            header = tag[k] == "header" and not inside[k]
            never[k] = never[up] or tag[k] in NEVER_TEXT or not around[k] and (header or self._hidden(k))
            linked[k] = linked[up] or tag[k] == "a"
        hint = [NEITHER if around[k] or never[k] else self._hint(k) for k in range(n)]
        whole, whole_links = self._amounts(never, linked)[:2] if any(hint) else ([], [])
        dropped, aside = never[:], [False] * n
        for k in range(1, n):
            up = parent[k]
            dropped[k] |= dropped[up]
            aside[k] = aside[up]
            if hint[k] and not dropped[k] and (not inside[k] or hint[k] == ALWAYS or whole[k] <= MOST * whole[home[k]]):
                dropped[k] = True
                aside[k] = hint[k] == VAGUE
        set_aside, dropped_for_good = aside, [d and not a for d, a in zip(dropped, aside)]
        length, links, commas, own = self._amounts(dropped, linked)
        score = [0.0] * n
        for k in range(1, n):
            if dropped[k] or tag[k] not in PARAGRAPHS or not own[k]:
                continue
            share_of_own = own[k] / length[k]
            points = (1 + commas[k] * share_of_own + own[k] / CHARS_A_POINT) * (1 - links[k] / length[k])
            up = k if tag[k] in ("div", "section", "article", "main") else parent[k]
            for share in SHARES:
                if not up:
                    break
                score[up] += points * share
                up = parent[up]
        best, most = 0, 0.0
        for k in range(1, n):
            if score[k] > 0 and not dropped[k]:
                score[k] = (score[k] + self._bonus(k)) * (1 - links[k] / max(length[k], 1))
                if score[k] > most:
                    best, most = k, score[k]
        if not best:
            roots = {0}
        else:
            roots = {best} | {
                k for k in range(1, n)
                if parent[k] == parent[best] and k != best and not dropped[k] and length[k]
                and self._sibling(k, score[k], most, length[k], links[k] / length[k])}
        kept = [False] * n
        kept[0] = 0 in roots
        in_link_list, out = [False] * n, dropped_for_good
        prose = [False] * n  # has an earlier child that reads as prose
        for k in range(1, n):
            up = parent[k]
            kept[k] = kept[up] or k in roots
            out[k] |= out[up]
            if hint[k] == VAGUE and set_aside[k] and kept[k] and not out[k]:
                few = tag[k] in PLAIN and whole[k] <= FEW_CHARS
                out[k] = few or whole_links[k] > LINK_LIST * whole[k]
            article = inside[k] or tag[k] in ("article", "main")
            in_link_list[k] = in_link_list[up] or (
                tag[k] in ("ul", "ol", "div", "section", "table") and k not in roots and length[k] > 0
                and links[k] / length[k] > LINK_LIST and not article and not prose[up])
            prose[up] |= tag[k] in PARAGRAPHS and length[k] > SIBLING_CHARS and links[k] < SIBLING_LINKS * length[k]
        pieces = []
        for node, text in self.items:
            if text is None:
                pieces.append(" ")
            elif kept[node] and not out[node] and not in_link_list[node]:
                pieces.append(text)
        return " ".join("".join(pieces).split())

    def _bonus(self, node: int) -> float:
        parts = {p.lower() for p in NAME_PARTS.findall(self.attributes[node])} if self.attributes[node] else set()
        return BONUS.get(self.tag[node], 0.0) + NAME_BONUS * bool(parts & {"article", "content", "post", "entry", "story"})

    def _sibling(self, node: int, score: float, most: float, length: int, link_share: float) -> bool:
        if self.tag[node] in ("h1", "h2"):
            return link_share < SIBLING_LINKS
        if score >= max(SIBLING_LEAST, SIBLING_SHARE * most):
            return True
        return self.tag[node] == "p" and length > SIBLING_CHARS and link_share < SIBLING_LINKS


def main_text(html: str | None) -> str:
    return Page(html or "").main_text()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([main_text(h) for h in batch.column(2).to_pylist()], pa.string())],
            ["id", "url", "text"])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``<id>, <url>, text, n_chars`` per row. A page without text, null html included, gives an empty text and 0; repeated
    rows repeat; null identifiers and addresses stay. Other columns are not read."""
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(_extract, f"id {kinds['id']}, url {kinds['url']}, text string")
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text",
                      F.length("text").cast("bigint").alias("n_chars"))
