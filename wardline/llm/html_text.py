"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with the path of tags from the root to it. Text length and punctuation
are summed over all blocks of the page with one path and divided by their number, so that a short paragraph counts as
much as the long ones beside it. Both ratios are smoothed over neighbouring blocks and fused by multiplication; blocks
at or above a share of the ratios' standard deviation are the core. Elements that are never content (scripts, styles,
form fields, navigation, hidden ones, and those whose role is one of these) take no part. Forms, and elements whose class
or id names a menu, advert, notice, sidebar or comments, are left out of the core, unless they hold most of the page's text
or there is no other text; names such as has-sidebar or no-comments say nothing. Elements whose class or id is nothing but
a word for comments are left out however long they are, unless there is no other text.
The smallest element that holds all of the core, or the article element around it, is the article; its blocks are the
text, headings and short ones included. Where that element is the body itself, each of the body's elements with some of
the core has its own. Headings before the kept come along, as do the blocks between: paragraphs, or all from a heading
on that stands beside the kept element.

Results: one row per input row. A null or empty page, and one without any text, gives an empty text. Broken markup is
read as browsers do for the common cases: open paragraphs, items and cells end where the next one begins, and an end
tag closes what is open inside it. After a tag that never ends within its quotes, tags end at the next `>`. The time is
linear in the page, whatever its markup. Repeated rows give repeated results. Other columns are kept where asked for.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm.common import map_batches

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe xmp noframes noembed template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_ROOTS = frozenset(("", "html", "body"))
_PARTS = frozenset("p li td th tr tbody ul ol dd dt blockquote pre".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NEVER = frozenset(
    "nav aside footer button select option input label menu dialog head object canvas audio video map datalist".split()
)
#: Start tag -> open elements that it ends, and the elements beyond which it ends none.
_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))), "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
}
_CLOSES_P = _BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
#: Elements that count as if their class named them as boilerplate.
_WEIGHED = frozenset(("form", "fieldset"))
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|menu|nav(?:bar|igation)?|breadcrumbs?|side-?bar|"
    r"widgets?|footer|site-?header|page-?header|masthead|cookies?|consent|gdpr|notices?|alert|pop-?up|modal|overlay|newsletter|subscribe|"
    r"subscription|sign-?up|login|share|sharing|social|related(?![_-]works?(?:$|[_-]))|recommended|comments?|comment-?list|discuss(?:ion)?|disqus|responses?|replies|"
    r"respond|skip|toolbar|pagination|pager|copyright|legal|disclaimer)(?:$|[\s_-])"
)
#: Whole class names and ids of reader comments.
_COMMENTS = re.compile(r"(?:user-?|reader-?|post-?|article-?)?(?:comments?|comment-?list|comments?-?(?:area|section|thread|wrapper|container)|discussion|disqus(?:[_-]thread)?|responses|replies|respond)")
#: Class names that say what a wrapper has or lacks, such as has-sidebar or no-comments.
_SAYS = re.compile(r"(?:^|[_-])(?:has|no|with|without)[_-]")
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar alertdialog".split())
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_MARKS = re.compile(r"[>\"']")
#: An attribute's name and value.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s"'>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_SIGNS = re.compile(r"[,.;:!?…、。，！？¿¡]")


def _boilerplate(name: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element and all inside it is never content, and whether it is boilerplate by its class or id: 1, or 2 for
    comments."""
    if name in _NEVER or (name == "header" and not in_article):
        return True, 0
    named, seen = int(name in _WEIGHED), set()
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key in seen:
            continue  # the first of two equal names counts
        seen.add(key)
        if key in ("class", "id"):
            if name not in ("body", "html", "main", "article"):
                for v in value.split():
                    if _COMMENTS.fullmatch(v):
                        named = 2
                    elif _NAMES.search(v) and not _SAYS.search(v):
                        named = max(named, 1)
        elif key == "role":
            if value in _ROLES - {"form"}:
                return True, 0
            named = max(named, int(value == "form"))
        elif key in ("hidden", "aria-hidden") and value != "false" and name not in ("body", "html") and (key == "hidden" or value == "true"):
            return True, 0
    return False, named


def _text(words: list[tuple[int, str]]) -> str:
    return " ".join(html.unescape("".join(w for _, w in words)).split())


def _tag_end(source: str, at: int, quoted: bool) -> int:
    """The place behind the `>` that ends a tag, one in quotes not counted, or -1. A quote that is never closed is a sign
    like others."""
    if not quoted:
        return source.find(">", at) + 1 or -1
    while (mark := _MARKS.search(source, at)) is not None:
        if mark[0] == ">":
            return mark.end()
        at = source.find(mark[0], mark.end()) + 1
        if not at:
            return -1
    return -1


class _Page:
    """The text blocks of a page: the words of each, with the elements that they are in."""

    def __init__(self, source: str):
        self.parent, self.names, self.barred, self.paths = [-1], [""], [False], [0]
        self.named = [0]  # the innermost element with a boilerplate name that an element is or is in
        self.comments: set[int] = set()  # elements with a name of reader comments
        self.in_article = [False]
        self.numbers: dict[tuple[int, str], int] = {}  # of tag paths, by that of the path above and the last tag
        self.n_open: Counter[str] = Counter()
        self.blocks: list[list[tuple[int, str]]] = []
        self.open = [0]
        self.words: list[tuple[int, str]] = []
        self._read(source)

    def _say(self, text: str) -> None:
        if not self.barred[self.open[-1]]:
            self.words.append((self.open[-1], text))

    def _break(self) -> None:
        if self.words:
            if _text(self.words):
                self.blocks.append(self.words)
            self.words = []

    def _close(self, k: int) -> None:
        if any(self.names[e] in _BLOCK for e in self.open[k:]):
            self._break()
        self.n_open.subtract(self.names[e] for e in self.open[k:])
        del self.open[k:]

    def _start(self, name: str, attributes: str) -> None:
        open_, names, n_open = self.open, self.names, self.n_open
        if name in _CLOSES_P and n_open["p"]:
            for k in range(len(open_) - 1, 0, -1):
                if names[open_[k]] == "p":
                    self._close(k)
                    break
                if names[open_[k]] in ("button", "table", "td", "th", "caption"):
                    break
        if name in _ENDS:
            ended, limit = _ENDS[name]
            last, left = 0, sum(n_open[e] for e in ended)
            for k in range(len(open_) - 1, 0, -1):
                if not left or names[open_[k]] in limit:
                    break
                if names[open_[k]] in ended:
                    last, left = k, left - 1
            if last:
                self._close(last)
        if name in _BLOCK:
            self._break()
        if name in _VOID:
            if name in ("br", "wbr"):
                self._say(" " if name == "br" else "")
            return
        above = open_[-1]
        barred, named = _boilerplate(name, attributes, self.in_article[above])
        if named == 2:
            self.comments.add(len(self.named))
        self.in_article.append(self.in_article[above] or name in ("article", "main"))
        self.parent.append(above)
        self.names.append(name)
        self.barred.append(self.barred[above] or barred)
        self.named.append(len(self.named) if named else self.named[above])
        self.paths.append(self.numbers.setdefault((self.paths[above], name), len(self.numbers) + 1))
        open_.append(len(self.parent) - 1)
        n_open[name] += 1

    def _read(self, source: str) -> None:
        at, n, quoted = 0, len(source), True
        ends: dict[str, re.Pattern] = {}
        closed = {}  # raw elements that have no end tag from here on
        while at < n:
            found = _OPEN.search(source, at)
            if found is None:
                self._say(source[at:])
                break
            if found[1] or found[2]:
                end = source.find("-->" if found[1] else ">", found.end())
                end = n if end < 0 else end + (3 if found[1] else 1)
            else:
                end = _tag_end(source, found.end(), quoted)
                if end < 0 and quoted:
                    quoted, end = False, _tag_end(source, found.end(), False)
                if end < 0:  # no tag ends from here on
                    self._say(source[at:])
                    break
            if found.start() > at:
                self._say(source[at:found.start()])
            at = end
            name = found[4]
            if name is None:
                continue
            name = name.lower()
            if found[3]:
                if self.n_open[name]:
                    for k in range(len(self.open) - 1, 0, -1):
                        if self.names[self.open[k]] == name:
                            self._close(k)
                            break
                continue
            attributes = source[found.end():end - 1]
            if name in _RAW:
                if not attributes.endswith("/") or name not in ("svg", "math"):
                    if name not in ends:
                        ends[name] = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I)
                    last = None if closed.get(name) else ends[name].search(source, at)
                    closed[name] = last is None
                    at = last.end() if last else n
                continue
            self._start(name, attributes)
            if attributes.endswith("/") and name not in _VOID and name not in _BLOCK and self.names[self.open[-1]] == name:
                self.n_open[name] -= 1
                self.open.pop()
        self._break()

    def block(self, element: int) -> int:
        """The innermost block element that an element is or is in."""
        while element and self.names[element] not in _BLOCK:
            element = self.parent[element]
        return element

    def holder(self, element: int, known: dict[int, int]) -> int:
        """The container that an element is or is in, or -1. `known` says it of containers and of elements seen before."""
        seen = []
        while element >= 0 and element not in known:
            seen.append(element)
            element = self.parent[element]
        found = known[element] if element >= 0 else -1
        known.update(dict.fromkeys(seen, found))
        return found

    def containers(self, places: list[int]) -> list[int]:
        """The smallest elements that hold all of the given block elements; below the body, one for each of its own
        elements that holds some."""
        chain = [places[0]]
        while self.parent[chain[-1]] >= 0:
            chain.append(self.parent[chain[-1]])
        above = {e: k for k, e in enumerate(chain)}  # the first of the chain that an element is or is in
        common = chain[max(self.holder(e, above) for e in places)]
        if self.names[common] in _ROOTS:
            groups: dict[int, list[int]] = {}
            tops: dict[int, int] = {common: common}
            for e in places:
                seen, top = [], e
                while top not in tops and self.parent[top] != common:
                    seen.append(top)
                    top = self.parent[top]
                top = tops.setdefault(top, top)
                tops.update(dict.fromkeys(seen, top))
                if top != common:
                    groups.setdefault(top, []).append(e)
            return [c for own in groups.values() for c in self.containers(own)]
        while (self.names[common] in _PARTS or self.names[common] in _HEADINGS) and self.names[self.parent[common]] not in _ROOTS:
            common = self.parent[common]  # one long block is not the whole article
        article = common
        while article and self.names[article] != "article":
            article = self.parent[article]
        return [article or common]


def _smooth(values: np.ndarray) -> np.ndarray:
    if len(values) < 3:
        return values
    edges = np.concatenate((values[:1], values, values[-1:]))
    return 0.25 * edges[:-2] + 0.5 * edges[1:-1] + 0.25 * edges[2:]


def _kept(page: _Page) -> list[list[tuple[int, str]]]:
    """The words of each block that are in no element with a boilerplate name. An element counts as named only if it
    holds no more than half of the page's text, and no more than half of its signs or less than a third of its text;
    where nothing else is left, none does."""
    mass = {0: [0, 0]}
    for words in page.blocks:
        for element, word in words:
            own = mass.setdefault(page.named[element], [0, 0])
            own[0] += len("".join(word.split()))
            own[1] += len(_SIGNS.findall(word))
    for e in range(len(page.named) - 1, 0, -1):  # what is in an element is in those around it
        if e in mass:
            around = mass.setdefault(page.named[page.parent[e]], [0, 0])
            around[0] += mass[e][0]
            around[1] += mass[e][1]
    chars, signs = mass[0]
    gone = {0: False}
    for e in sorted(mass)[1:]:
        own = mass[e]
        most = e not in page.comments and (2 * own[0] > chars or (2 * own[1] > signs and 3 * own[0] >= chars))
        gone[e] = not most or gone.get(page.named[page.parent[e]], False)
    kept = [[(e, w) for e, w in words if not gone[page.named[e]]] for words in page.blocks]
    return kept if any(map(_text, kept)) else page.blocks


def main_blocks(source: str | None, share: float = 0.5) -> list[str]:
    """The texts of a page's content blocks. `share` of the standard deviation is the threshold of the fused ratios."""
    if not source:
        return []
    page = _Page(source)
    if not page.blocks:
        return []
    every = [(words[0][0], _text(words)) for words in page.blocks]
    sums: dict[int, list[int]] = {}
    for element, text in every:
        own = sums.setdefault(page.paths[element], [0, 0, 0])
        own[0] += len(text)
        own[1] += len(_SIGNS.findall(text))
        own[2] += 1
    ratio = {path: (chars / n, signs / n) for path, (chars, signs, n) in sums.items()}
    length = _smooth(np.array([ratio[page.paths[e]][0] for e, _ in every]))
    signs = _smooth(np.array([ratio[page.paths[e]][1] for e, _ in every]))
    fused = length * (1 + signs)
    least = share * fused.std()
    # names are evidence besides the ratios, which all blocks have a part in
    left = [(own, words[0][0], text) for own, words in zip(fused, _kept(page), strict=True) if (text := _text(words))]
    blocks = [(element, text) for _, element, text in left]
    fused = np.array([own for own, _, _ in left])
    core = fused >= least
    if not core.any():
        core = fused >= fused.max()
    places = [page.block(element) for element, _ in blocks]
    containers = set(page.containers([place for place, own in zip(places, core, strict=True) if own]))
    known = {c: c for c in containers}
    holders = [page.holder(place, known) for place in places]
    keep = core | (np.array(holders) >= 0)
    heading = [page.names[place] in _HEADINGS for place in places]
    beside: dict[int, int] = {}  # the first heading among the elements of each
    for k, place in enumerate(places):
        if heading[k]:
            beside.setdefault(page.parent[place], k)
    for k in range(1, len(blocks)):
        if not keep[k] or keep[k - 1]:
            continue
        # headings and leads before the kept: those in a row, and all from a heading beside the container on
        first = k
        at = k - 1
        while at >= 0 and not keep[at] and (heading[at] or page.names[places[at]] == "p"):
            if heading[at]:
                first = at
            at -= 1
        if holders[k] >= 0 and page.names[above := page.parent[holders[k]]] not in _ROOTS:
            first = min(first, beside.get(above, first))
        keep[first:k] = True
    return [text for (_, text), own in zip(blocks, keep, strict=True) if own]


def extract(pages: DataFrame, columns: list[str], source: str = "html") -> DataFrame:
    """The named columns of each page, and `text`: its content blocks, one per line."""
    n = len(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(s)) for s in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*columns, "text"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)
    return map_batches(pages.select(*[f"`{c}`" for c in columns], pages[source].alias("__html")), work, f"{kinds}, text string")
