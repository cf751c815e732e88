"""Main text of web pages by tag-path ratios.

Each block of text has a path of tags from the root. Per path, the mean text length and the mean number of punctuation marks
are taken over all its blocks; both are smoothed along the page and fused into one value. Names of elements are evidence: they take
away most of a path's value (menus, headers, footers, notices, forms, comments), but no block falls away by its name alone. Paths below a
share of the page's best value fall away; the element that holds most of what is left is the article, and its blocks are the text.

A page is read in time and memory linear in its length: elements are numbered as they open, an element holds the numbers up to its last,
and sums over elements are carried from child to parent once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe"
#: Controls: their text is not the page's; an open one ends where a block begins or ends.
CONTROLS = frozenset("button select option label".split())
CONTAINERS = frozenset("article main section div body html table center form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an element of the same set ends, up to the container named last.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
}
#: Elements that never hold the article's own text, and elements and names that hold it only if the rest of the page says so.
ASIDE = frozenset("nav footer aside menu dialog head".split())
ASIDE_PERHAPS = frozenset(["form"])
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notices?|popup|modal|alert|"
    r"menu|nav|navbar|navigation|breadcrumbs?|side-?bar|widgets?|footer|masthead|site-header|page-header|comments?|"
    r"comment-\w+|disqus|repl(?:y|ies)|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|"
    r"toolbar|pagination|pager|skip-link)(?=$|[\s_-])",
    re.IGNORECASE,
)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?<!no[_-])(?<!has[_-])(?:comments?|disqus|repl(?:y|ies))(?=$|[\s_-])", re.IGNORECASE)
#: Quotes count after an equals sign only; the groups are atomic, so that no text is read twice.
ATTRIBUTES = r"(?>[^<>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/><]*+)({ATTRIBUTES})>|<[!?/][^<>]*+>|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；]")
#: Weights of a block and its neighbours; share of the best value that a path must reach; share of linked text in a menu.
SMOOTH = (0.15, 0.7, 0.15)
LEAST_SHARE = 0.4
MOST_LINKED = 0.5
#: Shares of the page's unlinked text: what an element with an aside name must exceed to be kept, what it needs besides an h1, and
#: what may stand outside one that is named for comments.
MOST_TEXT, H1_TEXT, OUTSIDE_COMMENTS = 0.5, 0.1, 0.1
#: What names leave of a path's value: those of asides, and not being in the page's article or main where there is one. And
#: the least value of text at all: a single letter outside asides has it, a whole aside has not.
ASIDE_EVIDENCE, OUTSIDE_EVIDENCE = 0.01, 0.5
LEAST_VALUE = 0.45


class Page:
    """Elements by number (0 is none) and blocks of text in order.

    For elements: ``parent``, ``kind``, ``path`` (a number for the block tags and names from the root), ``named`` (True: a name of an
    aside, None: in doubt, False: neither) and ``last``, the highest number inside. For blocks: ``element``, ``text``, ``linked``
    (characters inside links).
    """

    def __init__(self, source: str):
        self.parent, self.kind, self.path, self.names = [0], [""], [0], [""]
        self.named: list[bool | None] = [False]
        self.tag = [0]  # the innermost block element
        self.of_comments: set[int] = set()
        self.element: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self._read(source)
        self.last = list(range(len(self.parent)))
        for number in range(len(self.parent) - 1, 0, -1):
            self.last[self.parent[number]] = max(self.last[self.parent[number]], self.last[number])

    def _read(self, source: str) -> None:
        stack: list[int] = []
        #: places on the stack by kind of element, and those of blocks
        open_at: dict[str, list[int]] = {}
        blocks_at: list[int] = []
        paths: dict[tuple[int, str], int] = {}
        parts: list[str] = []
        linked = 0

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                kind = self.kind[stack.pop()]
                open_at[kind].pop()
                if blocks_at and blocks_at[-1] == len(stack):
                    blocks_at.pop()

        def nearest(kinds) -> int:
            return max((open_at[kind][-1] for kind in kinds if open_at.get(kind)), default=-1)

        def close_block() -> None:
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self.element.append(stack[-1] if stack else 0)
                    self.text.append(text)
                    self.linked.append(min(linked, len(text)))
                parts.clear()
            linked = 0

        for token in TOKEN.finditer(source):
            kind = token[3]
            if kind is None:
                body = token[0]
                if (body[0] != "<" or body == "<") and nearest(CONTROLS) < 0:
                    parts.append(body)
                    if open_at.get("a"):
                        linked += len(body.strip())
                continue
            kind = kind.lower()
            if kind in BLOCKS:
                close_block()
                control = min((places[0] for places in map(open_at.get, CONTROLS) if places), default=None)
                if control is not None:
                    close_to(control)
            elif kind == "br":
                parts.append(" ")
            if token[2]:
                at = nearest([kind])
                # an inline end tag does not end a block
                if at >= 0 and (kind in BLOCKS or not blocks_at or blocks_at[-1] < at):
                    close_to(at)
                continue
            if kind in VOID:
                continue
            if kind in BLOCKS and open_at.get("p"):
                close_to(open_at["p"][0])
            elif kind in SIBLINGS:
                ended, container = SIBLINGS[kind]
                at = nearest(ended)
                if at > nearest(container):
                    close_to(at)
            names = " ".join(a or b or c for a, b, c in NAMES.findall(token[4])) if "=" in token[4] else ""
            inside = bool(open_at.get("article") or open_at.get("main"))
            named: bool | None = kind in ASIDE or (kind == "header" and not inside)
            if not named and (kind in ASIDE_PERHAPS or (names and ASIDE_NAMES.search(names))):
                named = None
            if kind in ("html", "body"):
                named = False
            number, up = len(self.parent), stack[-1] if stack else 0
            if named is None and COMMENT_NAMES.search(names):
                self.of_comments.add(number)
            self.parent.append(up)
            self.kind.append(kind)
            self.named.append(named)
            label = f"{kind}.{names}" if names else kind
            self.path.append(paths.setdefault((self.path[up], label), len(paths) + 1) if kind in BLOCKS else self.path[up])
            self.tag.append(number if kind in BLOCKS else self.tag[up])
            open_at.setdefault(kind, []).append(len(stack))
            if kind in BLOCKS:
                blocks_at.append(len(stack))
            stack.append(number)
        close_block()

    def summed(self, own: list[float]) -> list[float]:
        """Values of elements with those of all elements inside."""
        total = list(own)
        for number in range(len(total) - 1, 0, -1):
            total[self.parent[number]] += total[number]
        return total

    def region(self, element: int) -> int:
        """The article or main around an element (or itself), else the nearest container that is not a single run of text."""
        around = []
        while element:
            around.append(element)
            element = self.parent[element]
        meant = [x for x in around if self.kind[x] in ("article", "main")]
        return (meant or [x for x in around if self.kind[x] in CONTAINERS] or [0])[0]

    def over_blocks(self, values) -> list[float]:
        """Sums of block values over the elements that hold them."""
        own = [0.0] * len(self.parent)
        for element, value in zip(self.element, values):
            own[element] += value
        return self.summed(own)

    def asides(self) -> tuple[list[bool], list[bool]]:
        """For each element whether its name or one around it speaks against it, and whether it is part of a main or an article.

        Elements in doubt that hold the article are cleared."""
        n = len(self.parent)
        definite = [False] * n  # inside an element with the name of an aside
        for number in range(1, n):
            definite[number] = self.named[number] is True or definite[self.parent[number]]
        sizes = [max(0, len(text) - linked) for text, linked in zip(self.text, self.linked)]
        inside = self.over_blocks(0 if definite[e] else size for e, size in zip(self.element, sizes))
        total = inside[0]

        def marked(kinds) -> list[int]:
            return [x for x in range(1, n) if self.kind[x] in kinds and not definite[x]]

        def holding(numbers) -> list[float]:
            own = [0.0] * n
            for x in numbers:
                own[x] = 1.0
            return self.summed(own)

        # beside a main or an article that is not in doubt itself, the size of an element says nothing: a short page has a long ad
        sure = [x for x in marked(("main", "article")) if self.named[x] is not None]
        in_sure = [False] * n
        for number in range(1, n):
            in_sure[number] = in_sure[self.parent[number]]
        for x in sure:
            in_sure[x] = True
        for number in range(1, n):
            in_sure[number] = in_sure[number] or in_sure[self.parent[number]]
        weighed = holding({e for e in self.element if not sure or in_sure[e]})
        mains, titles = holding(marked(("main",))), holding(marked(("h1",)))
        cleared: set[int] = set()
        for x in range(1, n):
            if self.named[x] is None:
                share = 1 - OUTSIDE_COMMENTS if x in self.of_comments else MOST_TEXT
                if (weighed[x] and inside[x] > share * total) or mains[x] or (titles[x] and inside[x] >= H1_TEXT * total):
                    cleared.add(x)
        plain = [x for x in marked(("article",)) if self.named[x] is not None]
        if plain:
            x = max(plain, key=lambda number: (inside[number], -number))
            while x:
                cleared.add(x)
                x = self.parent[x]
        bad = [False] * n
        for x in range(1, n):
            bad[x] = bad[self.parent[x]] or self.named[x] is True or (self.named[x] is None and x not in cleared)
        return bad, [good and not against for good, against in zip(in_sure, bad)]


def path_values(page: Page, evidence: np.ndarray) -> np.ndarray:
    """The fused value of each block: smoothed ratios of text and of punctuation of its path, times the evidence of names."""
    paths = {path: i for i, path in enumerate(dict.fromkeys(page.path[e] for e in page.element))}
    at = np.array([paths[page.path[e]] for e in page.element])
    number = np.bincount(at)
    sizes = [len(text) - linked for text, linked in zip(page.text, page.linked)]
    marks = [len(PUNCTUATION.findall(text)) for text in page.text]
    ratios = []
    for measure in (sizes, marks):
        ratio = (np.bincount(at, measure) / number)[at]
        padded = np.pad(ratio, 1, mode="edge")
        ratios.append(SMOOTH[0] * padded[:-2] + SMOOTH[1] * padded[1:-1] + SMOOTH[2] * padded[2:])
    value = np.log1p(ratios[0]) * np.log1p(1 + ratios[1]) * evidence
    # one value per path: that of its blocks on average
    return (np.bincount(at, value) / number)[at]


def main_text(source: str) -> str:
    """The blocks of the article, joined by an empty line; empty if the page has no text of an article's kind.

    Blocks of chosen paths are text wherever they stand. The innermost element that holds them all is the article's region; in it, short
    blocks (headings, list items, captions) are attached, unless they are menus or their names speak against them.
    """
    page = Page(source)
    if not page.text:
        return ""
    bad, inside = page.asides()
    against = np.array([bad[e] for e in page.element])
    within = np.array([inside[e] for e in page.element])
    evidence = np.where(against, ASIDE_EVIDENCE, np.where(within | ~within.any(), 1.0, OUTSIDE_EVIDENCE))
    value = path_values(page, evidence)
    chosen = value >= max(LEAST_VALUE, LEAST_SHARE * value.max())
    if not chosen.any():
        return ""
    held = page.over_blocks(chosen.astype(float))
    region = page.region(max(x for x in range(len(held)) if held[x] >= held[0]))
    # the elements meant for text, in which every block is attached; elsewhere a bare div is not
    part_of = [False] * len(held)
    for x in range(1, len(held)):
        part_of[x] = part_of[page.parent[x]] or (held[x] > 0 and page.kind[x] in ("article", "main"))
    kept = []
    begun = False
    for element, text, linked, good, aside in zip(page.element, page.text, page.linked, chosen, against):
        if not (region <= element <= page.last[region]):
            continue
        tag = page.kind[page.tag[element]]
        begun = begun or good
        # a list of links after the article's first text is its own: sources, further reading
        menu = linked > MOST_LINKED * len(text) and tag in ("li", "ul", "ol", "div", "td") and not (begun and part_of[element])
        attached = part_of[element] or tag in HEADINGS or tag not in ("div", "body", "html", "section", "")
        if good or (attached and not menu and not aside):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    Null or empty html gives an empty text. Null ids and urls stay; repeated rows give repeated results. Tags that are never
    closed end where HTML ends them. No shuffle, one page at a time.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [main_text(x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(texts, type=pa.string()),
                    pa.array(map(len, texts), type=pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {name: pages.schema[name].dataType.simpleString() for name in ("page_id", "url")}
    slim = pages.select("page_id", "url", pages["html"].cast("string").alias("html"))
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return slim.mapInArrow(run, schema)
