"""Main text of web pages by composite text density.

For every node of the document tree, characters per tag, lessened by the share of link text,
are its density. The subtree whose children have the largest sum of densities is the text; the
least density on the way from it to the body is the threshold above which further nodes give
their best subtree too. Elements that never hold article text are taken out before.
Inside article and main only whole names of such elements count; a form stays if it holds most of the text.
"""

from __future__ import annotations

import html as references
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import whole

_TAG = re.compile(
    r"<!--(?:.*?-->|.*+)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S
)
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside button select option input "
    "textarea label menu dialog audio video map title noembed noframes xmp".split()
)
# Words of class, id and role that mark an element as no part of the article.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|overlay|menu|nav\w*"
    r"|breadcrumbs?|sidebar|side|widget|footer|header|masthead|topbar|toolbar|comments?|commentlist|replies|disqus|respond"
    r"|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|paywall|pagination|pager|skip"
    r"|complementary|navigation|contentinfo|legal|copyright)(?:$|[\s_-])"
)
# Inside article and main, names of sections and of the article's own header are no marks: a whole name has to be one.
_INNER_MARKS = re.compile(
    r"(?:(?:post|entry|article|page|site|single|content|inline)[_-])?"
    r"(?:ads?|advert\w*|sponsor\w*|promo|cookies?|consent|popup|modal|menu|nav(?:bar|igation)?|breadcrumbs?|sidebar|widget|footer"
    r"|comments?|commentlist|replies|disqus|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login"
    r"|paywall|pagination|pager|complementary|contentinfo)"
    r"(?:[_-](?:ads?|bar|box|block|buttons?|icons?|links?|list|form|posts?|articles?|stories|wrapper|container|widget|section|area|banner))*"
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
# A form stays from this share of the page's text on.
_FORM_SHARE = 0.5
# An open element of the first kind ends when one of the second begins; not beyond the third.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDS = frozenset("ul ol dl table body html article section main div td th".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Tree:
    """Nodes in page order (a child always after its parent) and pieces of text with their node and block."""

    def __init__(self, page: str):
        self.parent, self.tag, self.out, self.block_node = [-1], ["#root"], [False], [True]
        self.texts: list[tuple[int, int, str]] = []
        self.body = 0
        self.block = 0
        at, stack = 0, [0]
        for m in iter(lambda: _TAG.search(page, at), None):
            self._text(stack[-1], page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag in _BLOCK:
                self.block += 1
            if m[1]:
                self._close(stack, tag)
                continue
            self._open(stack, tag, m[3])
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                stack.pop()
        self._text(stack[-1], page[at:])
        self._judge_forms()
        if any(node < self.body and text != " " for node, _, text in self.texts):
            self.body = 0

    def _judge_forms(self) -> None:
        """Take out the forms that do not hold most of the text."""
        if "form" not in self.tag:
            return
        chars = [0] * len(self.tag)
        for node, _, text in self.texts:
            chars[node] += len(text) if text != " " else 0
        for i in range(len(chars) - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        for i in range(1, len(chars)):
            self.out[i] |= self.out[self.parent[i]] or self.tag[i] == "form" and chars[i] < _FORM_SHARE * chars[0]
        self.texts = [t for t in self.texts if not self.out[t[0]]]

    def _text(self, node: int, text: str) -> None:
        if text and not self.out[node] and not text.isspace():
            self.texts.append((node, self.block, references.unescape(text)))
        elif text and not self.out[node]:
            self.texts.append((node, self.block, " "))

    def _open(self, stack: list[int], tag: str, rest: str) -> None:
        if tag in _BLOCK:
            self._until(stack, {"p"} | (_HEADING if tag in _HEADING else set()), _BOUNDS)
        if tag in _ENDS:
            self._until(stack, _ENDS[tag], _BOUNDS - {"td", "th"} if tag == "tr" else _BOUNDS - _ENDS[tag])
        if tag == "body" and self.body:
            return
        parent = stack[-1]
        out = self.out[parent] or tag in _NEVER or bool(rest) and _marked(tag, rest, self._inside(stack))
        self.parent.append(parent)
        self.tag.append(tag)
        self.out.append(out)
        self.block_node.append(tag in _BLOCK)
        if tag == "br":
            self.texts.append((parent, self.block, " "))
        if tag == "body":
            self.body = len(self.tag) - 1
        if tag not in _VOID:
            stack.append(len(self.tag) - 1)

    def _inside(self, stack: list[int]) -> bool:
        return any(self.tag[n] in ("article", "main") for n in stack)

    def _until(self, stack: list[int], ended: set[str], bounds: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in ended:
                del stack[k:]
                return
            if tag in bounds:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        if tag in ("body", "html"):
            # What comes after still belongs to the body.
            last = max((k for k, n in enumerate(stack) if self.tag[n] in ("body", "html")), default=0)
            del stack[last + 1 :]
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                del stack[k:]
                return


def _marked(tag: str, rest: str, inside: bool) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    if tag == "header" and not inside:
        return True
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), a or b or c)
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _NO_DISPLAY.search(found.get("style", "")):
        return True
    labels = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
    if inside:
        return any(_INNER_MARKS.fullmatch(name) for name in labels.split())
    return bool(_MARKS.search(labels))


def _densities(tree: _Tree) -> tuple[list[float], list[float]]:
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = tree.tag[i] == "a" or linked[tree.parent[i]]
    for node, _, text in tree.texts:
        size = len(text) if text != " " else 0
        chars[node] += size
        if linked[node]:
            link_chars[node] += size
    for i in range(n - 1, 0, -1):
        if tree.out[i]:
            continue
        p = tree.parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    whole_chars = max(chars[tree.body], 1)
    share = link_chars[tree.body] / whole_chars
    density = [0.0] * n
    for i in range(n):
        c = chars[i]
        if c:
            t, lc, lt = max(tags[i], 1), link_chars[i], max(link_tags[i], 1)
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            gain = max(c / max(lc, 1) * t / lt, 1.0)
            # Without any link on the page the base is 1 for every node, and the gain counts by itself.
            density[i] = c / t * (math.log(gain) / math.log(base) if base > 1 else math.log(gain + 1))
    # Emphasis and the like is part of its block: only blocks add up and are chosen.
    sums, block = [0.0] * n, list(range(n))
    for i in range(1, n):
        if not tree.block_node[i]:
            block[i] = block[tree.parent[i]]
        elif not tree.out[i]:
            sums[block[tree.parent[i]]] += density[i]
    return density, sums


def main_text(page: str | None) -> str:
    """The article of a page, one line per block; empty if there is none."""
    if not page:
        return ""
    tree = _Tree(page)
    if not tree.texts:
        return ""
    density, sums = _densities(tree)
    n, top = len(tree.tag), tree.body
    under = [False] * n
    under[top] = True
    for i in range(top + 1, n):
        under[i] = under[tree.parent[i]] and not tree.out[i]
    best = max((i for i in range(n) if under[i]), key=lambda i: (sums[i], -i))
    threshold, i = density[best], best
    while i != top:
        i = tree.parent[i]
        threshold = min(threshold, density[i])
    # Best subtree below every node.
    best_below = list(range(n))
    for i in range(n - 1, top, -1):
        if under[i]:
            p = tree.parent[i]
            if (sums[best_below[i]], -best_below[i]) > (sums[best_below[p]], -best_below[p]):
                best_below[p] = best_below[i]
    kept = [False] * n
    for i in range(top, n):
        if under[i]:
            if i == best or tree.parent[i] >= 0 and kept[tree.parent[i]] and i != top:
                kept[i] = True
            elif i != top and tree.block_node[i] and density[i] >= threshold and density[i] > 0 and not _holds(tree, i, best):
                kept[best_below[i]] = True
    blocks: dict[int, list[str]] = {}
    for node, block, text in tree.texts:
        if kept[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def _holds(tree: _Tree, node: int, inner: int) -> bool:
    while inner > node:
        inner = tree.parent[inner]
    return inner == node


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``, the main text of each whole page.

    Row by row, without a shuffle. Null and empty pages give an empty text, pages without tags
    their whole text; unclosed and crossing tags end where their parent ends. A column named
    ``out`` is replaced, others stay.
    """

    @F.arrow_udf(StringType())
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    return pages.withColumn(out, texts(whole(html)))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length of every page."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
