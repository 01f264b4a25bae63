"""Main text of web pages by tag-path ratios.

Every block of text has the path of tags that leads to it from the root. Over a page, the
text length, punctuation, link text and number of nodes of each path are summed; length and
punctuation ratios of a path are smoothed with those of similar paths, fused into one score and
held against a threshold. The deepest element that holds nearly all text of the paths
over the threshold is the article; its blocks are the result, with every other block whose path
is over the threshold and the headings beside them, without those under elements
that are never part of an article (menus, forms, notices, adverts, comments and the like).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element of the first kind ends an open one of the second, up to the third.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that are never part of an article, by tag, by role and by a word of class or id.
APART_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg math button select "
    "textarea input menu dialog object embed canvas audio video map noembed noframes title "
    "datalist".split())
APART_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu "
    "menubar toolbar".split())
APART_WORDS = re.compile(
    r"^(?:ads?|adv|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|header|masthead|footer|sidebars?|aside|rail|"
    r"widgets?|comments?|commentlist|disqus|respond|replies|reply|discussion|cookies?|consent|"
    r"gdpr|notices?|banners?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|login|share|sharing|social|related|recommended|recommendations|pagination|pager|"
    r"toolbar|search|form|copyright|disclaimer|skip|hidden|teasers?|outbrain|taboola)$")
#: Words that name a part of an article's frame; with these before them they do not.
MODIFIERS = frozenset("with without no non not has have show hide".split())
#: Words after the one that tells what an element is.
STRUCTURE = frozenset(
    "area bar block body bottom box btn button buttons center col column container content "
    "element group holder icons inner item items layout left link links list main module panel "
    "placeholder posts right row section slot top unit widget wrap wrapper".split())
#: Names that an article also has inside it, or with these words before them.
OWN_WORDS = frozenset("header masthead discussion".split())
OWN = frozenset("article content entry post story".split())
#: Names that stay apart however much text they hold; others do not if they hold this share of
#: the text whose paths score high.
ALWAYS = re.compile(
    r"^(?:ads?|adv|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|"
    r"comments?|commentlist|disqus|respond|replies|reply|outbrain|taboola)$")
MOST = 0.5
#: Elements that may wrap a whole page although their tag sets them apart.
WRAPPERS = frozenset("form aside header dialog".split())
PUNCTUATION = frozenset(".,;:!?…。，、；：！？\"'()«»„“”‘’")
ROOTS = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of an article, never all of it.
PARTS = HEADINGS | frozenset(
    "p li ul ol dl dt dd table thead tbody tfoot tr td th blockquote pre figure section".split())

# Every character is matched in one way only, and a tag that the page's end cuts off ends with it:
# the time does not grow faster than the page.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|"
    r"<([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Za-z]+")
#: A path counts as content from this share of the standard deviation of the scores on.
THRESHOLD = 0.5
#: The article is the deepest element with this share of the content.
HELD = 0.9


class Element:
    __slots__ = ("tag", "step", "parent", "apart", "doubtful", "depth", "root")

    def __init__(self, tag: str, step: str, parent: Element | None, apart: str):
        self.tag, self.step, self.parent = tag, step, parent
        self.apart = apart == "always" or (parent is not None and parent.apart)
        self.doubtful = apart == "doubtful"
        self.depth = parent.depth + 1 if parent else 0

    def path(self) -> tuple[str, ...]:
        steps, at = [], self
        while at is not None:
            steps.append(at.step)
            at = at.parent
        return tuple(reversed(steps))


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def _named_apart(name: str, inside: bool) -> str:
    """Whether one class name or id names a part that is not the article's."""
    words = [w.lower() for w in WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name))]
    while len(words) > 1 and words[-1] in STRUCTURE and not APART_WORDS.match(words[-1]):
        words.pop()
    if not words or not APART_WORDS.match(words[-1]) or MODIFIERS.intersection(words[:-1]):
        return ""
    if words[-1] in OWN_WORDS and (inside or OWN.intersection(words[:-1])):
        return ""
    return "always" if ALWAYS.match(words[-1]) else "doubtful"


def _apart(tag: str, attributes: dict[str, str], parent: Element | None) -> str:
    """Whether an element is never part of an article (always), not unless it holds most of the
    text (doubtful), or may be (empty)."""
    if "hidden" in attributes or (tag in APART_TAGS and tag not in WRAPPERS):
        return "always"
    if tag in ("html", "body", "article", "main"):
        return ""
    if attributes.get("aria-hidden", "").lower() == "true":
        return "always"
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return "always"
    inside = parent
    while inside is not None and inside.tag not in ROOTS:
        inside = inside.parent
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    found = {_named_apart(name, inside is not None) for name in names}
    if "always" in found:
        return "always"
    if tag in APART_TAGS or (tag == "header" and inside is None):  # its own holds its title
        return "doubtful"
    if attributes.get("role", "").strip().lower() in APART_ROLES:
        return "doubtful"
    return "doubtful" if "doubtful" in found else ""


def blocks(html: str) -> list[tuple[Element, str, int]]:
    """Blocks of text in page order: the element, the text, the length of link text in it."""
    top = Element("#", "#", None, "")
    at, found = top, []
    parts: list[str] = []
    linked = links = 0
    inlines: list[tuple[str, bool]] = []  # open inline elements, and whether they are apart

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((at, text, linked))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not any(apart for _, apart in inlines):
            text = unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.strip())

    def close(upto: Element) -> None:
        nonlocal at
        flush()
        at = upto

    position = 0
    while position < len(html):
        token = TOKEN.search(html, position)
        if token is None:
            add(html[position:])
            break
        add(html[position:token.start()])
        position = token.end()
        end, start, raw = token.group(1, 2, 3)
        if end:
            end = end.lower()
            if end == "br":
                parts.append(" ")
            elif end in INLINE:
                for i in range(len(inlines) - 1, -1, -1):
                    if inlines[i][0] == end:
                        if end == "a":
                            links = max(0, links - 1)
                        del inlines[i]
                        break
            else:
                up = at
                while up is not top and up.tag != end:
                    up = up.parent
                if up is not top:
                    close(up.parent)
                    inlines, links = [], 0
                elif end == "p":
                    flush()
            continue
        if not start:
            continue
        tag = start.lower()
        attributes = _attributes(raw) if raw.strip() else {}
        if tag in RAW:
            after = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, position)
            if tag not in INLINE:
                flush()
            position = after.end() if after else len(html)
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag not in VOID:
                inlines.append((tag, bool(_apart(tag, attributes, at))))
                links += tag == "a"
            continue
        if tag in ("html", "body") and any(
            e.tag == tag for e in _lineage(at)
        ):
            continue
        up = None
        if tag == "body":
            up = next((e.parent for e in _lineage(at) if e.tag == "head"), None)
        elif tag in SIBLINGS:
            ended, stop = SIBLINGS[tag]
            for e in _lineage(at):
                if e.tag in stop:
                    break
                if e.tag in ended:
                    up = e.parent
        elif tag in ENDS_PARAGRAPH:
            up = next((e.parent for e in _lineage(at) if e.tag == "p"), None)
        close(up if up is not None else at)
        inlines = [x for x in inlines if x[1]] if up is None else []
        if up is not None:
            links = 0
        if tag in VOID:
            continue
        names = " ".join(sorted(attributes.get("class", "").lower().split()))
        at = Element(tag, f"{tag}.{names}" if names else tag, at, _apart(tag, attributes, at))
    flush()
    return found


def _lineage(at: Element | None) -> Iterator[Element]:
    while at is not None:
        yield at
        at = at.parent


def _alike(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """How alike two paths are: the common start over the longer length."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return same / max(len(a), len(b))


def path_scores(found: list[tuple[Element, str, int]]) -> dict[tuple[str, ...], float]:
    """Fused, smoothed length and punctuation ratio of every path."""
    length: Counter = Counter()
    marks: Counter = Counter()
    nodes: Counter = Counter()
    linked: Counter = Counter()
    for element, text, link in found:
        path = element.path()
        length[path] += len(text)
        marks[path] += sum(text.count(c) for c in PUNCTUATION)
        nodes[path] += 1
        linked[path] += min(link, len(text))
    raw = {
        p: (length[p] / nodes[p] * (1 - linked[p] / length[p]), (1 + marks[p]) / nodes[p])
        for p in nodes
    }
    scores = {}
    paths = sorted(raw)
    for i, p in enumerate(paths):
        near = paths[max(0, i - 2): i + 3]  # sorted, so the most alike paths are next to it
        weights = [1.0 if q == p else 0.5 * _alike(p, q) ** 4 for q in near]
        text, punctuation = (
            sum(w * raw[q][k] for w, q in zip(weights, near)) / sum(weights) for k in (0, 1))
        scores[p] = text * math.log1p(punctuation)
    return scores


def _kept(found: list[tuple[Element, str, int]], high: set[int]) -> list[int]:
    """Places of the blocks that are under no element set apart.

    A doubtful element with most of the high-scoring text is not set apart; on a page with a
    marked article, only if it is around or inside one.
    """
    marked = {id(e) for b in found for r in _lineage(b[0]) if r.tag in ROOTS
              for e in _lineage(r)}
    held: Counter = Counter()
    for i in high:
        for e in _lineage(found[i][0]):
            held[id(e)] += len(found[i][1])
    total = sum(len(found[i][1]) for i in high)

    def apart(e: Element) -> bool:
        if not e.doubtful:
            return False
        near = not marked or id(e) in marked or any(x.tag in ROOTS for x in _lineage(e))
        return not (near and held[id(e)] >= MOST * total > 0)

    return [i for i, b in enumerate(found) if not any(apart(e) for e in _lineage(b[0]))]


def main_text(html: str | None) -> str:
    """The article's blocks, one per line; empty if the page has none."""
    found = [b for b in blocks(html or "") if not b[0].apart]
    if not found:
        return ""
    scores = path_scores(found)
    values = list(scores.values())
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    least = min(mean, THRESHOLD * spread) if spread else 0.0
    high = {i for i, b in enumerate(found) if scores[b[0].path()] >= least}
    kept = _kept(found, high)
    if not kept:
        return ""
    if not high.intersection(kept):
        high = set(kept)
    held: defaultdict[int, int] = defaultdict(int)
    elements: dict[int, Element] = {}
    total = 0
    for i in kept:
        if i in high:
            element, text, _ = found[i]
            total += len(text)
            for e in _lineage(element):
                held[id(e)] += len(text)
                elements[id(e)] = e
    # A marked article counts as one element with the others of its kind on the page.
    for tag in ROOTS:
        if sum(held[i] for i, e in elements.items() if e.tag == tag
               and not any(x.tag == tag for x in _lineage(e.parent))) >= total / 2 > 0:
            return "\n".join(
                found[i][1] for i in kept if any(x.tag == tag for x in _lineage(found[i][0])))
    root = max(
        (e for i, e in elements.items() if held[i] >= HELD * total), key=lambda e: e.depth)
    while root.tag in PARTS and root.parent:
        root = root.parent
    # The lowest element around all of them; headings beside the article are in it or next to it.
    whole = root
    for i in high.intersection(kept):
        line = {id(e) for e in _lineage(found[i][0])}
        while id(whole) not in line:
            whole = whole.parent
    beside = {id(whole), id(root.parent)}

    def chosen(i: int) -> bool:
        element = found[i][0]
        if i in high or any(x is root for x in _lineage(element)):
            return True
        return element.tag in HEADINGS and any(
            id(e) in beside for e in (element.parent, element.parent.parent))

    return "\n".join(found[i][1] for i in kept if chosen(i))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null page is an empty one and gives an empty text. Repeated rows are extracted each;
    null ids and addresses are kept; extra columns are not read.
    """
    def text_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page) for page in batch["html"]]
            yield pd.DataFrame({
                "page_id": batch["page_id"].astype("Int64"), "url": batch["url"],
                "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInPandas(
        text_of, "page_id long, url string, text string, n_chars long")
