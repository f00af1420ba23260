"""Main text of web pages by two passes of rules over their blocks.

A page is cut into blocks at block-level elements. The first pass decides by
where a block stands (menus, forms and their like never hold main text), by
link density, by length and by the density of stop words; short blocks stay
ambiguous. In the second pass an ambiguous block takes the label of its
nearest decided neighbours on both sides: with neighbours of one kind it takes
theirs, between kinds it is main text if a main block is as near as any other
or if it stands within the page's article. On a page whose text no list of stop
words fits, long blocks and shorter ones that end as a sentence are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.common import rows_of

#: Characters up to which a block is short, and from which stop words may make it long text.
SHORT, LONG = 70, 200
#: Densities: links above which a block is none of the main text, stop words that speak for running text.
MOST_LINKS, FEW_STOPS, MANY_STOPS = 0.33, 0.15, 0.30

# Common stop words of some languages.
STOP_WORDS = frozenset("""
a about all also an and are as at be been but by can could do for from had has have he her his i if in into is it its more no not
of on one or our out she so some than that the their them there they this to up was we were what when which who will with would you your
aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in
ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn wie wird zu zum zur
au aux avec ce ces cette comme d dans de des du elle en est et eu il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui
sa se ses son sont sur un une vous y
al como con cuando de del desde donde el ella ellos en entre era es esta este esto fue ha hay la las le lo los me mi muy más no o para pero por
porque que se ser si sin sobre son su sus también te tiene un una uno y ya
ao as com da das do dos e ela ele em essa foi isso mas na nas no nos não os ou pela pelo quando seu sua são um uma
che chi ci con da dal dei del della di e gli il io la le lo ma nel non per più sono sua un una
aan als bij dan dat de die dit een en er het hij ik in is je maar met naar niet nog of om ook op te uit van voor wat wel worden zijn zo
""".split())

# Element names of HTML.
_BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search
section select summary table tbody td textarea tfoot th thead title tr ul video audio canvas""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav aside form footer menu head title select button fieldset dialog iframe object noscript textarea search video audio canvas".split())
_RAW = "script|style|template|svg|math|xmp|noembed|noframes"
_AUTO_CLOSED = frozenset("p li dt dd tr td th option".split())
_CELLS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Words in class and id names that mark blocks around the main text: a whole name, its head (last) word, or its first before words of place and size.
_AROUND = re.compile(
    r"ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|side-?bar|side|widget\w*|nav|navbar|navigation|menu|breadcrumbs?|"
    r"footer|foot|header|masthead|topbar|toolbar|comments?|comment-?list|disqus|respond|replies|notices?|cookies?|consent|gdpr|popup|modal|"
    r"newsletter|subscribe|subscription|share|sharing|social|related|recommended|pagination|pager|copyright|disclaimer|alert|login|signup|search")
_PLACES = re.compile(
    r"wrap|wrapper|container|inner|outer|area|block|box|list|left|right|top|bottom|primary|secondary|main|section|slot|unit|item|items|links?|"
    r"icons?|buttons?|bar|posts?|articles?|form|panel|column|col|content|text|title|widgets?|nav|menu|message|overlay|dialog|thread|\d+|[a-z]")
#: First words that say a layout has such a block, and those of an article's own header.
_LAYOUT = frozenset("with without has have no not is hide show toggle enable disable content layout page body".split())
_OWN_HEADER = frozenset("entry post article story content main body".split())
_HEADERS = frozenset("header masthead".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S | re.I)
_SPACE = re.compile(r"[\s\x00]+")
_WORDS = re.compile(r"[^\W\d_]+")
#: Characters of scripts that write a syllable or word in one (kana, Han, Hangul): each counts as three letters. Ends of sentences, before closing marks.
_WIDE = re.compile(r"[\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff]")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff0e\uff01\uff1f\u0964\u0965\u061f\u06d4\u0589\u1362\u17d4\u104b][\"'\u00bb\u201d\u2019\u300d\u300f)\uff09\]]*$")

MAIN, OTHER, OPEN = 1, 0, -1
NAMED, HIDDEN = 1, 2


class _Block:
    __slots__ = ("article", "heading", "inside", "linked", "never", "text")

    def __init__(self, text: str, linked: int, never: bool, article: bool, heading: bool, inside: bool) -> None:
        self.text, self.linked, self.never, self.article, self.heading, self.inside = text, linked, never, article, heading, inside


def _named_around(value: str, article: bool) -> bool:
    """Whether a class or id value (lower case) names something around the main text."""
    for token in value.split():
        words = [w for w in re.split("[-_]+", token) if w]
        if not words:
            continue
        head = words[-1]
        if head in _HEADERS and (article or (len(words) > 1 and words[0] in _OWN_HEADER)):
            continue
        if _AROUND.fullmatch("-".join(words)):
            return True
        if len(words) > 1 and words[0] not in _LAYOUT - {"page", "body"} | (_LAYOUT if head.startswith("side") else frozenset()):
            first = words[0] not in _HEADERS or not article
            if _AROUND.fullmatch(head) or (first and _AROUND.fullmatch(words[0]) and all(map(_PLACES.fullmatch, words[1:]))):
                return True
    return False


def _around(name: str, attributes: str, article: bool) -> int:
    """Whether an element's attributes mark it as around the main text: ``HIDDEN`` by what it is, ``NAMED`` by class or id, or 0."""
    named = 0
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return HIDDEN
        if key == "role" and value in _ROLES:
            return HIDDEN
        if key in ("class", "id") and name not in ("body", "html", "article", "main") and _named_around(value, article):
            named = NAMED
    return named


def blocks(page: str) -> list[_Block]:
    """The page's blocks that hold text, in page order."""
    out: list[_Block] = []
    # Open elements: name, what rules main text out, within an article, within a heading, whether a name outside the article rules it out.
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    # Where each name stands in the stack, so that an end tag finds its element at once however deep the page is.
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = anchors = 0

    def leave(k: int) -> None:
        """Closes the elements from place ``k`` on."""
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                _, never, article, heading, inside = stack[-1]
                out.append(_Block(text, min(linked, len(text)), bool(never), article, heading, inside))
            parts.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
            if anchors:
                linked += len(parts[-1].strip())
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        ending, attributes = m[2] or m[5], m[4] or m[7] or ""
        if name == "a":
            anchors = max(0, anchors - 1) if ending else 1
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK or (name in ("span", "ins") and attributes and _around(name, attributes, stack[-1][2])):
            close()
            anchors = 0
            if ending:
                open_ = places.get(name)
                if open_:
                    leave(open_[-1])
            elif name not in _VOID:
                if name in _CELLS:
                    open_ = places.get(name)
                    if open_ and not any(places.get(n) and places[n][-1] > open_[-1] for n in _CELLS[name]):
                        leave(open_[-1])
                if stack[-1][0] == "p":
                    leave(len(stack) - 1)
                _, never, article, heading, inside = stack[-1]
                main = name == "main" or 'role="main"' in attributes.lower()
                # A wrapper's name does not rule out the page's main element, nor its article if it has no other.
                if never == NAMED and (main or (name == "article" and not article)):
                    never, inside = 0, not main
                if name in _NEVER or (name == "header" and not article):
                    never = HIDDEN
                elif attributes and not main:
                    never = max(never, _around(name, attributes, article))
                elif attributes and _around(name, attributes, article) == HIDDEN:
                    never = HIDDEN
                places.setdefault(name, []).append(len(stack))
                stack.append((name, never, article or main or name == "article", heading or name in ("h1", "h2", "h3", "h4", "h5", "h6"), inside))
        elif ending and name in ("span", "ins") and stack[-1][0] == name:
            close()
            leave(len(stack) - 1)
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


def classify(found: list[_Block]) -> list[bool]:
    """Whether each block is main text."""
    labels, sizes, hits, counts = [], [], [], []
    within = any(b.article and not b.never for b in found)
    outside = any(b.article and not b.never and not b.inside for b in found)
    for b in found:
        sizes.append(_size(b.text))
        if b.never or (b.inside and outside) or b.linked > MOST_LINKS * len(b.text) or "\xa9" in b.text[:2]:
            labels.append(OTHER)
        else:
            labels.append(OPEN)
        own = _WORDS.findall(b.text.lower()) if labels[-1] == OPEN and sizes[-1] >= SHORT else []
        hits.append(sum(map(STOP_WORDS.__contains__, own)))
        counts.append(max(1, len(own)))
    # If most of the page's running text is below the least density, its language has no list here.
    running = [(n, h >= FEW_STOPS * c) for n, h, c, label in zip(sizes, hits, counts, labels, strict=True) if label == OPEN and n >= SHORT]
    listed = 2 * sum(n for n, fits in running if fits) >= sum(n for n, _ in running)
    for k, b in enumerate(found):
        if labels[k] == OTHER or sizes[k] < SHORT:
            continue
        density = hits[k] / counts[k]
        fits = density >= MANY_STOPS or (density >= FEW_STOPS and sizes[k] > LONG)
        if fits or (not listed and (sizes[k] > LONG or _SENTENCE.search(b.text))):
            labels[k] = OTHER if within and not b.article else MAIN
    before, after, n = [None] * len(found), [None] * len(found), len(found)
    near = None
    for k in range(n):
        near = k if labels[k] != OPEN else near
        before[k] = near
    near = None
    for k in range(n - 1, -1, -1):
        near = k if labels[k] != OPEN else near
        after[k] = near
    out = []
    for k, b in enumerate(found):
        if labels[k] != OPEN:
            out.append(labels[k] == MAIN)
        elif within:
            out.append(b.article)
        else:
            sides = [(abs(k - j), labels[j]) for j in (before[k], after[k]) if j is not None]
            least = min(sides, default=(0, OTHER))[0]
            out.append(any(d == least and label == MAIN for d, label in sides) or (not sides and not b.linked))
    return out


def main_text(page: str) -> str:
    """The main blocks joined by line breaks; the empty text if there are none."""
    found = blocks(page)
    return "\n".join([b.text for b, main in zip(found, classify(found), strict=True) if main])


def extract(df: DataFrame, page: str = "html", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in ``keep``, then text and n_chars (its code points).

    A null page counts as empty; a page without main text has the empty text.
    Broken markup is read as far as it goes: unclosed comments and scripts
    reach to the page's end. Long and deeply nested pages are read whole, in
    time that grows with their length. Rows are independent; repeated ones stay
    repeated and an empty table gives none.
    """
    keep = keep or {}
    names = [*keep, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            made = [main_text(p or "") for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())], names=names)

    source = df.select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{page}`").cast("string").alias("__page"))
    return source.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["text string", "n_chars long"]))
