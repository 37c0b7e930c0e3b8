"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words, which score positive, and tags, which score
negative. The article is the contiguous run with the highest sum, found in one
pass. Weights are learned from labelled pages: pages whose markup names their
content (``article``, ``main`` and the like) tell which words and tags stand
inside and which outside. Within the run, parts that are no text of the article
(scripts, menus, forms, adverts, notices, reader comments and so on, by element
or by the words of their class, id or role) are left out.
"""

from __future__ import annotations

import html as html_module
import math
import re
from collections import Counter
from collections.abc import Iterator, Set
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Expected number of pages that weights are learned from.
MAX_LABELLED = 5_000

# Fixed values of HTML: elements without an end tag, elements whose content is
# not markup, elements that part blocks of text, and elements that a new block closes.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in _RAW}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr label".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
         "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SOFT = _INLINE | frozenset("p br h1 h2 h3 h4 h5 h6 blockquote pre".split()) - {"a"}
_STOPS = frozenset("ul ol dl table menu article section div main body html".split())

# Elements that never hold the article's text.
_OTHER = frozenset(
    "nav footer aside form script style noscript template textarea select button option svg canvas "
    "iframe object dialog menu head title audio video map xmp noembed noframes".split()
)
# Words of a class, id or role that tell the same.
_OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor "
    "sponsored promo promos promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar sidebars rail aside widget widgets footer foot masthead topbar toolbar cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login comment comments commentlist respond reply replies discussion disqus share sharing social "
    "related recommended recommendations pagination pager search searchbox form complementary "
    "contentinfo banner copyright disclaimer skip".split()
)
# Beginnings that tell it of compound words too, such as cookiebar.
_OTHER_STEMS = (
    "cookie", "sidebar", "advert", "sponsor", "navbar", "breadcrumb", "newsletter", "disqus",
    "footer", "popup",
)
# Elements whose id, inside named content, is made from a heading and tells nothing.
_SLUGGED = frozenset("section h1 h2 h3 h4 h5 h6 a span p dt".split())
# Elements of running text: inside named content only an advert's word marks one.
_TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd td th figure figcaption".split())
_ADVERT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored".split()
)
# Words that are also what a section is about: inside named content they mark neither a
# section by its class nor any element by its id.
_TOPICS = frozenset(
    "discussion related search searchbox alert notice notices login signup cookie cookies consent banner copyright "
    "disclaimer social share sharing rail respond reply replies navigation menu promotion form recommended".split()
)
# Elements of a page's head; any other begins the body.
_HEAD = frozenset("head base link meta title style script noscript template".split())
_COMMENT_WORDS = frozenset(
    "comment comments commentlist reply replies respond discussion disqus".split()
)
_HEADER_WORDS = frozenset({"header"})
_ROOT_WORDS = frozenset({"articlebody"})
_NEVER = frozenset({"html", "body"})

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(
    r"(?<![\w:.-])(class|id|role|itemprop|hidden|aria-hidden|style|aria-label)(?![\w:.-])\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I
)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


class Piece(NamedTuple):
    """A stretch of text or a tag."""

    kind: str  # "text", "tag"
    name: str  # of the tag; of text, the nearest element that parts blocks, or "a" in a link
    text: str
    words: int
    other: bool  # inside an element that is no text of the article
    soft: tuple[int, ...]  # the enclosing elements that only their words mark as such
    around: int  # how many of these enclose the element named as the content
    root: int  # inside an element named as the content: 2 an article, 1 a page's main part
    block: bool  # a tag that parts blocks


@dataclass
class Weights:
    """Scores of a word by where it stands (positive) and of tags (negative)."""

    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)
    default_word: float = 1.0
    default_link: float = 0.25
    default_tag: float = -2.0
    # Tags inside and between sentences say little about where a page's content ends.
    default_inline: float = -0.1

    def of_word(self, name: str) -> float:
        return self.word.get(name, self.default_link if name == "a" else self.default_word)

    def of_tag(self, name: str) -> float:
        return self.tag.get(name, self.default_inline if name in _SOFT else self.default_tag)


# Attributes repeat from page to page.
_known_marks: dict[str, tuple[frozenset[str], frozenset[str], bool, int]] = {}
_KNOWN_MARKS = 4096


def _marks(attrs: str) -> tuple[frozenset[str], frozenset[str], bool, int]:
    found = _known_marks.get(attrs)
    if found is None:
        found = _read_marks(attrs)
        if len(_known_marks) < _KNOWN_MARKS:
            _known_marks[attrs] = found
    return found


def _read_marks(attrs: str) -> tuple[frozenset[str], frozenset[str], bool, int]:
    """Words of class and role, and of the id; whether the element is hidden; how it is named as content."""
    words: set[str] = set()
    of_id: set[str] = set()
    hidden, root = False, 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            found = {w.lower() for w in _PART.findall(value)}
            found |= {w.lower() for w in re.split(r"[^A-Za-z]+", value) if w}
            if name == "id":
                of_id |= found
            else:
                words |= found
            if name == "role":
                root = max(root, {"article": 2, "main": 1}.get(value.lower(), 0))
        elif name == "itemprop" and value.lower() in _ROOT_WORDS:
            root = 2
        elif name == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "hidden":
            hidden = True
    return frozenset(words), frozenset(of_id), hidden, root


_Open = tuple[str, bool, int, str, tuple[int, ...], int]
_OUTSIDE: _Open = ("", False, 0, "", (), 0)
_PLAIN = (frozenset(), frozenset(), False, 0)
_ROOTS = {"article": 2, "main": 1}


def _is_other(name: str, hidden: bool, in_root: int) -> bool:
    """Whether the element itself is no text of the article."""
    return name not in _NEVER and (hidden or name in _OTHER or (not in_root and name == "header"))


def _is_marked(name: str, words: frozenset[str], of_id: frozenset[str], in_root: int) -> bool:
    """Whether the words of class, role and id say so."""
    if name in _NEVER:
        return False
    if in_root:
        # A section's or heading's id is a slug there, not a mark.
        slug = name in _SLUGGED or (name == "div" and "section" in words)
        words = (words - _TOPICS if name == "section" else words) | (frozenset() if slug else of_id - _TOPICS)
        if name in _TEXTUAL:
            words &= _ADVERT_WORDS
    else:
        words |= of_id
    if name in ("article", "main"):
        return bool(words & _COMMENT_WORDS)
    if not in_root and words & _HEADER_WORDS:
        return True
    return bool(words & _OTHER_WORDS) or any(w.startswith(_OTHER_STEMS) for w in words)


def pieces(page: str) -> Iterator[Piece]:
    """Text and tags in page order."""
    # Open elements: name, whether no text of the article, whether in the content, what
    # text directly inside is counted under, the numbers of the marked ones around, and
    # how many of these are around the content.
    stack: list[_Open] = []
    marked = 0
    # How often each element is open: what is not open need not be looked for.
    opened: Counter = Counter()
    top = _OUTSIDE
    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        stop = token.start() if token else end
        if at < stop:
            value = page[at:stop]
            if "&" in value:
                value = html_module.unescape(value)
            if top[0] == "head" and value.strip():
                _close(stack, opened, {"head"}, frozenset())
                top = stack[-1] if stack else _OUTSIDE
            yield Piece("text", top[3], value, len(value.split()), top[1], top[4], top[5], top[2], False)
        if token is None:
            return
        at = token.end()
        closing, name, attrs, closing2, name2, attrs2 = token.groups()
        if name is None:
            if name2 is None:
                continue
            closing, name, attrs = closing2, name2, attrs2
        name = name.lower()
        if closing:
            _, other, root, _, soft, around = top
            if opened[name]:
                _close(stack, opened, {name}, frozenset())
            top = stack[-1] if stack else _OUTSIDE
        else:
            # A head without an end tag ends where the body begins.
            if (name == "body" and opened["head"]) or (top[0] == "head" and name not in _HEAD):
                _close(stack, opened, {"head"}, frozenset())
                top = stack[-1] if stack else _OUTSIDE
            if name in _CLOSES:
                _close_implied(stack, opened, name)
                top = stack[-1] if stack else _OUTSIDE
            _, other, root, under, soft, around = top
            words, of_id, hidden, named = _marks(attrs) if len(attrs) > 4 else _PLAIN
            other = other or _is_other(name, hidden, root)
            if not other:
                if _is_marked(name, words, of_id, root):
                    marked += 1
                    soft = (*soft, marked)
                if max(named, _ROOTS.get(name, 0)) > root:
                    root, around = max(named, _ROOTS.get(name, 0)), len(soft)
            if name in _RAW:
                close = _RAW_END[name].search(page, at)
                at = close.end() if close else end
            elif name not in _VOID and not attrs.endswith("/"):
                if under != "a" and (name == "a" or name not in _INLINE):
                    under = name
                top = (name, other, root, under, soft, around)
                stack.append(top)
                opened[name] += 1
        yield Piece("tag", name, "", 0, other, soft, around, root, name not in _INLINE)


_CLOSES = _CLOSES_P | set(_SAME)


def _close(
    stack: list[_Open], opened: Counter, names: Set[str], stops: Set[str]
) -> None:
    """Close the innermost of ``names`` and all within, unless one of ``stops`` is met first."""
    for depth in range(len(stack) - 1, -1, -1):
        if stack[depth][0] in names:
            opened.subtract(x[0] for x in stack[depth:])
            del stack[depth:]
            return
        if stack[depth][0] in stops:
            return


def _close_implied(
    stack: list[_Open], opened: Counter, name: str
) -> None:
    """Close what a start tag ends without an end tag."""
    if name in _CLOSES_P and opened["p"]:
        _close(stack, opened, {"p"}, _STOPS)
    same = _SAME.get(name)
    if same and any(opened[n] for n in same):
        _close(stack, opened, same, _STOPS)


def _rooted(page: str) -> tuple[list[Piece], int]:
    """The pieces, and the narrowest kind of named content that holds words, 0 for none.

    Marked elements are no text of the article. But where all named content stands in
    them, such as in a wrapper of class ``has-sidebar``, those around it are not marked.
    """
    found = list(pieces(page))
    rooted = max((p.root for p in found if p.words and not p.other and not p.soft), default=0)
    around: set[int] = set()
    if not rooted:
        named = [p for p in found if p.words and not p.other and p.root and len(p.soft) == p.around]
        rooted = max((p.root for p in named), default=0)
        held: Counter = Counter()
        for p in named:
            if p.root == rooted:
                held[p.soft] += p.words
        if held:  # the marks around the longest content
            around = set(max(held, key=lambda marks: (held[marks], marks)))
    return [p if around.issuperset(p.soft) else p._replace(other=True) for p in found], rooted


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best run; white space is one space, blocks are joined by one.

    Where the markup names the content, tags inside it cost nothing and words
    outside count against the run.
    """
    found, rooted = _rooted(page or "")
    best, best_from, best_to = 0.0, 0, 0
    total, begin = 0.0, 0
    for i, p in enumerate(found):
        if p.other:
            continue
        if p.kind == "tag":
            if rooted and p.root >= rooted:
                continue
            total += weights.of_tag(p.name)
        elif p.root >= rooted:
            total += weights.of_word(p.name) * p.words
        else:
            total -= weights.default_word * p.words
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, best_from, best_to = total, begin, i + 1
    out: list[str] = []
    for p in found[best_from:best_to]:
        if p.kind == "tag":
            if p.block:
                out.append(" ")
        elif not p.other and p.root >= rooted:
            out.append(p.text)
    return " ".join("".join(out).split())


def count_labelled(page: str) -> Counter:
    """Of a page whose markup names its content: ``(what, name, inside)`` counts."""
    found, rooted = _rooted(page)
    out: Counter = Counter()
    if not rooted:
        return out
    for p in found:
        # Parts that are left out by their markup have no score to learn.
        if p.other:
            continue
        inside = p.root >= rooted
        # The naming elements themselves would only repeat the label.
        if p.kind == "tag" and p.name not in ("article", "main"):
            out["tag", p.name, inside] += 1
        elif p.words:
            out["word", p.name, inside] += p.words
    return out


def _weights(counts: dict[tuple[str, str, bool], int]) -> Weights:
    """Log odds of inside against outside; words are kept positive and tags negative."""
    weights = Weights()
    for what, low, high in (("word", 0.25, 2.0), ("tag", -4.0, -0.2)):
        names = {name for w, name, _ in counts if w == what}
        for name in names:
            inside, outside = counts.get((what, name, True), 0), counts.get((what, name, False), 0)
            odds = math.log((inside + 1) / (outside + 1))
            centre = 1.0 if what == "word" else -2.0
            value = min(high, max(low, centre + odds))
            (weights.word if what == "word" else weights.tag)[name] = value
    return weights


def learn(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> Weights:
    """Weights from a sample of about ``max_labelled`` pages, drawn by a hash of the page id.

    Pages without named content are not labelled and count nothing; elements that
    no labelled page has keep the defaults of ``Weights``. Only counts per element name
    of HTML come to the driver.
    """
    n = pages.count()
    share = min(1.0, max_labelled / max(n, 1))
    place = F.shiftrightunsigned(F.xxhash64("page_id", "url"), 1)
    rows = pages if share >= 1.0 else pages.where(place < F.lit(int(share * 2.0**63)))
    rows = rows.where(F.col("html").isNotNull()).select(F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _VOID | _RAW | _INLINE | _CLOSES_P | _OTHER | _STOPS | set(_SAME)
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0):
                for (what, name, inside), n in count_labelled(page.as_py()).items():
                    total[what, name if name in known or not name else "other", inside] += n
            if total:
                columns = list(zip(*[(*key, n) for key, n in total.items()]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["what", "name", "inside", "n"]
                )

    counted = rows.mapInArrow(run, "what string, name string, inside boolean, n long")
    found = counted.groupBy("what", "name", "inside").agg(F.sum("n").alias("n")).collect()
    return _weights({(r["what"], r["name"], r["inside"]): r["n"] for r in found})


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Per row of ``pages`` its ``page_id``, ``url``, ``text`` and ``n_chars``.

    Whole pages are read and no text of the run is cut. A null or empty page, or
    one without words, has an empty text. Repeated rows and null ids are kept;
    other columns take no part; an empty table gives an empty one. Without
    ``weights`` they are learned from ``pages``.
    """
    if weights is None:
        weights = learn(pages.select("page_id", "url", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return rows.mapInArrow(run, ", ".join([*kinds, "text string, n_chars long"]))
