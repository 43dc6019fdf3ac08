"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the containers that they stand in, tags below zero; both
weights are learned from a bounded sample of pages whose markup labels the content itself (one article or main
element). One linear scan finds the contiguous region of the highest score; what stands in containers for
menus, notices, comments and the like inside the region goes, and the rest is the text, block by block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import released, sliced, small_batches, stored, table, texts_of

#: The bounded sample of labelled pages: so many at most, those with the smallest hash of their id.
MAX_LABELLED = 2_000
LIMIT = 4.0  # weights lie between its negative and itself
PRIOR_WORDS = 50.0  # so many words would have to speak against a prior

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: attributes up to the end of a tag; a quote opens a value only after =. Nothing is tried twice (possessive).
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=>)|(?!["'])))*+>""")
RAW = frozenset("script style textarea title".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: elements that hold whole parts of a page
CONTAINERS = frozenset("nav header footer aside form section article main div table dialog menu select fieldset figure blockquote ul ol dl".split())
#: Elements without text of the page. They end at their end tag or where their parent ends; foreign ones also at the first of FLOW, as in HTML.
SKIPPED = frozenset("noscript template iframe svg math".split())
FOREIGN = frozenset("svg math".split())
FLOW = frozenset("article aside b big blockquote body br center code dd div dl dt em embed form footer h1 h2 h3 h4 h5 h6 head header hr i img li main menu meta nav ol p pre ruby s section small span strike strong sub sup table tt u ul var".split())
INTEGRATION = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
NOT_CONTENT = frozenset("nav footer aside form dialog menu select fieldset".split())
CONTENT = frozenset("article main".split())
#: A class name of parts is one of these if such a part is its noun: what follows it is in AFTER, and none in AROUND precedes it ("site-footer",
#: "comment-list", but not "comments-open", "no-sidebar", "category-social").
_NOT = re.compile(
    r"(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|sidebar|side|menus?|nav\w*|breadcrumbs?"
    r"|footer|masthead|shar(?:e|ing)|social|related|recommend\w*|comments?|comment\w*|repl(?:y|ies)|respond|disqus|login|signup|search|widgets?|toolbar|pag(?:ination|er)|complementary|contentinfo|navigation)",
    re.I,
)
AFTER = frozenset(
    "area bar bars block body bottom box button buttons column container content footer form group header holder icons inner item items left link links list panel"
    " pane posts post primary right secondary section slot stories text title top unit wrap wrapper zone".split()
)
AROUND = frozenset("with without no not non has have hide show is cat category tag topic type format after before single".split())
_YES = re.compile(r"(?:^|[\s_-])(?:content|main|post|entry|story|article\w*|body|text|hentry)(?=$|[\s_-])", re.I)
WHITE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
ID = " #"  # what follows it in a container's key are names that may be its own


class Skipped:
    """Follows the tags of a page: `takes` says of each whether it belongs to an element without text of the page."""

    def __init__(self):
        self.name, self.within = "", []
        self.opened: Counter[str] = Counter()
        self.held: Counter[str] = Counter()  # how often each name is in within

    def takes(self, tag: str, closing: bool, empty: bool) -> bool:
        if self.name:
            if self._ends(tag, closing):
                self.name, self.within = "", []
                self.held.clear()
            else:
                return self._inside(tag, closing, empty)
        if tag in SKIPPED:
            if not closing and not empty:
                self.name = tag
            return True
        if closing:
            self.opened[tag] -= self.opened[tag] > 0
        elif not empty and tag not in VOID:
            self.opened[tag] += 1
        return False

    def _ends(self, tag: str, closing: bool) -> bool:
        if closing:
            return not self.held[tag] and tag != self.name and self.opened[tag] > 0
        if tag == "body":
            return not self.within
        return self.name in FOREIGN and tag in FLOW and not any(self.held[i] for i in INTEGRATION)

    def _inside(self, tag: str, closing: bool, empty: bool) -> bool:
        if not closing:
            if not empty and tag not in VOID:
                self.within.append(tag)
                self.held[tag] += 1
        elif self.held[tag]:
            while (last := self.within.pop()) != tag:
                self.held[last] -= 1
            self.held[tag] -= 1
        elif tag == self.name:
            self.name = ""
        return True


class Node:
    """A container that is open at some place of a page. What its ancestors say is carried along, so depth costs nothing."""

    __slots__ = ("tag", "key", "parent", "holds_page", "root", "fixed", "bad", "low", "within", "inside", "outside", "labelled")

    def __init__(self, tag: str, key: str, parent: Node | None):
        self.tag, self.key, self.parent = tag, key, parent
        self.holds_page = False  # an article, a menu or the headline of the page stands in it
        self.inside = self.outside = 0


class Token:
    """A tag, or a run of text with the container it stands in."""

    __slots__ = ("tag", "text", "node", "words", "block")

    def __init__(self, tag: str, text: str, node: Node | None, block: int):
        self.tag, self.text, self.node, self.block = tag, text, node, block
        self.words = len(text.split())


def container_key(tag: str, attributes: str) -> str:
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = [" ".join(found[a] for a in own if a in found).lower().replace("#", " ") for own in (("class", "role", "itemprop"), ("id",))]
    hidden = " hidden" if "hidden" in found or found.get("aria-hidden") == "true" else ""
    return " ".join(f"{tag} {names[0]}{hidden}".split()) + (f"{ID} {names[1]}" if names[1] else "")


def pieces(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(tag, closing, attributes, text) of a page in order, in time linear in its length. A raw element is one piece with an empty tag and text.

    A tag whose quotes never end closes at its first >, and quotes count no more from there on; one without any > is text.
    """
    at, end, quotes, low, last = 0, len(page), True, None, page.rfind(">")
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "", False, "", page[at:]
            return
        if lt > at:
            yield "", False, "", page[at:lt]
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        if page[lt + 1 : lt + 2] in ("!", "?") or not (m := NAME.match(page, lt)):
            close = page.find(">", lt) if page[lt + 1 : lt + 2] in ("!", "?") and lt < last else -1
            if close < 0:
                yield "", False, "", "<"
            at = close + 1 if close >= 0 else lt + 1
            continue
        rest = REST.match(page, m.end()) if quotes else None
        if rest:
            close = rest.end() - 1
        else:
            quotes, close = False, page.find(">", m.end())
            if close < 0:
                yield "", False, "", page[lt:]
                return
        tag, at = m[2].lower(), close + 1
        if tag in RAW and not m[1]:
            low = low if low is not None else page.lower() if len(page.lower()) == end else re.sub("[A-Z]", lambda c: c[0].lower(), page)
            stop = low.find(f"</{tag}", at)
            shut = page.find(">", stop) if stop >= 0 else -1
            at = shut + 1 if shut >= 0 else end
            yield "", tag == "title", "", ""
        else:
            yield tag, bool(m[1]), page[m.end() : close], ""


def tokens(page: str) -> tuple[list[Token], list[Node]]:
    """Text is decoded. Blocks are numbered in page order; an inline tag doesn't end one. Nodes come after their parents."""
    out, nodes, block, skipped = [], [], 0, Skipped()
    node: Node | None = None
    opened: Counter[str] = Counter()
    for tag, closing, attributes, text in pieces(page):
        if tag:
            empty = attributes.rstrip().endswith("/")
            if skipped.takes(tag, closing, empty):
                continue
            if tag in CONTAINERS:
                if not closing and not empty:
                    node = Node(tag, container_key(tag, attributes), node)
                    nodes.append(node)
                    opened[tag] += 1
                elif opened[tag]:
                    while node.tag != tag:
                        opened[node.tag] -= 1
                        node = node.parent
                    opened[tag] -= 1
                    node = node.parent
            if tag not in INLINE:
                block += 1
            out.append(Token(f"{'/' if closing else ''}{tag}", " " if tag == "br" else "", node, block))
        elif not text:
            block += closing
        elif not skipped.name:
            out.append(Token("", html.unescape(text), node, block))
    return out, nodes


@lru_cache(1 << 16)
def is_not_name(name: str) -> bool:
    parts = re.split(r"[_-]+", name.strip("_-"))
    nouns = [i for i, p in enumerate(parts) if _NOT.fullmatch(p)]
    return bool(nouns) and all(p in AFTER or p[:1].isdigit() for p in parts[nouns[-1] + 1 :]) and AROUND.isdisjoint(parts[: nouns[-1]])


@lru_cache(1 << 16)
def prior(key: str) -> float:
    tag, _, names = key.partition(" ")
    if tag in NOT_CONTENT or "hidden" in names.split() or any(map(is_not_name, names.split())):
        return -LIMIT
    if tag in CONTENT or (names and _YES.search(names)):
        return LIMIT / 2
    return -1.0 if tag == "header" else 0.5


def tag_of(key: str) -> str:
    return key.partition(" ")[0]


@lru_cache(1 << 16)
def learned_keys(key: str) -> tuple[str, ...]:
    """What a container's weight is learned by, the first that is known: its id without numbers where that says more than its class, then its class
    without numbers, then each name of the class whatever the element. The names of an article or main element change nothing.
    """
    if tag_of(key) in CONTENT:
        return (tag_of(key),)
    classes, _, own = key.partition(ID)
    keys = [key] if own and (" " not in classes or prior(key) != prior(classes)) else []
    keys += [classes] if " " in classes or not own else []
    keys += [f".{c}" for c in classes.split()[1:] if c != "hidden"]
    return tuple(dict.fromkeys(DIGITS.sub("#", k) for k in keys))


def mark_page_parts(own: list[Token]) -> None:
    """Marks what holds an article, a menu or the headline of the page: a form that does is no form to fill in."""
    for t in own:
        if t.tag in CONTENT or (t.tag in ("nav", "h1") and (t.node is None or not t.node.labelled)):
            n = t.node
            while n is not None and not n.holds_page:
                n.holds_page, n = True, n.parent


class Weights:
    def __init__(self, counts: dict[tuple[str, str], tuple[int, int]]):
        """counts: for (what, name), with what `word` or `tag`: how often inside and outside of labelled content."""
        self.words = {k: (np.log((i + 1) / (o + 1)), i + o) for (what, k), (i, o) in counts.items() if what == "word"}
        self.tags = {k: float(np.clip(np.log((i + 1) / (o + 1)) / 4, -1.0, -0.05)) for (what, k), (i, o) in counts.items() if what == "tag"}
        self.known: dict[str, float] = {}

    def container(self, key: str) -> float:
        """A prior for the name that counts as much as PRIOR_WORDS words, moved by what labelled pages show."""
        base = prior(key)
        if tag_of(key) in CONTENT:
            base = max(base, LIMIT / 2)  # whatever it is called
        known = [k for k in learned_keys(key) if k in self.words]
        if not known:
            return base
        learned, n = self.words[known[0]]
        return float(np.clip((base * PRIOR_WORDS + learned * n) / (PRIOR_WORDS + n), -LIMIT, LIMIT))

    def weight(self, key: str) -> float:
        if key not in self.known:
            if len(self.known) > 1 << 16:
                self.known.clear()
            self.known[key] = self.container(key)
        return self.known[key]

    def is_not_content(self, key: str) -> bool:
        """Names and elements that are taken out of an article, unless labelled pages show the contrary."""
        return prior(key) == -LIMIT and self.weight(key) <= -LIMIT / 2

    def place(self, nodes: list[Node]) -> None:
        """Gives each node what it and its ancestors say, in one pass.

        root: the article or main element that the words belong to. An article in a main element counts, but not one in
        a part of it that is no content: that is a comment or a teaser, as is an article in an article.
        bad: how many of the chain are no content. low: the least weight. within: whether the first of the chain that says so is content.
        """
        for n in nodes:
            p = n.parent
            root, fixed, bad, low, within = (p.root, p.fixed, p.bad, p.low, p.within) if p else (None, False, 0, LIMIT, None)
            gone = (n.tag == "form" and n.holds_page) or (n.tag == "footer" and p is not None and p.tag == "blockquote")
            if not gone:
                is_bad = self.is_not_content(n.key)
                if n.tag in CONTENT and not fixed:
                    if root is not None and (root.tag == "article" or bad > root.bad):
                        fixed = True
                    else:
                        root = n
                if within is None and (n.tag in CONTENT or is_bad or prior(n.key) == LIMIT / 2):
                    within = n.tag in CONTENT or not is_bad
                bad, low = bad + is_bad, min(low, self.weight(n.key))
            n.root, n.fixed, n.bad, n.low, n.within = root, fixed, bad, low, within

    def judged(self, n: Node | None, apart: bool) -> tuple[float, bool]:
        """Score of a word, and whether it is taken out in any case.

        apart: the page has an article or main element that stands free, so that others in menus and the like are none.
        """
        if n is None:
            return 0.5, False
        if n.root is None or (apart and is_wrapped(n)):
            if n.bad and n.root is None and n.within:
                return 0.0, True  # it parts nothing
            return n.low, n.bad > 0
        if n.bad > n.root.bad:
            return 0.0, True
        return max(self.weight(n.root.key), 1.0), False  # around an article anything may stand

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.1)


def is_wrapped(n: Node) -> bool:
    """Whether the article or main element is hidden, or stands in a part that is no content."""
    root = n.root
    return root is not None and ("hidden" in root.key.split()[1:] or (root.parent is not None and root.parent.bad > 0))


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run of the highest positive sum; the first of equals; (0, 0) if none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str, weights: Weights) -> str:
    own, nodes = tokens(page)
    label_nodes(nodes)
    mark_page_parts(own)
    weights.place(nodes)
    apart = any(t.tag in CONTENT and t.node is not None and t.node.root is not None and not is_wrapped(t.node) for t in own)
    judged = {id(n): weights.judged(n, apart) for n in (None, *nodes)}
    start, end = best_region([weights.tag(t.tag) if t.tag else t.words * judged[id(t.node)][0] for t in own])
    blocks: dict[int, list[str]] = {}
    for t in own[start:end]:
        if t.text and not judged[id(t.node)][1]:
            blocks.setdefault(t.block, []).append(t.text)
    texts = (WHITE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def label_nodes(nodes: list[Node], labels: frozenset[str] = CONTENT) -> None:
    for n in nodes:
        n.labelled = n.tag in labels or (n.parent is not None and n.parent.labelled)


def label_counts(page: str) -> Counter | None:
    """Words of each container and tags, inside and outside of the page's only article or main element; None if it has no such.

    Words in parts of the article that are no content by name or element say nothing of their containers.
    """
    own, nodes = tokens(page)
    for label in ("article", "main"):
        if sum(t.tag == label for t in own) == 1:
            break
    else:
        return None
    label_nodes(nodes, frozenset([label]))
    found: Counter = Counter()
    for t in own:
        within = t.node is not None and t.node.labelled
        if t.tag:
            found["tag", t.tag, within] += 1
        elif within:
            t.node.inside += t.words
        elif t.node is not None:
            t.node.outside += t.words
    for n in reversed(nodes):  # children first
        for k in learned_keys(n.key):
            for within, words in ((True, n.inside), (False, n.outside)):
                if words:
                    found["word", k, within] += words
        if n.parent is not None:
            if not (n.labelled and prior(n.key) == -LIMIT):
                n.parent.inside += n.inside
            n.parent.outside += n.outside
    return Counter({k: v for k, v in found.items() if not (k[0] == "word" and k[2] and prior_of_learned(k[1]) == -LIMIT)})


@lru_cache(1 << 16)
def prior_of_learned(name: str) -> float:
    return prior(name.replace("#", "1") if not name.startswith(".") else f"div {name[1:]}")


def fit_weights(pages: DataFrame, bound: int = MAX_LABELLED) -> Weights:
    """Counted by Spark over at most `bound` pages; containers are as many as those pages have at most. Of rows that repeat an id the least html counts, once."""
    ids = pages.select("page_id").filter("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(bound)
    sample = stored(pages.select("page_id", "html").join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html")), "html-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for page in texts_of(batch, "html"):
                found.update(label_counts(page) or ())
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())],
            ["what", "name", "within", "n"],
        )

    counted = sample.mapInArrow(count, "what string, name string, within boolean, n long").groupBy("what", "name")
    inside = F.coalesce(F.sum(F.when(F.col("within"), F.col("n"))), F.lit(0))
    rows = counted.agg(inside.alias("inside"), (F.sum("n") - inside).alias("outside")).collect()
    return Weights({(r["what"], r["name"]): (r["inside"], r["outside"]) for r in rows})


def extract_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages; other columns are not read.

    A null or empty page, or one without content, has an empty text. Repeated rows are extracted once each; an
    empty table gives no rows. A very long page is extracted whole, by one task, in time in proportion to its length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in released(batches):
            for part in sliced(batch, "html"):
                texts = [main_text(p, own) if p else "" for p in texts_of(part, "html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit_weights(pages))
