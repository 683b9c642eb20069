"""Main text of web pages: the contiguous region of maximum score, words positive and tags negative."""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import short_batches

# Fixed values of the HTML standard: elements without content, elements whose content is not markup, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select body article main section div aside nav td th".split())

# Elements and names that mark what is not the article; names only until labelled pages say otherwise (see PRIORS).
DROPPED = frozenset("head nav aside footer form button select input dialog menu svg canvas object embed audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted
    nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toc header masthead topbar footer
    sidebar aside widget widgets related recommended recommendations trending popular
    cookie cookies consent gdpr notice notices notification alert popup modal overlay toast announcement
    newsletter subscribe subscription signup login search form share sharing social
    comment comments commentlist reply replies respond discussion disqus feedback reactions
    copyright legal disclaimer skip hidden""".split()
)
# Words in names that say where a box is or what it is made of, and words that name the article itself.
LAYOUT = frozenset("area bar block bottom box button buttons card center col column container content group icon inner item items left link links list outer page panel right row section site slot small strip text title top unit user wrap wrapper zone".split())
CONTENT = frozenset("article articles body content entry main post posts story text".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[a-z]+|\d+")
WHITE = re.compile(r"\s+")
LABELLED = re.compile("<(?:article|main)", re.I)
NEUTRAL = LAYOUT | CONTENT

# Votes (for, against) that a word of a class or id starts with; the votes of labelled pages are added to them.
PRIORS = {"boilerplate": (1.0, 4.0), "content": (4.0, 1.0), "layout": (1.0, 1.0), "unknown": (2.7, 1.0)}
#: An element whose names weigh less than this is no part of the article.
NAMES_DROP = -0.7
#: The most features (tags, words of names, depths, link shares) that the learned scores keep, the frequent ones first.
FEATURES = 50_000
DEEPEST = 20
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 article main".split())
DEFAULT_TAGS = {t: -0.2 for t in INLINE | {"p", "br"}} | {"a": -2.0, "li": -2.0, "ul": -3.0, "option": -3.0, "input": -3.0}
DEFAULT_TAG = -1.0
DROPPED_SCORE = -4.0


def name_words(value: str) -> Iterator[list[str]]:
    """The words of each name in a class or id: "adBox main-text2" gives [ad, box] and [main, text]."""
    for name in value.split():
        words = NAME_PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        yield [x for x in words if not x.isdigit() and len(x) > 1]


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of repeated ones holds."""
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


@dataclass
class Scores:
    """What the scan adds up. A tag costs ``tags`` (``other`` if unknown) and what its names weigh below 0; a word gains
    1 / (1 + exp(-x)), x the sum of ``base`` and the log odds of its block's share of link words and depth. ``votes``
    has (for, against) of words of names; each weighs the logarithm of for / against, PRIORS included."""

    tags: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_TAGS))
    other: float = DEFAULT_TAG
    votes: dict[str, tuple[int, int]] = field(default_factory=dict)
    base: float = 4.0
    links: tuple[float, ...] = (0.0, -1.0, -4.0, -7.0)
    depths: dict[int, float] = field(default_factory=dict)
    known: dict[tuple[str, str, bool], tuple[bool, float]] = field(default_factory=dict, repr=False)

    def name_word(self, word: str) -> float:
        prior = PRIORS["boilerplate" if word in NAMES else "content" if word in CONTENT else "layout" if word in LAYOUT else "unknown"]
        got = self.votes.get(word, (0, 0))
        return math.log((prior[0] + got[0]) / (prior[1] + got[1]))

    def names(self, value: str) -> float:
        """The weight of a class or id. Beside a word that weighs below 0 in one name, words of layout and of content
        add nothing: "comment-text" is of a comment, while "legal-news" is news. A name of words that neither the
        lists nor labelled pages know adds nothing either: "clearfix sidebar" is a sidebar."""
        start = math.log(PRIORS["unknown"][0])
        total = 0.0
        for words in name_words(value):
            weights = [(self.name_word(w), w) for w in words]
            against = any(x < 0 for x, _ in weights)
            if against:
                total += sum(x for x, w in weights if x < 0 or w not in NEUTRAL)
            else:
                total += sum(x if w in NEUTRAL or w in NAMES else max(0.0, x - start) for x, w in weights)
        return total

    def element(self, tag: str, attributes: str, inside_article: bool) -> tuple[bool, float]:
        """(whether an element is no part of the article by kind, role, being hidden or its names, what its names add to
        the tag's cost). Forms are looked at by the page, see `Page.dropped`."""
        key = tag, attributes, inside_article
        if key not in self.known:
            if len(self.known) >= 4096:
                self.known.clear()
            self.known[key] = self._element(*key)
        return self.known[key]

    def _element(self, tag: str, attributes: str, inside_article: bool) -> tuple[bool, float]:
        if (tag in DROPPED and tag != "form") or (tag == "header" and not inside_article):
            return True, 0.0
        if not attributes or tag in ("html", "body"):
            return False, 0.0
        a = attributes_of(attributes)
        style = a.get("style", "").lower()
        if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style):
            return True, 0.0
        names = " ".join(a[k] for k in ("class", "id") if k in a)
        weight = self.names(names) if names else 0.0
        may = tag not in ("article", "main") or "comment" in names.lower()
        return may and weight < NAMES_DROP, max(-3.0, min(0.0, weight))

    def word(self, links: int, depth: int) -> float:
        x = self.base + self.links[links] + self.depths.get(depth, 0.0)
        return max(0.02, 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))


class Page:
    """A page as its tags and runs of text in order, and its elements, numbered as they open: an element's descendants
    are the numbers from its own up to ``last``."""

    def __init__(self, page: str):
        self.parent, self.tag, self.attributes = [-1], [""], [""]
        self.events: list[tuple[str, str | None, int, bool]] = []  # tag or '', text, element, whether it opens there
        self._parse(page)
        n = len(self.parent)
        self.n_words = [0] * n
        for tag, text, node, _ in self.events:
            if not tag:
                self.n_words[node] += len(text.split())
        self.last = list(range(n))
        self.all_words, self.link_words = list(self.n_words), [0] * n
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            self.last[up] = max(self.last[up], self.last[i])
            self.all_words[up] += self.all_words[i]
            self.link_words[up] += self.all_words[i] if self.tag[i] == "a" else self.link_words[i]
        self.block, self.depth, self.inside = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            up, inline = self.parent[i], self.tag[i] in INLINE
            self.block[i] = self.block[up] if inline else i
            self.depth[i] = self.depth[up] if inline else min(DEEPEST, self.depth[up] + 1)
            self.inside[i] = self.inside[up] or self.tag[i] in ("article", "main")

    def links(self, node: int) -> int:
        """The share of link words in an element's block, in quarters: 0 to 3."""
        at = self.block[node]
        return min(3, 4 * self.link_words[at] // max(1, self.all_words[at]))

    def dropped(self, scores: Scores) -> tuple[list[bool], list[float]]:
        """(whether each element is no part of the article, what its names add to the cost of its tag).

        A form is dropped, unless it holds paragraphs or headings and over half of the words that are not dropped
        otherwise: some frameworks put a whole page into one form."""
        n = len(self.parent)
        out, cost = [False] * n, [0.0] * n
        for i in range(1, n):
            drop, cost[i] = scores.element(self.tag[i], self.attributes[i], self.inside[self.parent[i]])
            out[i] = drop or out[self.parent[i]]
        if "form" in self.tag:
            live, blocks = [0 if o else w for o, w in zip(out, self.n_words, strict=True)], [int(t in TEXT_BLOCKS) for t in self.tag]
            for i in range(n - 1, 0, -1):
                live[self.parent[i]] += live[i]
                blocks[self.parent[i]] += blocks[i]
            for i in range(1, n):
                out[i] = out[i] or out[self.parent[i]] or (self.tag[i] == "form" and not (blocks[i] and 2 * live[i] > live[0]))
        return out, cost

    def _parse(self, page: str) -> None:
        stack = [("", 0)]
        open_tags: Counter = Counter()  # of the stack, so that it is searched only for what is there
        add, at, n = self.events.append, 0, len(page)

        def close_from(depth: int) -> None:
            open_tags.subtract(s[0] for s in stack[depth:])
            del stack[depth:]

        while at <= n:
            m = TAG.search(page, at)
            text = page[at : m.start() if m else n]
            if text:
                add(("", text, stack[-1][1], False))
            if not m:
                return
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                if open_tags[tag] > 0:
                    close_from(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag))
                add((tag, None, stack[-1][1], False))
                continue
            if tag in CLOSES_P or tag in SAME:
                ends = SAME.get(tag, {"p"})
                for depth in range(len(stack) - 1, 0, -1) if any(open_tags[e] > 0 for e in ends) else ():
                    if stack[depth][0] in ends:
                        close_from(depth)
                        break
                    if stack[depth][0] in SCOPE or (tag in CLOSES_P and stack[depth][0] not in INLINE):
                        break
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                add((tag, None, stack[-1][1], False))
                at = end.end() if end else n
                if not end:
                    return
                continue
            if tag in VOID or attributes.rstrip().endswith("/") and tag not in CLOSES_P and tag not in INLINE:
                add((tag, None, stack[-1][1], False))
                continue
            node = len(self.parent)
            self.parent.append(stack[-1][1])
            self.tag.append(tag)
            self.attributes.append(attributes)
            add((tag, None, node, True))
            stack.append((tag, node))
            open_tags[tag] += 1


def best_region(scores: Sequence[float], may_end: Sequence[bool]) -> tuple[int, int] | None:
    """(first, last) of the contiguous run of maximum sum above 0 that ends where it may, by one scan; the earliest that
    ends first of equals. None if no run is above 0."""
    best, run, start, region = 0.0, 0.0, 0, None
    for i, score in enumerate(scores):
        run += score
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best and may_end[i]:
            best, region = run, (start, i)
    return region


def page_counts(page: str) -> Counter:
    """{(kind, value, inside)}: what a page that labels its own article (one article or main element) says of features.

    ``tag`` counts tags, ``links`` and ``depth`` words. ``name`` is one vote for each word of classes and ids: inside if
    an element of that name lies in the article or around it, else outside. For a word of boilerplate such an element
    has to hold half of the article's words, as adverts stand in articles, too."""
    p = Page(page)
    marks = [i for i in range(1, len(p.parent)) if p.tag[i] in ("article", "main") and not p.inside[p.parent[i]]]
    counts: Counter = Counter()
    if len(marks) != 1:
        return counts
    mark, end = marks[0], p.last[marks[0]]
    for tag, text, node, _ in p.events:
        inside = mark <= node <= end
        if tag:
            counts["tag", tag if len(tag) <= 20 else "other", inside] += 1
        elif words := len(text.split()):
            counts["links", str(p.links(node)), inside] += words
            counts["depth", str(p.depth[node]), inside] += words
    votes: dict[str, bool] = {}
    for i, raw in enumerate(p.attributes):
        if raw and p.tag[i] not in ("html", "body"):
            a = attributes_of(raw)
            held = p.all_words[mark] if i <= mark <= p.last[i] else p.all_words[i] if mark < i <= end else 0
            for word in {w for k in ("class", "id") for words in name_words(a.get(k, "")) for w in words if len(w) <= 30}:
                votes[word] = votes.get(word, False) or (2 * held >= p.all_words[mark] > 0 if word in NAMES else held > 0)
    counts.update(("name", word, inside) for word, inside in votes.items())
    return counts


def extract(page: str | None, scores: Scores | None = None) -> str:
    """The main text of a page, '' for null or where no run of words and tags scores above zero."""
    if not page:
        return ""
    scores = scores or Scores()
    p = Page(page)
    dropped, cost = p.dropped(scores)
    gains: list[float] = []
    for tag, text, node, opens in p.events:
        if tag:
            gains.append(DROPPED_SCORE if dropped[node] else scores.tags.get(tag, scores.other) + (cost[node] if opens else 0.0))
        else:
            words = 0 if dropped[node] else len(text.split())
            gains.append(words * scores.word(p.links(node), p.depth[node]) if words else 0.0)
    region = best_region(gains, [not e[0] and not dropped[e[2]] for e in p.events])
    if region is None:
        return ""
    inside = [e[2] for e in p.events[region[0] : region[1] + 1] if not e[0] and not dropped[e[2]] and not e[1].isspace()]
    low, high, common, node = min(inside), max(inside), [], inside[0]
    while node >= 0:
        if node <= low and high <= p.last[node]:
            common.append(node)
        node = p.parent[node]
    keeper = next((x for x in common if p.tag[x] in ("article", "main")), None)
    own = next((x for x in common if p.tag[x] not in INLINE and p.tag[x] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li")), 0)
    whole = keeper if keeper is not None else own if p.tag[own] not in ("body", "html", "") else None
    seen = p.events[region[0] : region[1] + 1] if whole is None else [e for e in p.events if whole <= e[2] <= p.last[whole]]
    blocks, held = [], []

    def close() -> None:
        line = WHITE.sub(" ", html_lib.unescape("".join(held))).strip()
        if line:
            blocks.append(line)
        held.clear()

    for tag, text, node, _ in seen:
        if text is not None:
            held.append(" " if dropped[node] else text)
        elif tag == "br":
            held.append(" ")
        elif tag not in INLINE:
            close()
    close()
    return "\n".join(blocks)


def learned_scores(pages: DataFrame, html_col: str = "html") -> Scores:
    """Scores from every page that labels its own article. The rarer a tag is inside it, the more it costs; words gain by
    the odds of their block's link share and depth, names weigh by votes of pages (see `page_counts`).

    What comes to the driver is one row for each of at most FEATURES features. Without labelled pages the defaults hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column(0):
                if (text := page.as_py()) and LABELLED.search(text):
                    total.update(page_counts(text))
            if len(total) > FEATURES:
                yield rows(total)
                total = Counter()
        yield rows(total)

    def rows(total: Counter) -> pa.RecordBatch:
        kinds, values, sides = zip(*total, strict=True) if total else ((), (), ())
        return pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "value": pa.array(values, pa.string()), "inside": pa.array(sides, pa.bool_()), "n": pa.array(list(total.values()), pa.int64())})

    counts = pages.select(F.col(html_col).cast("string")).mapInArrow(count, "kind string, value string, inside boolean, n long")
    counts = counts.groupBy("kind", "value").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum("n").alias("n"))
    found: dict[str, dict[str, tuple[int, int]]] = {"tag": {}, "name": {}, "links": {}, "depth": {}}
    for r in counts.orderBy(F.desc("n"), "kind", "value").limit(FEATURES).collect():
        found[r["kind"]][r["value"]] = r["i"], r["n"] - r["i"]
    if not found["tag"]:
        return Scores()
    tags = {t: round(-0.1 - 3.0 * (1 - (i + 1) / (i + o + 2)), 3) for t, (i, o) in found["tag"].items()} | {"br": -0.1}
    base = math.log((1 + sum(i for i, _ in found["links"].values())) / (1 + sum(o for _, o in found["links"].values())))
    odds = lambda kind, value: math.log((1 + found[kind][value][0]) / (1 + found[kind][value][1])) - base if value in found[kind] else 0.0
    return Scores(tags, DEFAULT_TAG, found["name"], base, tuple(odds("links", str(k)) for k in range(4)), {int(d): odds("depth", d) for d in found["depth"]})


def main_text(pages: DataFrame, html_col: str = "html", scores: Scores | None = None) -> DataFrame:
    """Add ``text`` to ``pages``: the article of each page's whole html.

    A page is a sequence of words (positive) and tags (negative); one linear scan keeps the best-scoring contiguous
    region. What tags cost, what words gain by the share of links and the depth of their block, and what the words of
    classes and ids weigh is learned from pages that label their article. The region grows to the element that holds
    all of it, so that a closing one-word paragraph stays. Elements that are boilerplate by kind, role, being hidden or
    the weight of their names give no words.
    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line end.
    Null, empty or wordless html gives ''. Repeated rows give repeated results; a column named ``text`` is replaced.
    A page's time grows with its length alone, whatever its nesting."""
    short_batches(pages.sparkSession)
    scores = scores or learned_scores(pages, html_col)
    kept = [c for c in pages.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py(), scores) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    given = pages.select(*kept, F.col(html_col).cast("string").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{schema}, text string" if schema else "text string")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty html give an empty text, repeated rows repeated results."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = main_text(pages, "html", learned_scores(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
