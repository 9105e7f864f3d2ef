r"""Main text of web pages by the best-scoring contiguous run of tokens.

A page is a sequence of words and tags.  Words score by where they stand (the
elements around them and hints in their class and id), tags score a little
below zero; the run of tokens with the greatest total, found in one pass, is
the content region.  Weights are log odds learned from labelled pages: a fixed
set of small examples that this module carries, and a bounded sample of the
given pages whose own markup says which part is the article (`<article>` or
`<main>`); those two elements are the label and never a feature.

Words in elements that never hold an article (menus, forms, footers) are barred,
but not by a form that wraps the page's structure, nor by an element that is
never closed and holds most of the page's words; `head` ends where an element
begins that cannot stand in it.

In the region, blocks that score below zero (a menu or notice inside the
article) are left out.  Character references are decoded, white space inside a
block becomes one space, and blocks are joined by an empty line.  Nothing is
cut off: the whole page is read and the whole region returned.

Null and empty pages, and pages without words, give the empty text.  A page is
judged alone, so repeated rows and ties give equal results; of runs with equal
scores the first and longest is taken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES = 400
TAG_SCORE = -0.02
MOST = 4.0
#: No word scores less, so that a long notice inside an article does not cut it in two.
LEAST = -1.0

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|textarea|iframe)\b(?:[^>"']++|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<more2>[^>]*)>""",
    re.DOTALL | re.IGNORECASE,
)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_SPACE = re.compile(r"[\x20\x09-\x0D\xA0]+")

#: Elements that end a block of text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that stand for the words in them until they are closed.
HOLDERS = frozenset("article aside body button dialog div dl fieldset figure footer form head header main menu nav ol section select table title ul".split())
LABEL = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose words never belong to an article.
NEVER = frozenset("nav footer form aside menu select button dialog head title".split())

#: Elements that may stand in `head`, and those that show a form around them to wrap the page.
HEAD = frozenset("head title meta link base script style noscript template html".split())
STRUCTURE = frozenset("article main nav header footer h1".split())

#: (markup, is it content?) of labelled examples; each part is a page's piece at top level.
EXAMPLES = (
    ("<title>Site name</title>", 0),
    ("<header><p>Site name and slogan</p></header>", 0),
    ("<nav><ul><li><a href=x>Home</a></li><li><a href=x>News</a></li></ul></nav>", 0),
    ('<ul class="menu"><li><a href=x>Start</a></li><li><a href=x>About</a></li></ul>', 0),
    ('<div id="breadcrumb breadcrumbs"><a href=x>Home</a> &gt; <a href=x>News</a></div>', 0),
    ('<div class="ad ads advert advertisement sponsored promo banner"><p>Buy one and get one free</p></div>', 0),
    ('<div class="cookie consent notice popup modal"><p>We use cookies on this site</p><button>Accept</button></div>', 0),
    ('<div class="sidebar related widget trending popular"><p>Most read this week</p><ul><li><a href=x>Other story</a></li></ul></div>', 0),
    ('<div class="share social"><a href=x>Share</a> <a href=x>Tweet</a></div>', 0),
    ('<div id="comments comment disqus replies"><h3>Comments</h3><p>I liked this a lot</p></div>', 0),
    ('<div class="newsletter subscribe signup login"><form>Mail address <button>Send</button></form></div>', 0),
    ("<aside><p>Read also what others wrote</p></aside>", 0),
    ("<form>Search this site</form>", 0),
    ('<footer class="footer copyright"><p>All rights reserved</p></footer>', 0),
    ("<h1>A headline for the story</h1><p>The first paragraph tells what took place, and where.</p><p>The second one goes on at some length, as they do.</p>", 1),
    ("<h2>A further heading</h2><p>More text follows it here.</p><blockquote>And somebody is quoted.</blockquote><ul><li>A point of some length</li><li>Another one</li></ul>", 1),
    ("<pre>code of an example</pre><table><tr><td>a cell of text</td></tr></table><h3>One more</h3><p>Last words.</p>", 1),
    ("<div>Text that stands in a plain element, without a paragraph of its own.</div>", 1),
    ("Text that stands in the page itself, without any element around it.", 1),
)


class Page:
    """Words of a page in order: text, block number, features; tags stand between them as their number."""

    def __init__(self, html: str) -> None:
        self.words: list[str] = []
        self.block: list[int] = []
        self.context: list[int] = []
        self.tags_before: list[int] = []
        self.inside: list[bool] = []
        self.contexts: list[tuple[str, ...]] = []
        self.barred: list[bool] = []
        known: dict[tuple, int] = {}
        stack: list[tuple[str, tuple[str, ...], int]] = []
        #: Barred elements: how many words each holds, whether it was closed, and whether it wraps the page.
        held, closed, wraps = [0], [True], [False]
        entries: list[tuple[str, bool, tuple[tuple[str, tuple[str, ...], int], ...]]] = []
        block, leaf, links, tags, at, label = 0, "", 0, 0, 0, 0
        glue = False  # the last word may go on after an inline tag

        def text(piece: str) -> None:
            nonlocal glue, tags
            if not piece:
                return
            piece = unescape(piece)
            parts = _SPACE.split(piece)
            key = (leaf, links > 0, tuple((x, i) for _, x, i in stack))
            n = known.get(key)
            if n is None:
                n = known[key] = len(entries)
                entries.append((leaf, links > 0, tuple(stack)))
            for i, w in enumerate(parts):
                if not w:
                    continue
                if i == 0 and glue and self.words and self.block[-1] == block:
                    self.words[-1] += w
                    continue
                self.words.append(w)
                self.block.append(block)
                self.context.append(n)
                self.tags_before.append(tags)
                self.inside.append(label > 0)
                tags = 0
            glue = bool(parts[-1])

        for m in _TOKEN.finditer(html):
            text(html[at : m.start()])
            at = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            tags += 1
            closing = bool(m["close"] or m["close2"])
            if tag == "br":
                glue = False
            elif tag == "a":
                links = 0 if closing else 1
            if not closing and tag not in HEAD and any(t == "head" for t, _, _ in stack):
                while stack.pop()[0] != "head":
                    pass
            if not closing and tag in STRUCTURE:
                for t, _, number in stack:
                    wraps[number] = wraps[number] or t == "form"
            if tag in BLOCKS:
                block, glue, links = block + 1, False, 0
                leaf = "" if closing else tag
            if tag in HOLDERS:
                if not closing:
                    hints = [f"in:{tag}"] if tag not in LABEL and tag not in ("body", "div", "section") else []
                    for h in _HINT.finditer(m["more"] or m["more2"] or ""):
                        hints += [f"hint:{x}" for x in re.split(r"[^a-z]+", (h[1] or h[2] or h[3] or "").lower()) if x]
                    number = 0
                    if tag in NEVER:
                        number = len(held)
                        held.append(0)
                        closed.append(False)
                        wraps.append(False)
                    stack.append((tag, tuple(hints), number))
                    label += tag in LABEL
                elif any(t == tag for t, _, _ in stack):
                    while True:
                        gone, _, number = stack.pop()
                        label -= gone in LABEL
                        if gone == tag:
                            closed[number] = True
                            break
        text(html[at:])
        for c in self.context:
            for _, _, number in entries[c][2]:
                held[number] += 1
        free = [wraps[i] or (not closed[i] and 2 * held[i] > len(self.words)) for i in range(len(held))]
        free[0] = False
        for leaf_, linked, around in entries:
            hints_ = tuple(dict.fromkeys(f for _, x, i in around if not free[i] for f in x))
            self.contexts.append((f"leaf:{leaf_}", *(("link",) if linked else ()), *hints_))
            self.barred.append(any(t in NEVER and not free[i] for t, _, i in around))


Weights = dict[str, float]


def page_counts(html: str) -> tuple[Counter, Counter]:
    """Features elsewhere, and in content; each page has one vote for each side, whatever its length."""
    page = Page(html)
    share: tuple[Counter, Counter] = Counter(), Counter()
    for c, inside in zip(page.context, page.inside, strict=True):
        share[inside][c] += 1
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for side in (0, 1):
        n = sum(share[side].values())
        for c, k in share[side].items():
            for f in page.contexts[c]:
                counts[side][f] += 10 * k / n
    return counts


def weights_of(counts: tuple[Counter, Counter]) -> Weights:
    """Log odds of each feature in content against elsewhere, from the examples and counts of pages."""
    counts = Counter(counts[0]), Counter(counts[1])
    for markup, content in EXAMPLES:
        page = Page(markup)
        for c in page.context:
            for f in page.contexts[c]:
                counts[content][f] += 10
    features = set(counts[0]) | set(counts[1])
    total = [sum(c.values()) + len(features) for c in counts]
    return {f: max(-MOST, min(MOST, log((counts[1][f] + 1) / total[1]) - log((counts[0][f] + 1) / total[0]))) for f in features}


def learn(pages: list[str]) -> Weights:
    """Weights from the examples and from pages that say what their article is."""
    every: tuple[Counter, Counter] = Counter(), Counter()
    for html in pages:
        for side, counts in enumerate(page_counts(html)):
            every[side].update(counts)
    return weights_of(every)


def best_run(score: list[float], tags: list[int]) -> tuple[int, int]:
    """The run of words with the greatest sum of scores, tags between them counted, in one pass; the first and longest."""
    best, total, start, run = 0.0, 0.0, 0, (0, 0)
    for i, (x, n) in enumerate(zip(score, tags, strict=True)):
        if total > 0:
            total += TAG_SCORE * n
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best or (total == best and start == run[0]):
            best, run = max(best, total), (start, i + 1)
    return run


def extract(html: str | None, weights: Weights) -> str:
    """The text of the best-scoring run of the page."""
    page = Page(html or "")
    if not page.words:
        return ""
    score = [LEAST if barred else max(LEAST, min(MOST, sum(weights.get(f, 0.0) for f in c))) for c, barred in zip(page.contexts, page.barred, strict=True)]
    run = best_run([score[c] for c in page.context], page.tags_before)
    out: dict[int, list[str]] = {}
    value: Counter = Counter()
    for i in range(*run):
        out.setdefault(page.block[i], []).append(page.words[i])
        value[page.block[i]] += score[page.context[i]]
    return "\n\n".join(" ".join(w) for b, w in out.items() if value[b] >= 0)


def learn_from(pages: DataFrame, html: str = "html", key: str = "page_id", train_pages: int = TRAIN_PAGES) -> Weights:
    """Weights from at most `train_pages` pages that mark their article, those with the smallest hash."""
    mark = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))
    marked = pages.where(F.col(html).rlike("(?i)<(article|main)[ >]")).select(mark.alias("h"), F.xxhash64(html).alias("g"), F.col(html).alias("html"))
    # Hashes are ranked first, so that only the chosen pages leave their tasks.
    chosen = marked.select("h", "g").orderBy("h", "g").limit(train_pages)
    rows = marked.join(F.broadcast(chosen.distinct()), ["h", "g"], "left_semi").dropDuplicates(["h", "g"]).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column(0).to_pylist():
                found = [(side, f, float(n)) for side, counts in enumerate(page_counts(html)) for f, n in counts.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.string(), pa.float64()))], names=["side", "feature", "n"])

    # Pages are counted where they are; features of at most `train_pages` pages come to the driver.
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for r in rows.mapInArrow(count, "side int, feature string, n double").groupBy("side", "feature").agg(F.sum("n").alias("n")).collect():
        counts[r["side"]][r["feature"]] = r["n"]
    return weights_of(counts)


def main_text(pages: DataFrame, weights: Weights, html: str = "html", text: str = "text") -> DataFrame:
    """All columns but the page itself, and the text of its article."""
    held = pages.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in pages.columns if c not in (html, text)]
    rows = pages.select(*kept, html)
    out = rows.select(*kept, F.lit("").alias(text)).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), held.value) for x in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, text])

    return rows.mapInArrow(apply, out)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, learn_from(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
