"""HTML extraction by a maximum-scoring subsequence.

A page is read as a sequence of tokens: words score positive and tags negative, with weights from labelled pages; one
linear scan finds the contiguous region with the largest sum, and its blocks are the text. Words of links score negative in
lists and bare containers, where menus are made of them, and by what the labelled pages show in paragraphs and headings. The
tags that mark content, ``article`` and ``main``, stand at its edges and never within it, so a region seldom pays for crossing one.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are known by their element or
role, or by a class or id all of whose words say so (``cookie-notice``, ``site-header``; not ``share-price``); a block that
stands in them scores as one tag does, and is not written where the region holds it.

Weights are log odds of a token inside against outside the content of labelled pages, pages that mark their content with
an ``article`` element, in units of a word's, within the bounds of ``BOUNDS``. They are fitted on at most ``fit_pages`` of those, by seeded order;
all pages are extracted.

Defined cases: null html is empty and gives an empty text; pages of any length and depth of nesting are read whole, in linear
time and memory; unclosed and cut-off markup is read as far as it goes; among equally good regions the first is taken, and of several
articles the one that scores best; every input row
gives one output row; an empty table gives an empty table; other columns, whatever their names, are ignored.
"""
import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm._spark import Scratch, spread, text_slices

#: Comments, declarations and tags. Quotation marks matter right behind an equals sign only; elsewhere, as in ``title=it's``, they are characters.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^=>]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)*+(?:>|\Z)", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
HINT = re.compile(r"\s(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed"}
RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "button", "select", "iframe", "svg", "head", "textarea", "dialog", "menu", "object", "audio", "video", "canvas"}
SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}
SKIP_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments disqus reply replies respond footer header masthead topbar toolbar related recommended share sharing social newsletter subscribe signup login search widget widgets skip".split())
#: Words that say nothing beside those.
FILLERS = set("area bar block bottom box btn button buttons column container content form global inner item items left link links list main message page panel posts primary right row secondary section side site slot top trail user users wrap wrapper".split())
CONTAINERS = {"html", "body", "main", "article", "section", "div", "header", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "ul", "ol", "dl", "blockquote", "figure", "details", "center", "fieldset", "hgroup", "address"} | SKIP
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "dd", "dt", "figcaption", "caption", "summary", "blockquote"}
BLOCKS = CONTAINERS | PARAGRAPHS | {"li", "hr", "legend", "option"}
EDGES = {"article", "main"}
#: Tags within a line, and elements that show nothing where they stand.
INLINE = {"a", "abbr", "b", "br", "cite", "code", "em", "font", "i", "img", "kbd", "mark", "q", "s", "script", "small", "span", "strong", "style", "sub", "sup", "time", "u", "wbr"}
#: The range of each weight, in units of a word's: of words of links, of those in paragraphs, of tags, of tags within a line, and of
#: those at content's edges.
BOUNDS = {"link": (-2.0, -0.2), "plink": (-0.5, 1.0), "tag": (-0.6, -0.05), "inline": (-0.1, -0.01), "edge": (-400.0, -200.0)}
#: Until pages are labelled.
DEFAULT = {"word": 1.0, "link": -1.0, "plink": 0.5, "tag": -0.3, **{f"<{t}>": -0.05 for t in PARAGRAPHS | INLINE}, **{f"<{t}>": -200.0 for t in EDGES}}


def _range(kind: str) -> tuple[float, float]:
    name = kind[1:-1] if kind.startswith("<") else ""
    return BOUNDS["edge" if name in EDGES else "inline" if name in INLINE else kind if kind in BOUNDS else "tag"]


def _skipped(name: str, tag: str, in_article: bool) -> bool:
    if name in SKIP or name == "header" and not in_article:
        return True
    if name in ("html", "body", *EDGES) or " " not in tag:
        return False
    for m in HINT.finditer(tag):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.lower() in SKIP_ROLES:
                return True
        else:
            for one in value.split():
                words = set(re.split(r"[-_]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", one).lower())) - {""}
                if words & SKIP_WORDS and all(w in SKIP_WORDS or w in FILLERS or w.isdigit() for w in words):
                    return True
    return False


class Page:
    """blocks: (text, number of words, of link words, of those in a paragraph, tags before it, skipped). One pass over the source."""

    def __init__(self, source: str):
        self.blocks: list = []
        self.tags: list = []
        stack: list = []  # (name, skips) of open containers
        open_: Counter = Counter()  # their names
        parts: list = []
        skipping = depth_a = link_words = 0
        paragraph = False
        at, n = 0, len(source)

        def flush():
            nonlocal parts, link_words
            text = html.unescape("".join(parts))
            words = text.split()
            if words:
                links = min(link_words, len(words))
                self.blocks.append((" ".join(words), len(words), links, links if paragraph else 0, self.tags, skipping > 0))
                self.tags = []
            parts, link_words = [], 0

        def text(piece):
            nonlocal link_words
            if piece:
                parts.append(piece)
                if depth_a:
                    link_words += len(piece.split())

        while at < n:
            m = TOKEN.search(source, at)
            if not m:
                # A cut-off tag at the very end was matched by \Z; what is left is text.
                text(source[at:])
                break
            text(source[at : m.start()])
            tag, at = m[0], m.end()
            if tag[1] in "!?":
                continue
            name = NAME.match(tag)[1].lower()
            closing = tag[1] == "/"
            if name in BLOCKS:
                flush()
                paragraph = not closing and name in PARAGRAPHS
            elif name == "br":
                parts.append("\n")
            if not skipping:
                self.tags.append(name)
            if closing:
                if name == "a":
                    depth_a = 0
                if open_[name]:
                    while True:
                        last, skips = stack.pop()
                        skipping -= skips
                        open_[last] -= 1
                        if last == name:
                            break
                continue
            if name == "a":
                depth_a = 1
            elif name in RAW:
                end = RAW_END[name].search(source, at)
                at = end.start() if end else n
                continue
            if name in CONTAINERS and name not in VOID and not tag.endswith("/>"):
                skips = _skipped(name, tag, any(open_[e] for e in EDGES))
                stack.append((name, skips))
                skipping += skips
                open_[name] += 1
        flush()


def block_score(block: tuple, weights: dict) -> float:
    _, words, links, plinks, _, skipped = block
    if skipped:
        return weights["tag"]
    return (words - links) * weights["word"] + (links - plinks) * weights["link"] + plinks * weights["plink"]


def tag_score(tag: str, weights: dict) -> float:
    return weights.get(f"<{tag}>", weights["tag"])


def region(page: Page, weights: dict) -> tuple[int, int]:
    """First and one past last block of the largest sum, tags between its blocks included; (0, 0) where no sum is positive."""
    best = total = 0.0
    begin = first = last = 0
    for i, block in enumerate(page.blocks):
        for t in block[4]:
            total += tag_score(t, weights)
            if total <= 0:
                total, begin = 0.0, i
        total += block_score(block, weights)
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, first, last = total, begin, i + 1
    return first, last


def extract(source: str, weights: dict = DEFAULT) -> str:
    page = Page(source)
    first, last = region(page, weights)
    return "\n".join(b[0] for b in page.blocks[first:last] if not b[5])


def _counts(source: str) -> dict:
    """Tokens inside and outside the first article element, as (kind, inside): number. Its own tags stand outside."""
    low = source.lower()
    a = source.find(">", low.find("<article")) + 1
    b = low.find("</article", a)
    out: Counter = Counter()
    for inside, piece in ((1, source[a:b]), (0, source[:a]), (0, source[b:])):
        page = Page(piece)
        for _, words, links, plinks, tags, _ in page.blocks:
            out["word", inside] += words - links
            out["link", inside] += links - plinks
            out["plink", inside] += plinks
            for t in tags:
                out["tag", inside] += 1
                out[f"<{t}>", inside] += 1
        for t in page.tags:  # after the last block
            out["tag", inside] += 1
            out[f"<{t}>", inside] += 1
    return out


def fit_weights(pages: DataFrame, fit_pages: int = 2000, seed: int = 5) -> dict:
    """Log odds of tokens inside against outside, from at most ``fit_pages`` labelled pages; DEFAULT where there are none."""
    Scratch(pages.sparkSession)
    place = F.xxhash64(F.lit(seed), "page_id", "html").alias("place")
    labelled = pages.select(place, F.col("html").cast("string").alias("html")).where("html ilike '%<article%' and html ilike '%</article%'")
    # Only hashes are sorted; their cut-off selects the pages, which stay where they are.
    last = labelled.select("place").orderBy("place").limit(fit_pages).agg(F.max("place")).first()[0]
    if last is None:
        return dict(DEFAULT)
    sample = labelled.where(F.col("place") <= last).select("html").limit(fit_pages)

    def run(batches):
        total: dict = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for k, n in _counts(t).items():
                    total[k] = total.get(k, 0) + n
        rows = [(k, i, n) for (k, i), n in total.items() if not k.startswith("<") or k[1:-1] in BLOCKS | VOID | EDGES | INLINE]
        yield pa.RecordBatch.from_pylist([{"kind": k, "inside": i, "n": n} for k, i, n in rows], pa.schema([("kind", pa.string()), ("inside", pa.int32()), ("n", pa.int64())]))

    found = sample.mapInArrow(run, "kind string, inside int, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    n = {(r.kind, r.inside): r.n for r in found}
    sides = [sum(v for (k, i), v in n.items() if i == side and not k.startswith("<")) + 1 for side in (0, 1)]
    odds = lambda k: math.log((n.get((k, 1), 0) + 1) / sides[1]) - math.log((n.get((k, 0), 0) + 1) / sides[0])
    unit = max(odds("word"), 0.1)
    weights = {}
    for k in {k for k, _ in n} - {"word"} | set(DEFAULT):
        low, high = _range(k)
        seen = n.get((k, 0), 0) + n.get((k, 1), 0)
        weights[k] = min(max(odds(k) / unit, low), high) if seen >= 50 else DEFAULT.get(k, DEFAULT["tag"])
    return weights | {"word": 1.0}


def extract_pages(pages: DataFrame, weights: dict) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    Scratch(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for rows, _, _ in text_slices(batch, "html"):
                out = [extract(t or "", weights) for t in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return spread(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_pages(pages, fit_weights(pages))
