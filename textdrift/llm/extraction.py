"""Operator 13, HTML extraction by wrapper induction over the pages of a host.

Every page is parsed into blocks of text and a summary tree of its block elements (``dom``). The
reference of a host is the summary tree that most of its pages have. Each page's tree is aligned
with it by simple tree matching, so that matched nodes of all pages share a slot. Slots whose texts
stay the same from page to page, or come from a small stock, are template; varying slots, and nodes
that match no slot, are content. In a page with an ``article`` (else ``main``) element, content is what
varies inside it. Elements that name themselves as furniture (navigation, forms, adverts, comments,
scripts and so on) are never content, whether they vary or not.

Evidence counts by different pages: pages with the same longest block are one, so that copies of a
page don't turn its text into template. A slot on at least ``LEAST_PAGES`` pages is template if it has
at most ``STOCK`` times as many different texts as it has texts on all these pages; a single text is
template, also inside an article, if it is in the slot of more than ``SHARE`` of the pages.

The corpus is parsed three times, for references, for evidence and for texts, and nothing is
collected: references and evidence are aggregates, counted before they are shuffled; a host's wrapper
is broadcast if the host has a thousandth of all pages or more (at most 1,000 hosts), else joined.

Defined results: null and empty pages have an empty text; the white space of a text is what Unicode
calls so; a null or odd url counts as one host; repeated rows are extracted each; a host with few
pages has no template; unclosed and very long or deep pages are parsed to their end; an empty table
gives no rows; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.llm import dom
from textdrift.llm.skew import attach
from textdrift.llm.tables import written

LEAST_PAGES, STOCK, SHARE = 5, 0.5, 0.5
HEAVY_HOST = 1e-3
#: A block outside of articles goes if so much of it is link text.
LINK_SHARE = 0.8
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _number(text: str) -> int:
    """64-bit hash as a signed number."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@lru_cache(maxsize=2048)
def _tree(skeleton: str) -> dom.Tree:
    return dom.Tree(skeleton)


@lru_cache(maxsize=8192)
def _aligned(reference: str, skeleton: str) -> tuple[int, ...]:
    return tuple(dom.align(_tree(reference), _tree(skeleton)))


def slots(page: dom.Page, reference: str) -> list[int]:
    """The slot of every block, -1 where its node matches none."""
    aligned = _aligned(reference, page.skeleton())
    return [aligned[page.order[block.node]] for block in page.blocks]


def main_text(page: dom.Page, reference: str | None, template: set[int], fixed: set[tuple[int, int]]) -> str:
    """The content blocks of a page, given the wrapper of its host: template slots, and fixed texts
    as (slot, hash)."""
    places = slots(page, reference) if reference is not None else [-1] * len(page.blocks)
    for inside in ("article", "main"):
        if any(getattr(block, inside) for block in page.blocks):
            return "\n".join(b.text for b, s in zip(page.blocks, places)
                             if getattr(b, inside) and (s, _number(b.text)) not in fixed)
    return "\n".join(b.text for b, s in zip(page.blocks, places)
                     if s not in template and (s, _number(b.text)) not in fixed
                     and b.links < LINK_SHARE * len(b.text))


def _pages(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[dom.Page]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield part, [dom.parse(x or "") for x in part.column(column).to_pylist()]


def references(pages: DataFrame) -> DataFrame:
    """host, reference (its commonest summary tree) and pages (their number) of ``pages`` (host, html)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, parsed in _pages(batches, 1):
            counts = Counter(zip(part.column(0).to_pylist(), (p.skeleton() for p in parsed)))
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([h for h, _ in counts], pa.string()),
                "hash": pa.array([_number(s) for _, s in counts], pa.int64()),
                "skeleton": pa.array([s for _, s in counts], pa.string()),
                "n": pa.array(list(counts.values()), pa.int64())})

    trees = pages.mapInArrow(task, "host string, hash long, skeleton string, n long").groupBy("host", "hash").agg(
        F.sum("n").alias("n"), F.min("skeleton").alias("skeleton"))
    return trees.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "hash")).alias("reference"),
                                     F.sum("n").alias("pages"))


def evidence(pages: DataFrame) -> DataFrame:
    """host, slot, text and page (hashes): which text the slot has on which different page, of ``pages``
    (host, html, reference)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, parsed in _pages(batches, 1):
            rows = set()
            for host, reference, page in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), parsed):
                if page.blocks:
                    own = _number(max((b.text for b in page.blocks), key=len))
                    rows.update((host, s, _number(b.text), own) for b, s in zip(page.blocks, slots(page, reference))
                                if s >= 0)
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                names=["host", "slot", "text", "page"])

    return pages.mapInArrow(task, "host string, slot int, text long, page long").distinct()


def wrappers(trees: DataFrame, seen: DataFrame) -> DataFrame:
    """``trees`` with the wrapper of each host: ``template`` slots, and ``fixed`` texts of slots."""
    texts = seen.groupBy("host", "slot", "text").agg(F.count("*").alias("n"))
    # a slot's pages are counted apart from its texts, since a page may have several of them
    counts = seen.groupBy("host", "slot", "page").agg(F.lit(1).alias("one")).groupBy("host", "slot").agg(
        F.count("*").alias("pages"))
    kinds = texts.groupBy("host", "slot").agg(F.count("*").alias("texts"), F.sum("n").alias("places"),
                                              F.max("n").alias("most")).join(counts, ["host", "slot"])
    kinds = kinds.where(F.col("pages") >= LEAST_PAGES)
    template = kinds.where(F.col("texts") <= STOCK * F.col("places")).groupBy("host").agg(
        F.collect_list("slot").alias("template"))
    often = kinds.where(F.col("most") > SHARE * F.col("pages")).select("host", "slot", "pages")
    # the first condition follows from the second: it keeps a slot's many rare texts from the join
    fixed = texts.where(F.col("n") > SHARE * LEAST_PAGES).join(often, ["host", "slot"]).where(F.col("n") > SHARE * F.col("pages")).groupBy("host").agg(
        F.collect_list(F.struct("slot", "text")).alias("fixed"))
    return trees.join(template, "host", "left").join(fixed, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    trees = written(references(rows.select("host", "html")), "references")
    total = int(trees.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0])
    heavy = F.col("pages") >= max(1.0, total * HEAVY_HOST)
    seen = written(evidence(attach(rows.select("host", "html"), trees.select("host", "reference", "pages"), ["host"],
                                   heavy).select("host", "html", "reference")), "evidence")
    wrapped = written(wrappers(trees, seen), "wrappers")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, parsed in _pages(batches, 2):
            wrapper = zip(*(part.column(c).to_pylist() for c in (3, 4, 5)))
            texts = [main_text(page, reference, set(template or ()), {(x["slot"], x["text"]) for x in fixed or ()})
                     for page, (reference, template, fixed) in zip(parsed, wrapper)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = attach(rows, wrapped, ["host"], heavy)
    kinds = dict(rows.dtypes)
    return joined.select("page_id", "url", "html", "reference", "template", "fixed").mapInArrow(
        task, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
