"""Main text of web pages by removing each site's template.

Every element subtree of a page is hashed.  Spark counts, for each host, on how many different
pages a subtree occurs; subtrees that recur across many pages of the host are its template and are
deleted.  Structure (menus, footers, forms, names like ``sidebar``) and the article element bound
the text before that, so a host with a single page is extracted too.

A subtree is a template from ``MIN_PAGES`` different pages and ``MIN_SHARE`` of the host's pages on;
within an article the second bound is ``MIN_SHARE_INSIDE``.  Pages count as different by the hash of
their body, so exact copies of a page count once and do not turn its text into a template.  As every
template covers a fixed share of the pages, their number for a host does not grow with its pages.

Defined results: null or empty html gives an empty text; a null url, or one without a host, counts as
the host ``''``; repeated pages stay; further columns are ignored; pages of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches, table
from casegraph.llm.html_tree import Node, blocks, dropped, hash_subtrees, parse, roots
from casegraph.session import cut_lineage

MIN_PAGES = 8
MIN_SHARE = 0.3
MIN_SHARE_INSIDE = 0.6
#: Parts that the pages of one host are dealt to when templates are joined.
SALTS = 32
#: Up to so many templates in all are broadcast (eight bytes each and a host name).
BROADCAST_TEMPLATES = 20_000


def host_of(url: Column) -> Column:
    """The lower-case host name without user and port."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _candidates(source: str) -> tuple[int, dict[int, bool]]:
    """Hash of the page's body, and its subtrees with text: hash to whether it lies inside an article.

    Only what the structural rules keep can need the template, so only that is counted.
    """
    root = parse(source)
    order = hash_subtrees(root)
    without = dropped(root)
    found: dict[int, bool] = {}
    body = next((n.hash for n in order if n.name == "body"), root.hash)
    tops = {id(n) for n in roots(root, without)}
    open_: list[tuple[Node, bool]] = [(root, False)]
    while open_:
        n, inside = open_.pop()
        if id(n) in without:
            continue
        if inside and n.texts:
            found[_signed(n.hash)] = any(p.name == "article" for p in _above(n))
        inside = inside or id(n) in tops
        open_ += [(p, inside) for p in n.parts if isinstance(p, Node)]
    return _signed(body), found


def _above(node: Node) -> list[Node]:
    out = []
    while node.parent is not None:
        node = node.parent
        out.append(node)
    return out


def subtrees(pages: DataFrame) -> DataFrame:
    """``host, body, tree, inside``: every kept subtree of every page once."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bodies, trees, inside = [], [], [], []
            for i, source in enumerate(batch.column("html").to_pylist()):
                body, found = _candidates(source or "")
                for tree, is_inside in found.items():
                    rows.append(i)
                    bodies.append(body)
                    trees.append(tree)
                    inside.append(is_inside)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("host").take(pa.array(rows, pa.int64())),
                    pa.array(bodies, pa.int64()),
                    pa.array(trees, pa.int64()),
                    pa.array(inside, pa.bool_()),
                ],
                ["host", "body", "tree", "inside"],
            )

    return pages.select("host", "html").mapInArrow(listed, "host string, body long, tree long, inside boolean")


def templates(pages: DataFrame) -> DataFrame:
    """``host, tree`` of the subtrees that recur across many different pages of a host."""
    seen = subtrees(pages).distinct()
    # A page has one body hash, so counting distinct rows counts different pages.
    counted = cut_lineage(
        seen.groupBy("host", "tree")
        .agg(F.count(F.lit(1)).alias("n"), F.min("inside").alias("inside"))
        .where(F.col("n") >= MIN_PAGES)
    )
    totals = (
        pages.select("host", F.xxhash64("html").alias("page")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    )
    share = F.when(F.col("inside"), F.lit(MIN_SHARE_INSIDE)).otherwise(F.lit(MIN_SHARE))
    return counted.join(totals, "host").where(F.col("n") >= share * F.col("pages")).select("host", "tree")


def main_text(source: str, template: set[int]) -> str:
    """The page's text without what structure or the host's template rule out."""
    root = parse(source)
    without = dropped(root)
    if template:
        without |= {id(n) for n in hash_subtrees(root) if _signed(n.hash) in template}
    return "\n".join(blocks(roots(root, without), without))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    bounded_batches(pages.sparkSession)
    kind = pages.schema[page_id].dataType.simpleString()
    base = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host")
    )
    found = cut_lineage(templates(base))
    per_host = found.groupBy("host").agg(F.collect_list("tree").alias("trees"))
    if found.count() <= BROADCAST_TEMPLATES:
        joined = base.join(F.broadcast(per_host), "host", "left")
    else:
        salted = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, ["host", "salt"], "left")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, trees = batch.column("html").to_pylist(), batch.column("trees").to_pylist()
            texts = [main_text(s or "", set(t or ())) for s, t in zip(sources, trees, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.select("page_id", "url", "html", "trees").mapInArrow(
        extracted, f"page_id {kind}, url string, text string, n_chars long"
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
