"""Chains of response pages: following ``next_url`` by list ranking.

A response page names the page that continues it.  The reference follows
the links one request after the other; here all landed pages are ordered
at once, in whatever order they landed and however long a chain is.

* ``page_links``    one (url, next_url) per landed url
* ``rank_pages``    (url, chain, position): ``chain`` is the url of the
                    chain's first page, ``position`` counts from 0
* ``chain_report``  (chain, pages, status, next_url): how each chain ends

A page that several pages name continues the one with the smallest url.
Statuses: ``complete`` (the last page has no ``next_url``), ``broken``
(the page it names has not landed), ``joins`` (the page it names
continues another chain) and ``cycle`` (it names a page of its own
chain).  Pages of a cycle that no page from outside leads into have no
first page: their chain is the smallest url of the cycle, their position
null.

Method: pointer doubling.  Every page points at the page before it; a
round replaces the pointer by the pointer's pointer and adds the hops, so
a chain of n pages takes log2 n rounds, each a join of thin rows on
distinct keys.  Pages that reach a first page leave the rounds.  When as
many rounds have passed as the number of open pages has bits, the pages
still open are in cycles.  Each round is written to the shared folder, so
the lineage stays short and a lost executor repeats one round.

Nulls: a page without a url cannot be linked and is left out; an empty
``next_url`` counts as none.  A url that landed several times counts
once, with the greatest ``next_url`` it had (a page that was the last when
it first landed may have been continued since).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.session import materialized


def page_links(pages: DataFrame) -> DataFrame:
    """(url, next_url), one row per landed url."""
    named = F.when(F.col("next_url") != "", F.col("next_url"))
    return pages.where(F.col("url").isNotNull()).groupBy("url").agg(F.max(named).alias("next_url"))


def _before(links: DataFrame) -> DataFrame:
    """(url, before) of the landed pages that some landed page names."""
    named = links.where(F.col("next_url").isNotNull()).groupBy(F.col("next_url").alias("url")).agg(
        F.min("url").alias("before")
    )
    return named.join(links.select("url"), "url", "left_semi")


def rank_pages(links: DataFrame) -> DataFrame:
    """(url, chain, position) of every linked page (see the module's text)."""
    start = links.join(_before(links), "url", "left").select(
        "url",
        F.col("before").alias("at"),  # null: the first page is known
        F.when(F.col("before").isNull(), F.col("url")).alias("chain"),
        F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
        F.least("url", "before").alias("smallest"),
    )
    now = materialized(start, "chain-ranks")
    open_pages = now.where(F.col("at").isNotNull()).count()
    for _ in range(open_pages.bit_length()):
        there = now.select(
            F.col("url").alias("at"), F.col("at").alias("_at"), F.col("chain").alias("_chain"),
            F.col("hops").alias("_hops"), F.col("smallest").alias("_smallest"),
        )
        moved = now.where(F.col("at").isNotNull()).join(there, "at").select(
            "url", F.col("_at").alias("at"), F.col("_chain").alias("chain"),
            (F.col("hops") + F.col("_hops")).alias("hops"), F.least("smallest", "_smallest").alias("smallest"),
        )
        now = materialized(now.where(F.col("at").isNull()).unionByName(moved), "chain-ranks")
        if now.where(F.col("at").isNotNull()).isEmpty():
            break
    return now.select(
        "url",
        F.coalesce("chain", "smallest").alias("chain"),
        F.when(F.col("chain").isNotNull(), F.col("hops")).alias("position"),
    )


def chain_report(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """(chain, pages, status, next_url): one row per chain.  ``next_url`` is
    the page that a broken, joining or closing chain's last page names."""
    placed = ranks.join(links, "url")
    ends = placed.groupBy("chain").agg(
        F.count("*").alias("pages"),
        F.max_by(F.struct("url", "next_url"), "position").alias("last"),
        F.max(F.col("position").isNull()).alias("closed"),
    )
    last = ends.select("chain", "pages", "closed", F.col("last.next_url").alias("next_url"))
    target = ranks.select(F.col("url").alias("next_url"), F.col("chain").alias("_into"))
    status = (
        F.when(F.col("closed"), "cycle")
        .when(F.col("next_url").isNull(), "complete")
        .when(F.col("_into").isNull(), "broken")
        .when(F.col("_into") == F.col("chain"), "cycle")
        .otherwise("joins")
    )
    return last.join(target, "next_url", "left").select("chain", "pages", status.alias("status"), "next_url")


def ordered_bars(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """GEN-2 along the chains: (chain, position, index, bar) of every element
    of ``results``, as following the links would yield them."""
    return pages.join(ranks, "url").select(
        "ticker", "chain", "position", F.posexplode("results").alias("index", "bar")
    )
