"""Which products a run should visit, from the links of its listing pages.

Pages are read category by category, each in page order, until N distinct products are
found; the page that reaches N is still read whole. Here: count the products each page
adds, find the page where the running sum crosses N, keep everything up to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import lookup
from .rounds import cut


PAGE_BLOCK = 1000
#: One page of so many, by the hash of its address, is a hub: walks share what lies between hubs.
HUB_GAP = 256


def order_pages(starts: DataFrame, nexts: DataFrame) -> DataFrame:
    """Listing pages in the order their own links give: ``site_id, category, page_no, url``.

    ``starts``: ``site_id, category``, each the address of its first page; ``nexts``:
    ``site_id, url, next``, one row a page, ``next`` null on the last. A page that comes again in
    a category ends it.

    Categories run into each other, so there can be far more rows than pages. What is moved and
    cut in rounds is the piece of pages from each start and each hub to the next hub, and the
    hubs of each category; rows are written out of whole pieces at the very end, where the
    pages of a piece that a circle comes to a second time are left off.
    """
    begun = cut(starts.select("site_id", "category").distinct())
    bare = "site_id IS NULL OR category IS NULL"
    ahead = cut(nexts.where("next IS NOT NULL").groupBy("site_id", "url").agg(F.min("next").alias("next")))
    hubs = ahead.select("site_id", "url").unionByName(ahead.select("site_id", F.col("next").alias("url")))
    sources = hubs.where(_hub("url")).unionByName(
        begun.where(f"NOT ({bare})").select("site_id", F.col("category").alias("url"))).distinct()
    far = F.lit(1).cast("bigint").alias("far")
    pieces, _ = _walk(
        sources.select("site_id", F.col("url").alias("source"), "url"),
        ahead.where(~_hub("next")).select("site_id", "url", "next", far), "source")
    legs = pieces.join(ahead.where(_hub("next")), ["site_id", "url"]).select(
        "site_id", F.col("source").alias("url"), "next", (F.col("at") + 1).alias("far"))
    walks, circles = _walk(
        begun.where(f"NOT ({bare})").select("site_id", "category", F.col("category").alias("url")), legs, "category")
    walks = walks.withColumnRenamed("url", "source")

    circles = circles.withColumnRenamed("url", "source")
    rounds = pieces.join(circles, ["site_id", "source"]).select("site_id", "url")
    again = pieces.join(circles, ["site_id", "source"], "left_anti").join(rounds, ["site_id", "url"])
    whole = pieces.groupBy("site_id", "source").agg(
        F.sort_array(F.collect_list(F.struct("at", "url"))).alias("pages"))
    lengths = pieces.groupBy("site_id", "source").agg(F.count("*").alias("size")).join(
        again.groupBy("site_id", "source").agg(F.count("*").alias("again")), ["site_id", "source"], "left")
    ends = walks.join(lengths, ["site_id", "source"]).groupBy("site_id", "category").agg(
        (F.max(F.col("at") + F.col("size")) - F.coalesce(F.max("again"), F.lit(0))).alias("end"))
    left = F.least(F.size("pages"), F.col("end") - F.col("at")).cast("int")
    placed = walks.join(ends, ["site_id", "category"]).join(whole, ["site_id", "source"]).select(
        "site_id", "category", "at", F.explode(F.slice("pages", F.lit(1), left)).alias("page"))
    return placed.select(
        "site_id", "category", (F.col("at") + F.col("page.at") + 1).alias("page_no"), "page.url"
    ).unionByName(begun.where(bare).select(
        "site_id", "category", F.lit(1).cast("bigint").alias("page_no"), F.col("category").alias("url")))


def _hub(url: str) -> Column:
    return F.pmod(F.xxhash64("site_id", url), F.lit(HUB_GAP)) == 0


def _walk(starts: DataFrame, nexts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Where each walk comes and how ``far`` from its start, each address once: ``site_id, name,
    url, at``; and the addresses on the circles that walks end in.

    ``starts``: ``site_id, name, url``; ``nexts``: ``site_id, url, next, far``. The first 2, 4, 8, ...
    addresses are placed in each round, by links that lead as many on, so a walk of n takes
    about log2 n rounds; each is cut. Links as long as every walk lead from all of it onto its
    circle, to each address there.
    """
    placed = cut(starts.withColumn("at", F.lit(0).cast("bigint")))
    ahead, known = cut(nexts), placed.count()
    while True:
        found = placed.join(ahead, ["site_id", "url"]).select(
            "site_id", name, F.col("next").alias("url"), (F.col("at") + F.col("far")).alias("at"))
        last, placed = placed, cut(
            placed.select("site_id", name, "url", "at").unionByName(found).groupBy("site_id", name, "url").agg(F.min("at").alias("at")))
        if (now := placed.count()) == known:
            seen = last.select("site_id", "url").distinct()
            return placed, cut(seen.join(ahead, ["site_id", "url"]).select("site_id", F.col("next").alias("url")).distinct())
        known = now
        on = ahead.select("site_id", F.col("url").alias("next"), F.col("next").alias("after"), F.col("far").alias("_far"))
        ahead = cut(ahead.join(on, ["site_id", "next"]).select(
            "site_id", "url", F.col("after").alias("next"), (F.col("far") + F.col("_far")).alias("far")))


def first_pages(links: DataFrame) -> DataFrame:
    """Each distinct product of a site with the first page it is on.

    ``links``: ``site_id, category, page_no, product``; one row out per product, folded
    in the map tasks.
    """
    return links.groupBy("site_id", "product").agg(
        F.min(F.struct("category", "page_no")).alias("first")
    ).select("site_id", "product", "first.category", "first.page_no")


def _limited(rows: DataFrame, limit: int | DataFrame) -> DataFrame:
    """Rows of the sites that have a limit, with it; one for all, or ``site_id, max_products``."""
    if isinstance(limit, int):
        return rows.withColumn("limit", F.lit(limit))
    given = limit.where("max_products > 0").select("site_id", F.col("max_products").alias("limit"))
    return rows.join(given, "site_id")


def _crossing(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The row of each group at which ``before`` and the sum of ``added`` so far reach ``limit``."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("reached", F.sum("added").over(w) + F.col("before"))
    before = F.col("reached") - F.col("added")
    return summed.where((F.col("reached") >= F.col("limit")) & (before < F.col("limit"))).withColumn("before", before)


def cut_pages(firsts: DataFrame, limit: int | DataFrame) -> DataFrame:
    """Per site, the page at which ``limit`` distinct products are reached, if any.

    A running sum over blocks of pages, in order of category, gives the block of the cut; one over the
    pages of that block gives the page. So a task orders the blocks of a site, or
    `PAGE_BLOCK` pages, never all pages of a site or of a category.
    """
    pages = firsts.groupBy("site_id", "category", "page_no").agg(F.count("*").alias("added"))
    block = ["site_id", "category", "block"]
    pages = _limited(pages.withColumn("block", F.floor(F.col("page_no") / PAGE_BLOCK)), limit)
    totals = pages.groupBy(*block).agg(F.sum("added").alias("added"), F.first("limit").alias("limit"))
    found = _crossing(totals.withColumn("before", F.lit(0)), ["site_id"], ["category", "block"])
    found = found.select(*(F.col(c).alias(f"_{c}") for c in block), "before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in block])
    cut = _crossing(pages.join(found, same), block, ["page_no"])
    return cut.select(
        "site_id", F.lit(True).alias("cut"),
        F.col("category").alias("cut_category"), F.col("page_no").alias("cut_page"),
    )


def lowest(products: DataFrame, limit: int | DataFrame) -> DataFrame:
    """The first ``limit`` products of each site in order.

    After the cut a site holds fewer than ``limit`` products beside those of one page.
    Products of a site without a limit don't meet in one group.
    """
    if isinstance(limit, DataFrame):
        given = limit.where("max_products > 0").select("site_id", "max_products")
        known = lookup(products, given, ["site_id"], "left", ["product"])
        w = Window.partitionBy("site_id", F.when(F.col("max_products").isNull(), F.col("product"))).orderBy("product")
        ranked = known.withColumn("_rank", F.row_number().over(w))
        inside = F.col("max_products").isNull() | (F.col("_rank") <= F.col("max_products"))
        return ranked.where(inside).drop("_rank", "max_products")
    w = Window.partitionBy("site_id").orderBy("product")
    return (
        products.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )


def discover(
    links: DataFrame, limit: int | DataFrame | None = None, seeds: DataFrame | None = None
) -> DataFrame:
    """Distinct products per site (``site_id, product``).

    A limit is one number for all sites, or ``site_id, max_products`` with null or 0 for
    none. Without a limit: all products, and the seeds. With one: products on pages up to the
    cut page; a site that never reaches the limit adds its seeds; then the first
    ``limit`` in order.
    """
    firsts = first_pages(links)
    if not limit:
        found = firsts.select("site_id", "product")
        return found if seeds is None else found.unionByName(seeds).distinct()
    cuts = cut_pages(firsts, limit)
    reached = lookup(firsts, cuts, ["site_id"], "left", ["product"]).where(
        F.col("cut").isNull()
        | (F.struct("category", "page_no") <= F.struct("cut_category", "cut_page"))
    )
    found = reached.select("site_id", "product")
    if seeds is not None:
        extra = lookup(seeds, cuts, ["site_id"], "left_anti", ["product"])
        extra = extra.select("site_id", "product")
        found = found.unionByName(extra).distinct()
    return lowest(found, limit)


def first_errors(listed: DataFrame, limit: int | DataFrame | None = None) -> DataFrame:
    """Per site, the error of the first unreadable listing page (``site_id, error``).

    ``listed``: links with an ``error`` column, one row without a product per such page.
    Pages behind the one that reaches the limit are not read, so they can't fail.
    """
    errors = listed.where(F.col("error").isNotNull()).groupBy("site_id").agg(
        F.min(F.struct("category", "page_no", "error")).alias("first")
    )
    if limit:
        cuts = cut_pages(first_pages(listed.where(F.col("error").isNull())), limit)
        at = F.struct("first.category", "first.page_no")
        errors = errors.join(cuts, "site_id", "left").where(
            F.col("cut").isNull() | (at <= F.struct("cut_category", "cut_page"))
        )
    return errors.select("site_id", "first.error")


def discovered_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("site_id").agg(F.count_distinct("product").alias("discovered"))
