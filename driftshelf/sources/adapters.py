"""Registry of page styles: what a site needs is two DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import urls
from ..operators import discovery
from ..operators.keyed import lookup
from . import style_a, style_b
from .records import PageRules, extract_styles


@dataclass(frozen=True)
class PageStyle:
    """``listing_links``: listing pages to product links; ``extract``: product pages to
    observations; ``seeds``: configured start values to products, where a style has them;
    ``checked_listing``: links with a row and an ``error`` per unreadable listing page;
    ``categories``: start pages to ``site_id, category``, and ``next_pages``: listing pages to
    ``site_id, url, next``, where a style's pages say which comes after which."""

    listing_links: Callable[[DataFrame], DataFrame]
    extract: Callable[[DataFrame], DataFrame]
    seeds: Callable[[DataFrame], DataFrame] | None = None
    checked_listing: Callable[[DataFrame], DataFrame] | None = None
    categories: Callable[[DataFrame], DataFrame] | None = None
    next_pages: Callable[[DataFrame], DataFrame] | None = None


STYLES: dict[str, PageStyle] = {
    fixed.STYLE_A: PageStyle(
        style_a.listing_links, style_a.extract, checked_listing=style_a.checked_listing,
        categories=style_a.category_urls, next_pages=style_a.next_pages),
    fixed.STYLE_B: PageStyle(
        style_b.listing_links, style_b.extract, style_b.seeds, style_b.checked_listing),
}


def register(name: str, style: PageStyle) -> None:
    STYLES[name] = style


def style(name: str) -> PageStyle:
    if name not in STYLES:
        raise ValueError(f"Unsupported adapter: {name}")
    return STYLES[name]


def with_adapter(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages with their site's style name and, if its settings name one, page limit."""
    settings = F.try_parse_json(F.col("settings"))
    limit = F.try_variant_get(settings, "$.catalog_max_pages", "int")
    facts = sites.select("site_id", "adapter", limit.alias("page_limit"))
    return lookup(pages, facts, ["site_id"], "inner", spread=["url"])


def configured_seeds(sites: DataFrame) -> DataFrame:
    """Seed values of the sites' settings."""
    settings = F.try_parse_json(F.col("settings"))
    values = F.try_variant_get(settings, "$.seed_urls", "array<string>")
    return sites.select("site_id", "adapter", F.explode(values).alias("value"))


def styles_of(sites: DataFrame) -> list[str]:
    """Style names the sites use; an unregistered one is an error."""
    names = sorted(r.adapter for r in sites.select("adapter").distinct().toLocalIterator())
    return [name for name in names if style(name)]


def dispatch(
    pages: DataFrame, run: Callable[[str, DataFrame], DataFrame], names: list[str] | None = None
) -> DataFrame:
    """Run each style (all, or those named) over its own pages, by the ``adapter`` column,
    and unite the results."""
    parts = [
        run(name, pages.where(F.col("adapter") == name).drop("adapter"))
        for name in names or STYLES
    ]
    return reduce(DataFrame.unionByName, parts)


def extract(
    pages: DataFrame, names: list[str] | None = None, styles: dict[str, PageStyle] | None = None
) -> DataFrame:
    """Observations of all pages, by the registered styles (all, or those named) or by `styles`.
    Those given as page rules share one pass over the pages; one with a job of its own reads its
    pages by itself."""
    jobs = {name: one.extract for name, one in (styles or {n: style(n) for n in names or STYLES}).items()}
    shared = {name: job for name, job in jobs.items() if isinstance(job, PageRules)}
    own = [name for name in jobs if name not in shared]
    parts = [extract_styles(pages, shared)] if shared else []
    if own:
        parts.append(dispatch(pages, lambda name, mine: jobs[name](mine), own))
    return reduce(DataFrame.unionByName, parts)


def read_listing(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Links of listing pages (``adapter, site_id, category, page_no, url, html``, optional
    ``page_limit``): ``site_id, category, page_no, product, error``."""

    def run(name: str, mine: DataFrame) -> DataFrame:
        one = style(name)
        if one.checked_listing is not None:
            return one.checked_listing(mine)
        return one.listing_links(mine).withColumn("error", F.lit(None).cast("string"))

    return dispatch(pages, run, names)


def order_listing(pages: DataFrame, starts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Saved listing pages (``adapter, site_id, url, html``) with ``category`` and ``page_no`` from
    the links of the start pages (``adapter, site_id, url, html``) and of the pages themselves.

    Pages no link leads to are left out, as they are never visited. A page that is linked but not
    saved stays, with null ``html``. Styles whose pages don't order themselves keep the ``category``
    and ``page_no`` their pages come with.
    """
    parts, given = [], {"category", "page_no"} <= set(pages.columns)
    columns = [c for c in pages.columns if c not in ("category", "page_no")] + ["category", "page_no"]
    for name in names or STYLES:
        one = style(name)
        if one.categories is None or one.next_pages is None:
            parts += [pages.where(F.col("adapter") == name).select(*columns)] if given else []
            continue
        mine = pages.where(F.col("adapter") == name)
        order = discovery.order_pages(
            one.categories(starts.where(F.col("adapter") == name)), one.next_pages(mine)
        ).withColumnRenamed("url", "canonical")
        saved = mine.drop("category", "page_no", "adapter").withColumn("canonical", urls.canonicalize_url(F.col("url")))
        parts.append(order.join(saved, ["site_id", "canonical"], "left").withColumns(
            {"url": F.coalesce("url", "canonical"), "adapter": F.lit(name)}).select(*columns))
    if not parts:
        raise ValueError("no style of these sites orders its listing pages")
    return reduce(DataFrame.unionByName, parts)


def seeds_of(configured: DataFrame, names: list[str] | None = None) -> DataFrame | None:
    """Products of configured seeds (``adapter, site_id, value``); only some styles have them."""
    parts = [
        style(name).seeds(configured.where(F.col("adapter") == name))
        for name in names or STYLES if style(name).seeds is not None
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None


def discover(
    pages: DataFrame, limit: int | DataFrame | None, seeds: DataFrame | None = None,
    names: list[str] | None = None,
) -> DataFrame:
    """Products to visit per site, from the listing pages that could be read and the
    configured seeds."""
    links = read_listing(pages, names).where("error is null").drop("error")
    return discovery.discover(links, limit, None if seeds is None else seeds_of(seeds, names))
