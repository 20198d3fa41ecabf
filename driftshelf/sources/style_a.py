"""Shop pages with structured-data blocks: discovery links and product records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import jsonld, text, urls
from . import html
from .records import PageRules, failing, finish, listed

_parse_start = html.marked_nodes({"category": fixed.STYLE_A_CATEGORY_LINK})
_parse_next = html.marked_nodes({"next": fixed.STYLE_A_NEXT_PAGE})
_parse_listing = html.marked_nodes(
    {"product": fixed.STYLE_A_LISTING_LINK, "required": fixed.STYLE_A_LISTING_CARD,
     "page_title": "title", "page_body": "body"}
)


def category_urls(start_pages: DataFrame) -> DataFrame:
    """Distinct category addresses of a site's start page (``site_id, url, html``)."""
    found = _parse_start("url", "html")["category"]
    nodes = start_pages.select("site_id", F.explode(found).alias("n"))
    return nodes.where("n.link is not null").select(
        "site_id", urls.canonicalize_url(F.col("n.link")).alias("category")
    ).distinct()


def next_pages(pages: DataFrame) -> DataFrame:
    """``site_id, url, next`` of saved listing pages: the page that the first next link leads to."""
    found = F.get(_parse_next("url", "html")["next"], F.lit(0))["link"]
    return pages.select(
        "site_id", urls.canonicalize_url(F.col("url")).alias("url"), urls.canonicalize_url(found).alias("next")
    )


def checked_listing(pages: DataFrame) -> DataFrame:
    """As :func:`listing_links`, and a row with an ``error`` for each page that could not be read."""
    rows = listed(pages, _parse_listing, "product")
    return rows.where("n.link is not null or error is not null").select(
        "site_id", "category", "page_no", urls.canonicalize_url(F.col("n.link")).alias("product"), "error"
    )


def listing_links(pages: DataFrame, parse: Callable = _parse_listing) -> DataFrame:
    """Product links of listing pages (``site_id, category, page_no, url, html``)."""
    nodes = pages.select(
        "site_id", "category", "page_no", F.explode(parse("url", "html")["product"]).alias("n")
    )
    return nodes.where("n.link is not null").select(
        "site_id", "category", "page_no", urls.canonicalize_url(F.col("n.link")).alias("product")
    )


def extractor(selectors: dict[str, str], required: str, opening: int | None = None) -> PageRules:
    """An extraction job for shop pages, given where each field is on the page, and how many
    characters of the body are searched for block markers (all, unless given)."""
    return PageRules(html.PageNodes(selectors, required, ("row", "review"), ("json_ld",), opening), _fields)


def _fields(df: DataFrame) -> DataFrame:
    """Observations from the nodes of product pages, one row per page."""
    df = df.withColumn("ld", jsonld.product_block(html.texts(F.col("nodes"), "json_ld")))
    n, ld = F.col("nodes"), F.col("ld")

    df = df.withColumns(
        {
            "external_id": urls.last_segment(F.col("url")),
            "canonical_url": urls.canonicalize_url(F.col("url")),
            "title": text.first_filled(
                html.first_text(n, "title"), jsonld.read(ld, "$.name"), F.lit(fixed.DEFAULT_TITLE)
            ),
            "description": F.coalesce(
                html.first_text(n, "description"), jsonld.read(ld, "$.description")
            ),
            "crumbs": text.without_home(html.texts(n, "breadcrumb")),
            "price_source": text.first_filled(
                html.first_text(n, "price"), jsonld.read(ld, "$.offers.price")
            ),
            "rating_source": text.first_filled(
                html.first_attr(n, "rating", "data-rating"), html.first_text(n, "rating")
            ),
            "count_source": html.first_text(n, "review_count"),
            "page_images": F.filter(
                F.transform(html.nodes_of(n, "image"), lambda x: x["link"]),
                lambda x: x.isNotNull(),
            ),
            "rows": html.row_cells(n, "row"),
        }
    )
    df = df.withColumns(
        {
            "brand": text.first_filled(jsonld.brand(ld), text.first_word(F.col("title"))),
            "model_number": jsonld.read(ld, "$.model"),
            "sku": text.first_filled(jsonld.read(ld, "$.sku"), F.col("external_id")),
            "current_price": text.price_text(F.col("price_source")),
            "currency": jsonld.currency(ld, fixed.DEFAULT_CURRENCY),
            "availability": text.stock_from_schema(jsonld.read(ld, "$.offers.availability")),
            "category": text.item(F.col("crumbs"), 1),
            "subcategory": text.category_second(F.col("crumbs")),
            "highlights": F.when(
                text.blank_to_null(F.col("description")).isNotNull(), F.array("description")
            ).otherwise(F.array().cast("array<string>")),
            "rating": text.price_text(F.col("rating_source")),
            "review_count": text.first_count(F.coalesce("count_source", F.lit("0"))),
            "image_urls": F.array_distinct(F.concat(jsonld.image_list(ld), F.col("page_images"))),
            "specifications": F.transform(
                F.filter("rows", lambda c: F.size(c) >= 2),
                lambda c: F.struct(
                    F.lit(fixed.DEFAULT_SECTION).alias("section"),
                    F.element_at(c, 1).alias("name"),
                    text.join_cells(c).alias("value"),
                ),
            ),
            "reviews": F.filter(
                F.transform(
                    html.nodes_of(n, "review"),
                    lambda r: F.struct(
                        F.lit(None).cast("string").alias("external_id"),
                        html.first_of(html.inside(n, r, "review_author")).alias("reviewer_name"),
                        F.lit(None).cast("date").alias("review_date"),
                        text.price_text(html.first_of(html.inside(n, r, "review_rating"))).alias(
                            "rating"
                        ),
                        html.first_of(html.inside(n, r, "review_title")).alias("title"),
                        html.first_of(html.inside(n, r, "review_text")).alias("text"),
                        F.lit(None).cast("boolean").alias("verified_purchase"),
                    ),
                ),
                lambda r: r["text"].isNotNull(),
            ),
            "raw_data": F.to_json(
                F.struct(
                    F.coalesce("ld", F.parse_json(F.lit("{}"))).alias("json_ld"),
                    F.lit(fixed.STYLE_A_SOURCE).alias("source"),
                )
            ),
        }
    )
    df = df.withColumn("images", image_entries(F.col("image_urls")))
    df = failing(
        df,
        bad_offers=jsonld.bad_offers(ld),
        review_count_overflow=F.col("review_count").isNull(),
    )
    return finish(df)


def image_entries(addresses: Column) -> Column:
    """Image records in list order; the first is the main one."""
    return F.transform(
        addresses,
        lambda u, i: F.struct(
            u.alias("url"),
            u.alias("high_resolution_url"),
            F.when(i == 0, "main").otherwise("gallery").alias("type"),
        ),
    )


extract = extractor(fixed.STYLE_A_SELECTORS, fixed.STYLE_A_REQUIRED)
