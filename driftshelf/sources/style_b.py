"""Marketplace pages identified by a ten-character product code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from . import html
from .records import PageRules, failing, finish, listed
from .style_a import image_entries

_ROWS = ("row_1", "row_2", "row_3")
_parse_listing = html.marked_nodes(
    {"item": fixed.STYLE_B_LISTING_ITEM, "required": fixed.STYLE_B_LISTING_CARD,
     "page_title": "title", "page_body": "body"}
)


def checked_listing(pages: DataFrame) -> DataFrame:
    """Product addresses on result pages (``site_id, category, page_no, url, html``), and a
    row with an ``error`` for each page that could not be read.

    All pages are read; where a column ``page_limit`` is filled, pages up to it in a category."""
    if "page_limit" in pages.columns:
        pages = pages.where(F.col("page_limit").isNull() | (F.col("page_no") <= F.col("page_limit")))
    code = F.col("n.attrs")[fixed.STYLE_B_CODE_ATTRIBUTE]
    rows = listed(pages, _parse_listing, "item").where(text.is_code(code) | F.col("error").isNotNull())
    return rows.select(
        "site_id", "category", "page_no", text.product_url(F.upper(code)).alias("product"), "error"
    )


def listing_links(pages: DataFrame) -> DataFrame:
    """The addresses on the pages that could be read."""
    return checked_listing(pages).where("error is null").drop("error")


def seeds(configured: DataFrame) -> DataFrame:
    """Configured start addresses or codes (``site_id, value``) that hold a valid code."""
    coded = configured.withColumn("code", text.product_code(F.col("value")))
    return coded.where("code is not null").select(
        "site_id", text.product_url(F.col("code")).alias("product")
    ).distinct()


def _review(nodes: Column, block: Column) -> Column:
    """One review; led by its sort keys, so the array sorts by id, then text."""
    def first(field: str) -> Column:
        return html.first_of(html.inside(nodes, block, field))

    identity = block["attrs"]["id"]
    return F.struct(
        F.coalesce(identity, F.lit("")).alias("order_id"),
        F.coalesce(first("review_text"), F.lit("")).alias("order_text"),
        block["pos"].alias("pos"),
        identity.alias("external_id"),
        first("review_author").alias("reviewer_name"),
        first("review_date").alias("date_text"),
        text.price_text(first("review_rating")).alias("rating"),
        first("review_title").alias("title"),
        first("review_text").alias("text"),
        first("review_badge").isNotNull().alias("verified_purchase"),
    )


def _review_record(r: Column) -> Column:
    return F.struct(
        r["external_id"].alias("external_id"),
        r["reviewer_name"].alias("reviewer_name"),
        text.review_date(r["date_text"]).alias("review_date"),
        r["rating"].alias("rating"),
        r["title"].alias("title"),
        r["text"].alias("text"),
        r["verified_purchase"].alias("verified_purchase"),
    )


def _bad_date(r: Column) -> Column:
    date = r["date_text"]
    return text.review_date_text(date).isNotNull() & text.review_date(date).isNull()


def _image_urls(main: Column, nodes: Column) -> Column:
    """Full-size addresses of the main image and the thumbnails, distinct and sorted."""
    def sources(images: Column) -> Column:
        return F.transform(
            F.filter(images, lambda n: F.coalesce(n["attrs"]["src"], F.lit("")) != ""),
            lambda n: n["link"],
        )

    none = F.array().cast("array<string>")
    listed = F.coalesce(F.json_object_keys(main["attrs"]["data-a-dynamic-image"]), none)
    found = F.concat(
        F.when(main.isNull(), none).otherwise(
            F.concat(listed, F.array(main["attrs"]["data-old-hires"]), sources(F.array(main)))
        ),
        sources(html.nodes_of(nodes, "alt_image")),
    )
    kept = F.filter(found, lambda u: u.isNotNull() & (u != ""))
    return F.array_sort(F.array_distinct(F.transform(kept, text.full_size_image)))


def _coded(n: Column, code: Column, label: Column) -> Column:
    return F.struct(code.alias("code"), n["pos"].alias("pos"), label.alias("label"))


def _links(nodes: Column) -> Column:
    """Product links with a name, by code and document order."""
    return F.array_sort(
        F.filter(
            F.transform(
                html.nodes_of(nodes, "link"),
                lambda n: _coded(n, text.product_code(n["attrs"]["href"]), n["text"]),
            ),
            lambda x: x["code"].isNotNull() & (x["label"] != ""),
        )
    )


def _options(nodes: Column) -> Column:
    """Elements with a product code and their label, by code and document order."""
    code = fixed.STYLE_B_CODE_ATTRIBUTE
    return F.array_sort(
        F.filter(
            F.transform(
                html.nodes_of(nodes, "option"),
                lambda n: _coded(
                    n, F.upper(n["attrs"][code]),
                    text.strip(
                        text.first_filled(n["attrs"]["title"], n["text"], F.upper(n["attrs"][code]))
                    ),
                ),
            ),
            lambda x: text.is_code(x["code"]),
        )
    )


def _first_of_code(entries: str) -> Column:
    """Of entries sorted by code and position, the first of each code."""
    return F.filter(
        entries, lambda x, i: ~F.get(F.col(entries), i - 1)["code"].eqNullSafe(x["code"])
    )


def _relation_record(x: Column) -> Column:
    return F.struct(
        F.lit("related").alias("type"),
        x["code"].alias("external_id"),
        x["label"].alias("name"),
        text.product_url(x["code"]).alias("url"),
        x["code"].alias("sku"),
        text.price_text(x["label"]).alias("price"),
        F.lit(fixed.DEFAULT_CURRENCY).alias("currency"),
    )


def _variant_record(x: Column) -> Column:
    return F.struct(
        F.lit(fixed.STYLE_B_VARIANT_NAME).alias("name"),
        x["label"].alias("value"),
        x["code"].alias("sku"),
        text.product_url(x["code"]).alias("url"),
        text.price_text(x["label"]).alias("price"),
        F.lit(None).cast("string").alias("availability"),
    )


def _specifications(rows: Column) -> Column:
    records = F.transform(
        F.filter(rows, lambda c: F.size(c) >= 2),
        lambda c: F.struct(
            F.lit(fixed.STYLE_B_SECTION).alias("section"),
            F.element_at(c, 1).alias("name"),
            text.join_cells(c).alias("value"),
        ),
    )
    return F.array_sort(F.array_distinct(records))


def _fields(df: DataFrame) -> DataFrame:
    """Observations from the nodes of product pages, one row per page."""
    df = df.withColumn("code", text.product_code(F.col("url")))
    n, code = F.col("nodes"), F.col("code")
    df = failing(df, no_product_code=code.isNull())
    df = df.withColumns(
        {
            "specifications": _specifications(F.concat(*[html.row_cells(n, r) for r in _ROWS])),
            "crumbs": F.filter(html.texts(n, "breadcrumb"), lambda t: t != ""),
            "availability_text": F.coalesce(html.first_text(n, "availability"), F.lit("")),
            "main": F.try_element_at(html.nodes_of(n, "main_image"), F.lit(1)),
            "review_blocks": F.array_sort(
                F.filter(
                    F.transform(html.nodes_of(n, "review"), lambda r: _review(n, r)),
                    lambda r: r["text"].isNotNull(),
                )
            ),
            "links": F.filter(_links(n), lambda x: x["code"] != code),
            "options": F.filter(
                _options(n), lambda x: ~((x["code"] == code) & (x["label"] == x["code"]))
            ),
        }
    )
    specs = F.col("specifications")
    df = df.withColumns(
        {
            "external_id": code,
            "canonical_url": text.product_url(code),
            "title": F.coalesce(html.first_text(n, "title"), F.lit(fixed.STYLE_B_DEFAULT_TITLE)),
            "description": text.join_blocks(
                F.array(*[html.first_text(n, f"description_{i}") for i in (1, 2, 3)])
            ),
            "brand": text.clean_brand(
                F.coalesce(html.first_text(n, "byline"), text.spec_value(specs, fixed.SPEC_BRAND))
            ),
            "model_number": F.coalesce(*[text.spec_value(specs, s) for s in fixed.SPEC_MODEL]),
            "sku": code,
            "current_price": text.price_text(html.first_text(n, "price")),
            "original_price": text.price_text(html.first_text(n, "original_price")),
            "currency": F.lit(fixed.DEFAULT_CURRENCY),
            "availability": text.stock_from_text(F.col("availability_text")),
            "category": text.item(F.col("crumbs"), 1),
            "subcategory": text.category_last(F.col("crumbs")),
            "highlights": text.highlight_lines(html.texts(n, "highlight")),
            "whats_in_the_box": text.split_list(
                F.coalesce(text.spec_value(specs, fixed.SPEC_BOX), F.lit(""))
            ),
            "rating": text.price_text(html.first_text(n, "rating")),
            "review_count": text.comma_count(
                F.coalesce(html.first_text(n, "review_count"), F.lit("0"))
            ),
            "images": image_entries(_image_urls(F.col("main"), n)),
            "reviews": F.transform("review_blocks", _review_record),
            "relations": F.transform(_first_of_code("links"), _relation_record),
            "variants": F.transform(_first_of_code("options"), _variant_record),
            "raw_data": F.to_json(
                F.struct(
                    F.lit(fixed.STYLE_B_SOURCE).alias("source"), code.alias("asin"),
                    "availability_text",
                )
            ),
        }
    )
    df = failing(
        df,
        review_count_unreadable=F.col("review_count").isNull(),
        bad_review_date=F.exists("review_blocks", _bad_date),
    )
    return finish(df)


def extractor(opening: int | None = None) -> PageRules:
    """The extraction job; `opening` says how many characters of the body are searched for block
    markers (all, unless given)."""
    return PageRules(html.PageNodes(
        fixed.STYLE_B_SELECTORS, fixed.STYLE_B_REQUIRED, (*_ROWS, "review"), opening=opening), _fields)


extract = extractor()
