"""Structured-data blocks of a page, read as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

OBJECT = "OBJECT"


def product_block(scripts: Column) -> Column:
    """First object of type Product over all script texts; broken blocks are skipped."""
    parsed = F.transform(scripts, lambda s: F.try_parse_json(s))
    candidates = F.flatten(
        F.transform(
            parsed,
            lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
        )
    )
    products = F.filter(
        candidates, lambda v: F.try_variant_get(v, "$['@type']", "string") == "Product"
    )
    return F.try_element_at(products, F.lit(1))


def kind(block: Column, path: str) -> Column:
    """VARIANT type name at a path, null when the path is absent."""
    return F.schema_of_variant(F.try_variant_get(block, path, "variant"))


def is_kind(block: Column, path: str, name: str) -> Column:
    return F.coalesce(kind(block, path).startswith(name), F.lit(False))


def read(block: Column, path: str) -> Column:
    return F.try_variant_get(block, path, "string")


def brand(block: Column) -> Column:
    """Brand as text or as an object with a name."""
    return text.blank_to_null(
        F.when(is_kind(block, "$.brand", OBJECT), read(block, "$.brand.name")).otherwise(
            read(block, "$.brand")
        )
    )


def currency(block: Column, default: str) -> Column:
    """Offer currency: the default when absent, null when given as null."""
    present = F.try_variant_get(block, "$.offers.priceCurrency", "variant").isNotNull()
    return F.when(present, read(block, "$.offers.priceCurrency")).otherwise(default)


def bad_offers(block: Column) -> Column:
    """An offers value that is not an object cannot be read."""
    given = F.try_variant_get(block, "$.offers", "variant").isNotNull()
    return given & ~is_kind(block, "$.offers", OBJECT)


def image_list(block: Column) -> Column:
    """Image addresses given as one text or a list of texts."""
    many = F.try_variant_get(block, "$.image", "array<string>")
    one = F.when(is_kind(block, "$.image", "STRING"), F.array(read(block, "$.image")))
    return F.filter(
        F.coalesce(many, one, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")
    )
