"""Child rows of a product: images are synced, the other lists are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import hashing, text
from ..schemas import IMAGES, KEY, RELATIONS, REVIEWS, SPECIFICATIONS, VARIANTS
from .keyed import dealt, first_wins, last_wins

IMAGE_KEY = [*KEY, "image_url"]
SPECIFICATION_KEY = [*KEY, "section", "spec_name", "spec_value"]
REVIEW_KEY = [*KEY, "review_hash"]
RELATION_KEY = [*KEY, "relation_type", "related_name", "related_url"]
VARIANT_KEY = [*KEY, "variant_name", "variant_value", "variant_sku"]


def products_of(observations: DataFrame) -> DataFrame:
    """Products a batch rewrites the children of, also those with empty lists."""
    return observations.select(*KEY).distinct()


def entries(observations: DataFrame, field: str) -> DataFrame:
    """List entries of each observation with their position: ``key.., seen_at, pos, entry``.

    The ``*_rows`` functions take this long form, so entries that already are rows of a
    table never have to be collected into lists first.
    """
    return observations.select(
        *KEY, F.col("run_ts").alias("seen_at"), F.posexplode(field).alias("pos", "entry")
    )


def _filled(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def _stamped(df: DataFrame, layout: dict[str, str]) -> DataFrame:
    seen = {"first_seen_at": F.col("seen_at"), "last_seen_at": F.col("seen_at")}
    return df.select(
        *[seen.get(name, F.col(name)).cast(kind).alias(name) for name, kind in layout.items()]
    )


def image_rows(listed: DataFrame) -> DataFrame:
    """Incoming images; the list position is the display order, the last duplicate wins."""
    rows = listed.withColumn("image_url", F.col("entry.url"))
    kept = last_wins(rows, IMAGE_KEY, ["pos"])
    return _stamped(
        kept.select(
            *KEY, "seen_at", "image_url",
            F.col("entry.high_resolution_url").alias("high_resolution_url"),
            _filled(F.col("entry.type"), fixed.DEFAULT_IMAGE_TYPE).alias("image_type"),
            F.col("pos").alias("display_order"),
            hashing.image_hash(F.col("entry")).alias("content_hash"),
        ),
        IMAGES,
    )


def specification_rows(listed: DataFrame) -> DataFrame:
    """Incoming specifications; the first of equal rows stays."""
    rows = listed.select(
        *KEY, "seen_at", "pos",
        _filled(F.col("entry.section"), fixed.DEFAULT_SECTION).alias("section"),
        F.col("entry.name").alias("spec_name"),
        F.col("entry.value").alias("spec_value"),
    )
    return _stamped(first_wins(rows, SPECIFICATION_KEY, ["pos"]), SPECIFICATIONS)


def review_rows(listed: DataFrame) -> DataFrame:
    """Incoming reviews; the first of equal hashes stays."""
    rows = listed.select(
        *KEY, "seen_at", "pos",
        F.col("entry.external_id").alias("external_review_id"),
        F.col("entry.reviewer_name").alias("reviewer_name"),
        F.col("entry.review_date").alias("review_date"),
        text.to_decimal(F.col("entry.rating"), 3, 2).alias("rating"),
        F.col("entry.title").alias("review_title"),
        F.col("entry.text").alias("review_text"),
        F.col("entry.verified_purchase").alias("verified_purchase"),
        hashing.review_hash(F.col("entry")).alias("review_hash"),
    )
    return _stamped(first_wins(rows, REVIEW_KEY, ["pos"]), REVIEWS)


def relation_rows(listed: DataFrame) -> DataFrame:
    """Incoming relations; rows without a URL never collide."""
    rows = listed.select(
        *KEY, "seen_at", "pos",
        F.col("entry.type").alias("relation_type"),
        F.col("entry.external_id").alias("related_external_id"),
        F.col("entry.name").alias("related_name"),
        F.col("entry.url").alias("related_url"),
        F.col("entry.sku").alias("related_sku"),
        text.to_decimal(F.col("entry.price")).alias("related_price"),
        _filled(F.col("entry.currency"), fixed.DEFAULT_CURRENCY).alias("currency"),
    )
    return _stamped(first_wins(rows, RELATION_KEY, ["pos"], ["related_url"]), RELATIONS)


def variant_rows(listed: DataFrame) -> DataFrame:
    """Incoming variants; rows without a SKU never collide."""
    rows = listed.select(
        *KEY, "seen_at", "pos",
        F.col("entry.name").alias("variant_name"),
        F.col("entry.value").alias("variant_value"),
        F.col("entry.sku").alias("variant_sku"),
        F.col("entry.url").alias("variant_url"),
        text.to_decimal(F.col("entry.price")).alias("price"),
        F.col("entry.availability").alias("availability"),
    )
    return _stamped(first_wins(rows, VARIANT_KEY, ["pos"], ["variant_sku"]), VARIANTS)


def _images_together(stored: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored and incoming images of the same products side by side, each table read once.

    ``_kind`` is 0 for stored, 1 for incoming rows; ``_touched`` says that the batch has the
    product, ``_listed`` that it lists the image, ``_first`` when a stored one was first seen.
    Everything is worked out in one exchange on the product key and one sort: images of a
    product are in order when its rows are.
    """
    both = stored.select(*IMAGES, F.lit(0).alias("_kind")).unionByName(
        fresh.select(*IMAGES, F.lit(1).alias("_kind"))
    ).unionByName(touched.select(*KEY, F.lit(2).alias("_kind")), allowMissingColumns=True)
    product, image = Window.partitionBy(*KEY), Window.partitionBy(*IMAGE_KEY)
    return dealt(both, KEY).withColumns({
        "_listed": F.max(F.col("_kind") == 1).over(image),
        "_first": F.min(F.when(F.col("_kind") == 0, F.col("first_seen_at"))).over(image),
    }).withColumn("_touched", F.max(F.col("_kind") == 2).over(product))


def sync_images(stored: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Delete images gone from the list, update the rest, keep when each was first seen."""
    rows = _images_together(stored, fresh, touched)
    kept = rows.where((F.col("_kind") == 1) | (F.col("_kind") == 0) & ~F.col("_touched"))
    first = F.when(F.col("_kind") == 1, F.coalesce("_first", "first_seen_at")).otherwise(F.col("first_seen_at"))
    return kept.withColumn("first_seen_at", first).select(*IMAGES)


def gone_images(stored: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored images of the batch's products missing from their incoming lists."""
    rows = _images_together(stored, fresh, touched)
    return rows.where((F.col("_kind") == 0) & F.col("_touched") & ~F.col("_listed")).select(*IMAGES)


def replace(stored: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Children of untouched products, plus the batch's rows for the touched ones."""
    return stored.join(touched, KEY, "left_anti").unionByName(fresh)


def first_per_id(rows: DataFrame, owner: list[str], code: str, position: list[str]) -> DataFrame:
    """First occurrence of each id within an owner, in document order."""
    return first_wins(rows, [*owner, code], position)


def top_per_owner(rows: DataFrame, owner: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Rows with their rank within each owner; with a limit the first ones, cut before the exchange."""
    w = Window.partitionBy(*owner).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
