"""Content hashes: SHA-256 over compact JSON with keys in order at every level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import blank_to_null


def stable_hash(**fields: Column) -> Column:
    """Hash of named values. Nested structs must list their fields A-Z; decimals,
    dates and timestamps must come as text."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def image_struct(image: Column) -> Column:
    return F.struct(
        image["high_resolution_url"].alias("high_resolution_url"),
        image["type"].alias("type"),
        image["url"].alias("url"),
    )


def specification_struct(spec: Column) -> Column:
    return F.struct(
        spec["name"].alias("name"), spec["section"].alias("section"), spec["value"].alias("value")
    )


def fields_version(tracked: Iterable[str]) -> str:
    """Name of a list of tracked fields, whatever their order."""
    return hashlib.sha256(",".join(sorted(tracked)).encode()).hexdigest()[:12]


def content_hash(columns: list[str], tracked: Iterable[str] = fixed.TRACKED_FIELDS) -> Column:
    """Hash over the tracked fields; a tracked field absent from ``columns`` hashes as null."""
    fields = {}
    for name in tracked:
        if name not in columns:
            fields[name] = F.lit(None).cast("string")
        elif name == "images":
            fields[name] = F.transform("images", image_struct)
        elif name == "specifications":
            fields[name] = F.transform("specifications", specification_struct)
        else:
            fields[name] = F.col(name)
    return stable_hash(**fields)


def image_hash(image: Column) -> Column:
    return stable_hash(
        url=image["url"], high_resolution_url=image["high_resolution_url"], type=image["type"]
    )


def review_hash(review: Column, given: Column | None = None) -> Column:
    """A hash that came with the review wins, else the hash of the record."""
    names = ("external_id", "reviewer_name", "rating", "title", "text", "verified_purchase")
    own = stable_hash(
        review_date=review["review_date"].cast("string"), **{n: review[n] for n in names}
    )
    return own if given is None else F.coalesce(blank_to_null(given), own)
