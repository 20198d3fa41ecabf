"""The site dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import upsert

REFRESHED = ("name", "base_url", "adapter", "settings")


def upsert_sites(sites: DataFrame, seeds: DataFrame, now: Column) -> DataFrame:
    """Seed sites by code: known ones are refreshed but keep whether they are enabled and
    when they were made; new ones come in enabled."""
    known = {name: F.col(f"new.{name}") for name in REFRESHED}
    fresh = {"created_at": now, "updated_at": now, "enabled": F.lit(True)}
    return upsert(sites, seeds, ["code"], {**known, "updated_at": now}, fresh)
