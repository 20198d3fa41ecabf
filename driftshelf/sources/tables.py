"""Readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt over ``parts`` tasks, if given.

    For pages in a few large row groups, whose parsing costs far more than moving them; the
    caller knows the files. By default rows stay where they are.
    """
    return df if parts is None else df.repartition(parts)


def observations(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """Product observations kept as files; nested lists follow the record layout."""
    return spark.read.schema(schemas.ddl(schemas.OBSERVATIONS)).format(file_format).load(path)


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved product pages: ``site_id, run_id, run_ts, item_seq, url, html``."""
    fields = {**schemas.RUN_FIELDS, "url": "string", "html": "string"}
    return spark.read.schema(schemas.ddl(fields)).parquet(path)


def relational(spark: SparkSession, url: str, name: str, key: str, bounds: tuple[int, int],
               partitions: int, properties: dict[str, str]) -> DataFrame:
    """An existing database table, read in parallel ranges of a numeric key."""
    return spark.read.jdbc(
        url, name, column=key, lowerBound=bounds[0], upperBound=bounds[1],
        numPartitions=partitions, properties=properties,
    )


def site(sites: DataFrame, code: str) -> DataFrame:
    """The enabled site with a code."""
    return sites.where((F.col("code") == code) & F.col("enabled"))


def unknown_sites(wanted: DataFrame, sites: DataFrame) -> DataFrame:
    """Requested codes that name no enabled site."""
    return wanted.join(sites.where("enabled").select("code"), "code", "left_anti")


def site_urls(products: DataFrame, site_id: int) -> DataFrame:
    return products.where(F.col("site_id") == site_id).select("canonical_url")
