"""The given tables read as catalog inputs: what stands for runs, items, pages, children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

FIRST_DAY = "2024-01-01"
SHOP = "https://shop.example"


def day_no(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit(FIRST_DAY).cast("date"))


def user_site(user: Column) -> Column:
    return (F.pmod(user, F.lit(3)) + 1).cast("bigint")


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run per site and day with events: some limited, thresholds 1 to 3."""
    days = table(spark, d, "events").select(
        user_site(F.col("user_id")).alias("site_id"), day_no(F.col("ts")).alias("run_no")
    ).distinct()
    return days.select(
        "site_id",
        (F.col("site_id") * 1000 + F.col("run_no")).cast("bigint").alias("run_id"),
        F.col("run_no").cast("bigint").alias("run_no"),
        F.timestamp_add("DAY", F.col("run_no"), F.lit(FIRST_DAY).cast("timestamp")).alias("run_ts"),
        (F.col("run_no") % 5 == 3).alias("limited"),
        (F.col("run_no") % 3 + 1).cast("int").alias("missing_threshold"),
    )


def event_observations(spark: SparkSession, d: str) -> DataFrame:
    """Users as products, days as runs, every event an observation; prices in steps of 100
    so that some records stay unchanged."""
    e = table(spark, d, "events")
    site, day = user_site(F.col("user_id")), day_no(F.col("ts"))
    step = (F.floor(F.col("value") / 100) * 100).cast("decimal(14,2)")
    return e.select(
        site.alias("site_id"),
        (site * 1000 + day).cast("bigint").alias("run_id"),
        F.timestamp_add("DAY", day, F.lit(FIRST_DAY).cast("timestamp")).alias("run_ts"),
        F.struct("ts", "event_id").alias("item_seq"),
        F.concat(F.lit(f"{SHOP}/u/"), F.col("user_id").cast("string")).alias("canonical_url"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("external_id"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("title"),
        step.cast("string").alias("current_price"),
        F.when(F.col("event_type") == "error", "out_of_stock").otherwise("in_stock").alias(
            "availability"
        ),
        F.col("props").alias("raw_data"),
    )


def order_url() -> Column:
    return F.concat(F.lit(f"{SHOP}/o/"), F.col("o_orderkey").cast("string"))


def order_items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ledger rows of one run per customer, in every item status."""
    o = table(spark, d, "orders")
    state, rank = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    status = (
        F.when((state == "F") & (rank == "1"), "failed")
        .when((state == "F") & (rank == "2"), "blocked")
        .when((state == "F") & (rank == "3"), "skipped")
        .when(state == "F", "new")
        .when((state == "P") & rank.isin("1", "2"), "processing")
        .when(state == "P", "pending")
        .when(rank.isin("1", "2", "3"), "updated")
        .otherwise("unchanged")
    )
    error = status.isin("failed", "blocked")
    none = F.lit(None)
    return o.select(
        F.col("o_custkey").alias("run_id"),
        order_url().alias("url"),
        F.col("o_orderkey").alias("item_seq"),
        none.cast("string").alias("external_id"),
        status.alias("status"),
        rank.cast("int").alias("attempts"),
        F.when(error, "timeout").alias("error_type"),
        F.when(error, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias(
            "error_message"
        ),
        F.lit("{}").alias("result"),
        F.when(rank != "5", F.col("o_orderdate")).alias("started_at"),
        F.when(error, F.col("o_orderdate")).alias("completed_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def customer_runs(spark: SparkSession, d: str) -> DataFrame:
    """Customers as runs of their nation's site."""
    c = table(spark, d, "customer")
    balance, full = F.col("c_acctbal"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    status = (
        F.when(balance < 0, "failed").when(balance < 1000, "cancelled")
        .when(balance < 3000, "completed").when(balance < 7000, "completed_with_errors")
        .when(balance < 8000, "running").otherwise("pending")
    )
    return c.select(
        F.col("c_custkey").alias("run_id"),
        F.col("c_nationkey").cast("bigint").alias("site_id"),
        F.when(full, "full").otherwise("incremental").alias("run_type"),
        status.alias("status"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("run_ts"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("completed_at"),
    )


def nation_sites(spark: SparkSession, d: str) -> DataFrame:
    """Nations as sites, Africa's disabled."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    joined = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return joined.select(
        F.col("n_nationkey").cast("bigint").alias("site_id"),
        F.lower("n_name").alias("code"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example")).alias("base_url"),
        F.lower("r_name").alias("adapter"),
        (F.col("r_name") != "AFRICA").alias("enabled"),
        F.lit("{}").alias("settings"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def part_code(key: Column, letter: str = "P") -> Column:
    return F.concat(F.lit(letter), F.lpad(key.cast("string"), 9, "0"))


def part_url(key: Column) -> Column:
    return F.concat(F.lit(f"{SHOP}/dp/"), part_code(key))


def line_child(entry: Column, pos: Column, seen: str) -> list[Column]:
    """Line items as child entries of their order."""
    return [
        F.lit(1).cast("bigint").alias("site_id"),
        F.concat(F.lit(f"{SHOP}/o/"), F.col("l_orderkey").cast("string")).alias("canonical_url"),
        F.lit(seen).cast("timestamp").alias("seen_at"),
        pos.alias("pos"),
        entry.alias("entry"),
    ]
