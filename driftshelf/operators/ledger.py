"""Run ledger: one row per run and URL, and the failed-URL log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from ..schemas import FAILED_URLS, RUN_ITEMS
from .keyed import dealt, insert_if_absent, lookup, upsert

ITEM_KEY = ["run_id", "url"]


def enqueue(items: DataFrame, discovered: DataFrame, now: Column) -> DataFrame:
    """Add discovered URLs (``run_id, url, item_seq``) as pending; known ones are left alone."""
    distinct = discovered.groupBy(*ITEM_KEY).agg(F.min("item_seq").alias("item_seq"))
    return items.select(*RUN_ITEMS).unionByName(new_items(items, distinct, now))


def new_items(items: DataFrame, distinct: DataFrame, now: Column) -> DataFrame:
    fresh = insert_if_absent(items, distinct, ITEM_KEY)
    given = {
        "run_id": F.col("run_id"), "url": F.col("url"), "item_seq": F.col("item_seq"),
        "status": F.lit("pending"), "attempts": F.lit(0), "result": F.lit("{}"),
        "updated_at": now,
    }
    return fresh.select(
        *[given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in RUN_ITEMS.items()]
    )


def pending(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending items in run order; a limit of none or 0 means all."""
    rows = items.where(F.col("status") == "pending").orderBy("run_id", "item_seq", "url")
    return rows.limit(limit) if limit else rows


def claim(items: DataFrame, now: Column) -> DataFrame:
    """Pending items become processing: one more attempt, first start time kept."""
    mine = F.col("status") == "pending"
    return items.withColumns(
        {
            "status": F.when(mine, F.lit("processing")).otherwise(F.col("status")),
            "attempts": F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "started_at": F.when(mine, F.coalesce("started_at", now)).otherwise(
                F.col("started_at")
            ),
            "updated_at": F.when(mine, now).otherwise(F.col("updated_at")),
        }
    )


def reset_interrupted(items: DataFrame, now: Column) -> DataFrame:
    """Items left processing by a lost run go back to pending."""
    mine = F.col("status") == "processing"
    return items.withColumns(
        {
            "status": F.when(mine, F.lit("pending")).otherwise(F.col("status")),
            "updated_at": F.when(mine, now).otherwise(F.col("updated_at")),
        }
    )


def record_outcomes(items: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Write outcomes (``run_id, url, status, error_type, error_message, result``) to items.

    A success clears the error; a failure keeps the stored result. Messages can be long, which
    Spark's estimate does not know: outcomes are dealt out, not broadcast.
    """
    done = outcomes.select(
        *ITEM_KEY, F.struct("status", "error_type", "error_message", "result").alias("out")
    )
    joined = items.join(dealt(done, ITEM_KEY).hint("merge"), ITEM_KEY, "left")
    hit = F.col("out").isNotNull()
    failed = F.col("out.status").isin(*fixed.ERROR_STATUSES)
    message = F.col("out.error_message")
    values = {
        "status": F.coalesce("out.status", "status"),
        "error_type": F.when(hit & failed, F.col("out.error_type")).when(
            ~hit, F.col("error_type")
        ),
        "error_message": F.when(hit & failed, message).when(~hit, F.col("error_message")),
        "result": F.when(hit & ~failed, F.coalesce("out.result", F.lit("{}"))).otherwise(
            F.col("result")
        ),
        "completed_at": F.when(hit, now).otherwise(F.col("completed_at")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return joined.select(*[values.get(n, F.col(n)).alias(n) for n in RUN_ITEMS])


def failures(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """Failed and blocked outcomes with the site and time of their run.

    A run may hold a third of all items, so its site comes through a checked lookup.
    """
    bad = outcomes.where(F.col("status").isin(*fixed.ERROR_STATUSES)).select(
        "run_id", "url", "error_type", "error_message",
    )
    sites = runs.select("run_id", "site_id", "run_ts")
    return lookup(bad, sites, ["run_id"], "inner", spread=["url"])


def log_failures(failed_urls: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Failed-URL log: a first failure has no retries, each later one adds a retry."""
    return upsert(
        failed_urls.select(*FAILED_URLS),
        failed,
        ["site_id", "url", "run_id"],
        update={
            "error_type": F.col("new.error_type"),
            "error_message": F.col("new.error_message"),
            "retry_count": F.col("old.retry_count") + 1,
            "last_retry_at": now,
            "updated_at": now,
        },
        insert={"retry_count": F.lit(0), "updated_at": now},
    )


def resumable(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("status").isin(*fixed.NOT_RESUMABLE_STATUSES))


def unfinished(runs: DataFrame) -> DataFrame:
    """Runs a batch still has to process; finished ones keep their stored summary."""
    return runs.where(~F.col("status").isin(*fixed.SKIP_STATUSES))


def requeue(items: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """On resume, failed and blocked items of completed_with_errors runs become pending."""
    partial = runs.where(F.col("status") == "completed_with_errors").select(
        "run_id", F.lit(True).alias("_requeue")
    )
    joined = lookup(items, partial, ["run_id"], "left", spread=["url"])
    mine = F.coalesce("_requeue", F.lit(False)) & F.col("status").isin(*fixed.ERROR_STATUSES)
    return joined.withColumns(
        {
            "status": F.when(mine, F.lit("pending")).otherwise(F.col("status")),
            "completed_at": F.when(~mine, F.col("completed_at")),
            "updated_at": F.when(mine, now).otherwise(F.col("updated_at")),
        }
    ).select(*items.columns)


def resume_runs(runs: DataFrame) -> DataFrame:
    """Resumable runs go back to pending with no completion time."""
    mine = ~F.col("status").isin(*fixed.NOT_RESUMABLE_STATUSES)
    return runs.withColumns(
        {
            "completed_at": F.when(~mine, F.col("completed_at")),
            "status": F.when(mine, F.lit("pending")).otherwise(F.col("status")),
        }
    )


def present_urls(items: DataFrame) -> DataFrame:
    """URLs that count as present in their run: blocked and failed pages do not."""
    return items.where(F.col("status").isin(*fixed.PRESENT_STATUSES)).select("run_id", "url")
