"""Counters, run summaries, status and export projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .keyed import lookup


def _count(*statuses: str) -> Column:
    return F.count_if(F.col("status").isin(*statuses))


def item_counts(items: DataFrame) -> DataFrame:
    """Items per run and status."""
    return items.groupBy("run_id", "status").agg(F.count("*").alias("items"))


def run_counters(items: DataFrame) -> DataFrame:
    """One row per run: counts per status, derived counters, ledger progress.

    All are sums and maxima, so a run with a third of all items is folded map side.
    """
    counts = [_count(s).alias(f"n_{s}") for s in fixed.ITEM_STATUSES]
    done = F.col("status").isin(*fixed.PROCESSED_STATUSES)
    return items.groupBy("run_id").agg(
        *counts,
        _count(*fixed.PROCESSED_STATUSES).alias("processed"),
        _count(*fixed.ERROR_STATUSES).alias("errors"),
        F.max(F.when(done, F.col("item_seq"))).alias("last_item_seq"),
    )


def status_map() -> Column:
    """``{status: n}`` of the statuses that occur, from :func:`run_counters`."""
    pairs = [x for s in fixed.ITEM_STATUSES for x in (F.lit(s), F.col(f"n_{s}"))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def final_status(errors: Column) -> Column:
    return F.when(errors > 0, "completed_with_errors").otherwise("completed")


def counted_runs(runs: DataFrame, counters: DataFrame) -> DataFrame:
    """Runs with their counters; a run without items counts 0 everywhere."""
    joined = runs.join(counters, "run_id", "left")
    numbers = [c for c in counters.columns if c not in ("run_id", "last_item_seq")]
    return joined.na.fill(0, numbers)


def with_site(runs: DataFrame, sites: DataFrame) -> DataFrame:
    """Runs with the columns of their site."""
    facts = sites.select(
        "site_id", F.col("code").alias("site_code"), F.col("name").alias("site_name"),
        "base_url", "adapter", F.col("settings").alias("site_settings"),
    )
    return lookup(runs, facts, ["site_id"], "inner", spread=["run_id"])


def run_overview(runs: DataFrame) -> DataFrame:
    """Every run with its site code and counters (from :func:`with_site` and counters)."""
    return runs.select(
        "run_id", "site_code", "run_type", "status", "products_discovered",
        "products_processed", "products_new", "products_updated", "products_unchanged",
        "products_unavailable", "errors", "started_at", "completed_at",
    )


def product_counters(counted: DataFrame) -> DataFrame:
    return counted.withColumns(
        {
            "products_processed": F.col("processed"),
            "products_new": F.col("n_new"),
            "products_updated": F.col("n_updated"),
            "products_unchanged": F.col("n_unchanged"),
        }
    )


def run_summary(counted: DataFrame) -> DataFrame:
    """Summary object per run: counts on success, the error when the run failed."""
    failed = F.col("status") == "failed"
    common = [
        F.col("run_id"), F.col("site_code").alias("site"), F.col("run_type"), F.col("status"),
    ]
    ok = F.to_json(
        F.struct(
            *common, status_map().alias("items"), F.col("products_unavailable").alias("unavailable"),
            F.lit(True).alias("resumable"),
        )
    )
    bad = F.to_json(
        F.struct(*common, F.col("run_error").alias("error"), F.lit(True).alias("resumable"))
    )
    return counted.withColumn("summary", F.when(failed, bad).otherwise(ok))


def is_finished() -> Column:
    return F.col("status").isin(*fixed.TERMINAL_STATUSES)


def is_success() -> Column:
    return F.col("status").isin(*fixed.SUCCESS_STATUSES)


def success_report(runs: DataFrame, export_base: str) -> DataFrame:
    """Report rows of finished, successful runs, with both export locations."""
    location = F.concat(F.lit(f"{export_base}/runs/"), F.col("run_id").cast("string"))
    return runs.where(is_success()).select(
        "status", "run_id",
        F.col("products_discovered").alias("discovered"),
        F.col("products_new").alias("new"),
        F.col("products_updated").alias("updated"),
        F.col("products_unchanged").alias("unchanged"),
        F.col("products_unavailable").alias("unavailable"),
        "errors",
        F.concat(location, F.lit("/export/json")).alias("json_export"),
        F.concat(location, F.lit("/export/csv")).alias("csv_export"),
    )


def failure_report(runs: DataFrame) -> DataFrame:
    """Report rows of finished runs that did not succeed."""
    return runs.where(is_finished() & ~is_success()).select(
        "status", "run_id", F.col("summary").alias("details")
    )


def run_checkpoint(counted: DataFrame) -> DataFrame:
    """With ``checkpoint``, how far each run has come, as JSON text.

    A run whose discovery failed has none yet; one that has processed no item says what was
    discovered, any other one which item was the last.
    """
    begun = F.to_json(F.struct(F.lit(True).alias("discovery_complete"), F.col("products_discovered").alias("discovered_urls")))
    going = F.to_json(F.struct(
        F.lit(True).alias("discovery_complete"), F.col("last_item_seq").alias("last_item_id"),
        F.col("products_processed").alias("processed")))
    return counted.withColumn("checkpoint", F.when(F.col("run_error").isNotNull(), "{}").when(
        F.coalesce("products_processed", F.lit(0)) == 0, begun).otherwise(going))


def discovery_done(checkpoint: Column) -> Column:
    """Whether a run's checkpoint says that its products are known."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(checkpoint), "$.discovery_complete", "boolean"), F.lit(False))


def update_runs(runs: DataFrame, values: dict[str, Column], where: Column) -> DataFrame:
    """Set allowed run columns where a condition holds; other names are ignored.

    ``checkpoint`` and ``summary`` are JSON text: a struct, map or list given for them is encoded.
    """
    kinds = dict(runs.dtypes)
    wanted = {n: v for n, v in values.items() if n in fixed.RUN_UPDATABLE and n in kinds}
    given = dict(runs.select(*(v.alias(n) for n, v in wanted.items())).dtypes) if wanted else {}

    def encoded(name: str, value: Column) -> Column:
        nested = name in fixed.RUN_JSON and given[name].startswith(("struct", "map", "array"))
        return F.to_json(value) if nested else value.cast(kinds[name])

    return runs.withColumns(
        {name: F.when(where, encoded(name, value)).otherwise(F.col(name)) for name, value in wanted.items()}
    )


def export_rows(products: DataFrame, sites: DataFrame, runs: DataFrame) -> DataFrame:
    """All products of the sites of the given runs, decimals and times as text.

    The run only picks the site: the export is the site's whole catalog.
    """
    wanted = runs.select("site_id").distinct().join(
        sites.select("site_id", F.col("code").alias("site_code")), "site_id"
    )
    rows = lookup(products, wanted, ["site_id"], "inner", spread=["canonical_url"])
    return stringified(rows.select(*products.columns, "site_code"))


def stringified(df: DataFrame) -> DataFrame:
    """Decimals and timestamps as text."""
    as_text = {
        name: F.col(name).cast("string")
        for name, kind in df.dtypes
        if kind.startswith("decimal") or kind.startswith("timestamp")
    }
    return df.withColumns(as_text) if as_text else df
