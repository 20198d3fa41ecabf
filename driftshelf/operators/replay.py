"""Fold a whole history of runs at once.

The per-run loop carries a missing counter per product. Between two sightings the
counter depends only on the runs in between, so the run at which a product would age
out is a property of its last sighting's *run*. It is worked out once over the run
table and looked up per sighting: no product-by-run grid, one exchange per product key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..schemas import KEY, PRODUCTS
from . import changes
from .keyed import lookup


def run_axis(runs: DataFrame) -> DataFrame:
    """Runs with the aging facts of a product last seen there.

    ``full_rank`` counts the site's unlimited runs so far. A product last seen at run s
    has missed ``full_rank(a) - full_rank(s)`` runs at unlimited run a, so it ages out
    at the first a with ``full_rank(a) - threshold(a) >= full_rank(s)``. The running
    maximum of the left side says which ranks each run is the first to reach.
    """
    threshold = F.greatest(
        F.coalesce("missing_threshold", F.lit(fixed.DEFAULT_MISSING_THRESHOLD)), F.lit(1)
    )
    by_site = Window.partitionBy("site_id").orderBy("run_no")
    so_far = by_site.rowsBetween(Window.unboundedPreceding, 0)
    before = by_site.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("site_id")
    axis = (
        runs.withColumn("full", ~F.coalesce("limited", F.lit(False)))
        .withColumn("full_rank", F.sum(F.col("full").cast("int")).over(so_far))
        .withColumn("reach", F.when(F.col("full"), F.col("full_rank") - threshold))
        .withColumn("reached", F.greatest(F.max("reach").over(before), F.lit(-1)))
        .withColumn("site_full_rank", F.max("full_rank").over(whole))
        .withColumn("site_full_ts", F.max(F.when(F.col("full"), F.col("run_ts"))).over(whole))
    )
    first_reach = (
        axis.where(F.col("reach") > F.col("reached"))
        .withColumn("full_rank", F.explode(F.sequence(F.col("reached") + 1, F.col("reach"))))
        .select(
            "site_id", "full_rank",
            F.col("run_no").alias("ages_no"), F.col("run_id").alias("ages_run_id"),
            F.col("run_ts").alias("ages_ts"),
        )
    )
    return axis.drop("reach", "reached").join(first_reach, ["site_id", "full_rank"], "left")


def sightings(observations: DataFrame, runs: DataFrame) -> DataFrame:
    """One hashed row per product and run, with the state it met.

    ``runs``: ``site_id, run_id, run_no, run_ts, limited, missing_threshold``.
    """
    axis = run_axis(runs).select(
        "site_id", "run_id", "run_no", "run_ts", "full_rank", "ages_no", "ages_ts",
        "site_full_rank", "site_full_ts",
    )
    observed = changes.incoming(observations).drop("run_ts")
    steps = lookup(
        observed, axis, ["site_id", "run_id"], "inner", ["canonical_url"]
    )
    w = Window.partitionBy(*KEY).orderBy("run_no")
    before = F.struct("content_hash", "current_price", "availability", "ages_no", "run_no")
    aged = F.col("prev.ages_no") < F.col("run_no")
    return (
        steps.withColumn("prev", F.lag(before).over(w))
        .withColumn("next_no", F.lead("run_no").over(w))
        .withColumn("first_ts", F.first("run_ts").over(w))
        .withColumn(
            "change_status",
            changes.change_status(F.col("prev.content_hash"), F.col("content_hash")),
        )
        .withColumn("old_price", F.col("prev.current_price"))
        .withColumn(
            "old_availability",
            F.when(F.coalesce(aged, F.lit(False)), F.lit("unavailable")).otherwise(
                F.col("prev.availability")
            ),
        )
        .withColumn("was_stored", F.col("prev").isNotNull())
        .withColumn("last_seen_at", F.col("run_ts"))
        .drop("prev")
    )


def final_state(seen: DataFrame) -> DataFrame:
    """State after the last run, from :func:`sightings`."""
    last = seen.where(F.col("next_no").isNull())
    misses = F.col("site_full_rank") - F.col("full_rank")
    aged = F.col("ages_no").isNotNull()
    values = {
        "availability": F.when(aged, F.lit("unavailable")).otherwise(F.col("availability")),
        "first_seen_at": F.col("first_ts"),
        "created_at": F.col("first_ts"),
        "last_scraped_at": F.col("run_ts"),
        "last_seen_at": F.col("run_ts"),
        "unavailable_since": F.col("ages_ts"),
        "consecutive_missing_runs": misses,
        "updated_at": F.when(misses > 0, F.col("site_full_ts")).otherwise(F.col("run_ts")),
    }
    return last.select(
        *[values.get(n, F.col(n)).cast(kind).alias(n) for n, kind in PRODUCTS.items()]
    )


def missing_spells(seen: DataFrame, runs: DataFrame) -> DataFrame:
    """Every stretch of unlimited runs a product was missing from.

    One row per sighting followed by at least one missed run: how many were missed
    before the next sighting (or the end) and when the product became unavailable.
    """
    ranks = run_axis(runs).select(
        "site_id", F.col("run_no").alias("next_no"),
        (F.col("full_rank") - F.col("full").cast("int")).alias("rank_before_next"),
    )
    ended = lookup(
        seen, ranks, ["site_id", "next_no"], "left", ["canonical_url"]
    )
    misses = F.coalesce("rank_before_next", "site_full_rank") - F.col("full_rank")
    in_time = F.col("next_no").isNull() | (F.col("ages_no") < F.col("next_no"))
    return ended.withColumn("missed_runs", misses).where("missed_runs > 0").select(
        *KEY, F.col("run_no").alias("last_seen_no"), "next_no",
        F.col("missed_runs").cast("int").alias("missed_runs"),
        F.when(in_time, F.col("ages_no")).alias("unavailable_from_no"),
        F.when(in_time, F.col("ages_ts")).alias("unavailable_since"),
    )


def unavailable_by_run(seen: DataFrame, runs: DataFrame) -> DataFrame:
    """Unavailable stock at each run: +1 where a spell ages out, -1 at the next sighting.

    The changes are summed per run before anything is ordered, so the running sum goes
    over the run table only. Limited runs report 0.
    """
    aged = seen.where(
        F.col("ages_no").isNotNull()
        & (F.col("next_no").isNull() | (F.col("ages_no") < F.col("next_no")))
    )
    steps = aged.select(
        "site_id",
        F.explode(
            F.array(
                F.struct(F.col("ages_no").alias("run_no"), F.lit(1).alias("d")),
                F.struct(F.col("next_no").alias("run_no"), F.lit(-1).alias("d")),
            )
        ).alias("s"),
    ).select("site_id", "s.run_no", "s.d")
    per_run = steps.where("run_no is not null").groupBy("site_id", "run_no").agg(
        F.sum("d").alias("d")
    )
    w = Window.partitionBy("site_id").orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        runs.join(per_run, ["site_id", "run_no"], "left")
        .withColumn("stock", F.sum(F.coalesce("d", F.lit(0))).over(w))
        .select(
            "site_id", "run_id", "run_no",
            F.when(F.coalesce("limited", F.lit(False)), F.lit(0))
            .otherwise(F.col("stock"))
            .cast("bigint")
            .alias("unavailable"),
        )
    )
