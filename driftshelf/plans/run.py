"""The run job: saved pages (or observations) of one run per site, folded into the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..operators import changes, children, discovery, ledger, quality, reports
from ..operators.keyed import lookup
from ..schemas import MERGED_EXTRA, RELATIONS, RUN_ITEMS, RUN_ROWS
from ..sinks.tables import CatalogTables
from ..sources import adapters, records

CHILDREN = {
    "specifications": children.specification_rows,
    "reviews": children.review_rows,
    "relations": children.relation_rows,
    "variants": children.variant_rows,
}


def _entry_overflow(field: str, value: str, kind: str):
    broken = F.exists(
        field, lambda x: x[value].isNotNull() & x[value].try_cast(kind).isNull()
    )
    return f"{field}_{value}_overflow", broken


def record_checks() -> list:
    """What the store would refuse in an observation."""
    return [
        quality.required("canonical_url"),
        quality.fits("current_price", "decimal(14,2)"),
        quality.fits("original_price", "decimal(14,2)"),
        quality.fits("rating", "decimal(4,2)"),
        _entry_overflow("reviews", "rating", "decimal(3,2)"),
        _entry_overflow("relations", "price", RELATIONS["related_price"]),
        _entry_overflow("variants", "price", "decimal(14,2)"),
        ("relation_type_domain", F.exists(
            "relations", lambda r: ~r["type"].isin(*fixed.RELATION_TYPES))),
    ]


def with_options(runs: DataFrame) -> DataFrame:
    """Run columns from the run's JSON options: a product limit makes a run limited (0 and
    absent mean none), and the missing threshold defaults."""
    options = F.try_parse_json("options")
    limit = F.coalesce(F.try_variant_get(options, "$.max_products", "bigint"), F.lit(0))
    threshold = F.try_variant_get(options, "$.missing_threshold", "int")
    return runs.withColumns(
        {
            "limited": limit > 0,
            "max_products": limit,
            "missing_threshold": F.coalesce(threshold, F.lit(fixed.DEFAULT_MISSING_THRESHOLD)),
        }
    )


def known_sites(sites: DataFrame, site_ids: list[int]) -> DataFrame:
    """The enabled sites asked for; a run of any other is an error."""
    mine = sites.where(F.col("site_id").isin(site_ids) & F.col("enabled"))
    missing = set(site_ids) - {r.site_id for r in mine.select("site_id").toLocalIterator()}
    if missing:
        raise ValueError(f"unknown or disabled site: {', '.join(map(str, sorted(missing)))}")
    return mine


def limit_of(runs: DataFrame, limits: set) -> int | DataFrame | None:
    """The product limit of a batch: none, one for all, or one per site."""
    limits = {n or 0 for n in limits}
    if limits == {0}:
        return None
    return limits.pop() if len(limits) == 1 else runs.select("site_id", "max_products")


def plan_items(
    tables: CatalogTables, version: str, runs: DataFrame, run_ids: list[int],
    discovered: DataFrame | None, fresh_runs: DataFrame,
) -> DataFrame:
    """The batch's ledger rows, claimed. Discovery only adds to the runs that have none yet."""
    now = F.col("_now")
    clock = runs.select("run_id", F.col("run_ts").alias("_now"))
    stored = tables.of_runs("run_items", run_ids).select(*RUN_ITEMS)
    items = ledger.requeue(stored, runs, F.lit(None).cast("timestamp"))
    if discovered is not None:
        urls = (
            lookup(discovered, fresh_runs.join(runs.select("run_id"), "run_id").select("site_id", "run_id"), ["site_id"], "inner", ["product"])
            .orderBy("site_id", "product")
            .select(
                "run_id", F.col("product").alias("url"),
                F.monotonically_increasing_id().alias("item_seq"),
            )
        )
        urls = tables.write_plain("_discovered", urls, version)
        items = ledger.enqueue(items, urls, F.lit(None).cast("timestamp"))
    timed = lookup(items, clock, ["run_id"], "inner", spread=["url"])
    waiting = ledger.reset_interrupted(timed, now)
    claimed = ledger.claim(waiting, now)
    return tables.write_plain("_claimed", claimed.select(*RUN_ITEMS), version)


def run_batch(
    tables: CatalogTables,
    version: str,
    sites: DataFrame,
    runs: DataFrame,
    pages: DataFrame | None = None,
    listing: DataFrame | None = None,
    observations: DataFrame | None = None,
    max_products: int | None = None,
    start: DataFrame | None = None,
    tracked: Sequence[str] = fixed.TRACKED_FIELDS,
    earlier: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """Fold one run per site into the published tables; returns the run rows.

    ``runs``: ``run_id, site_id, run_ts, run_type, status`` and ``limited,
    missing_threshold`` or the JSON ``options`` they follow from. Completed and cancelled
    runs are left alone; one completed with errors or failed is resumed. A run of an
    unknown or disabled site is an error before anything is written. ``listing``: saved
    listing pages; ``pages``: saved product pages of the runs; or ``observations`` made
    elsewhere (with ``url``, and the error columns of `sources.feeds` if some failed). ``start``: saved start pages (``site_id, url, html``); then which
    listing pages are read, and in which order, follows from their links. ``max_products``, of the batch or of the run's options,
    limits discovery, and such a run
    ages nothing out. ``tracked``: the fields of the content hash; where they were others, ``earlier`` lists
    those, and a product is compared over the fields its stored hash was taken over.
    A run that meets a listing page without cards, or a blocked one, ends as ``failed``, its site's state untouched.
    Stages that feed several outputs are written under the version and read back, so a
    lost executor re-reads files instead of recomputing, and a version that was already
    published is left alone. Only buckets that hold a product of the batch are read and
    written, all of a site's products where its run ages some. If another batch publishes one
    of the sites in the meantime, PublicationConflict is raised and nothing is changed.
    """
    tables.refresh()
    if tables.is_published(version):
        return tables.written("runs", version)
    given = [r.run_id for r in runs.select("run_id").toLocalIterator()]
    if "options" in runs.columns:
        runs = with_options(runs)
    if max_products is not None or "max_products" not in runs.columns:
        runs = runs.withColumn("max_products", F.lit(max_products).cast("bigint"))
    runs = ledger.resumable(runs).withColumn(
        "limited", F.col("limited") | (F.coalesce("max_products", F.lit(0)) > 0)
    )
    batch = list(runs.select("site_id", "run_id", "max_products", F.coalesce("limited", F.lit(False)).alias("limited")).toLocalIterator())
    if not batch:
        return tables.of_runs("runs", given)
    site_ids, run_ids = [r.site_id for r in batch], [r.run_id for r in batch]
    if len(set(site_ids)) != len(site_ids):
        raise ValueError("a batch takes at most one run per site")

    mine = known_sites(sites, site_ids)
    names = adapters.styles_of(mine)
    limit = limit_of(runs, {r.max_products for r in batch})
    discovered, lost = None, []
    known = tables.of_runs("runs", run_ids).where(reports.discovery_done(F.col("checkpoint"))).select("run_id")
    begun = known.union(tables.of_runs("run_items", run_ids).select("run_id")).distinct()
    fresh = runs.join(begun, "run_id", "left_anti").select("site_id", "run_id")
    if listing is not None:
        listing = adapters.with_adapter(listing, mine)
        if start is not None:
            listing = adapters.order_listing(listing, adapters.with_adapter(start, mine), names)
        links = adapters.read_listing(listing, names)
        links = tables.write_plain("_listing", links, version)
        seeds = adapters.seeds_of(adapters.configured_seeds(mine), names)
        discovered = discovery.discover(links.where("error is null").drop("error"), limit, seeds)
        lost = discovery.first_errors(links, limit).join(fresh.select("site_id"), "site_id").collect()  # a row per failed run
    elif observations is not None or pages is not None:
        source = observations if observations is not None else pages
        discovered = source.select("site_id", F.col("url").alias("product")).distinct()
        if limit:
            discovered = discovery.lowest(discovered, limit)

    errors = tables.spark.createDataFrame([tuple(r) for r in lost], "site_id bigint, run_error string")
    every_run = runs.join(F.broadcast(errors), "site_id", "left")  # at most one row per run of the batch
    failed = {r.site_id for r in lost}
    site_ids = [s for s in site_ids if s not in failed]
    runs = runs.where(F.col("site_id").isin(site_ids))
    items = plan_items(tables, version, runs, run_ids, discovered, fresh)
    claimed = items.where(F.col("status") == "processing").select("run_id", "url", "item_seq")

    if observations is None:
        extracted = adapters.extract(adapters.with_adapter(pages, mine).drop("page_limit"), names)
    else:
        none = F.lit(None).cast("string")
        lacking = [c for c in records.ERRORS if c not in observations.columns]
        extracted = observations.withColumns(dict.fromkeys(lacking, none))
    wanted = extracted.drop("item_seq").join(claimed, ["run_id", "url"])
    extracted = tables.write_plain("_extracted", wanted, version)

    accepted, outcomes = judge(tables, version, site_ids, claimed, extracted)
    steps = tables.write_plain("_accepted", changes.in_order(accepted, tracked, earlier), version)
    good = steps.where("last").drop("last", "previous")

    folded = tables.publications().where("site_id is not null").select("run_id").distinct()
    aging = runs.join(folded.withColumn("aged", F.lit(True)), "run_id", "left")

    touched = children.products_of(good)
    held = tables.touched(touched)
    every = list(range(tables.buckets))
    aged = {r.site_id: held.get(r.site_id, []) if r.limited else every for r in batch if r.site_id in site_ids}
    state = tables.state("products", buckets=aged)
    merged = changes.merge(state, changes.with_defaults(good), aging)
    tables.write("products", merged, version)
    merged = tables.written("products", version, MERGED_EXTRA)
    done = tables.write_plain("_done", changes.items_of(steps, merged), version)
    tables.write("price_history", changes.price_changes_of(done), version)
    tables.write("availability_history", changes.availability_changes_of(done), version)

    images = children.image_rows(children.entries(good, "images"))
    stored = tables.state("product_images", buckets=held)
    tables.write("product_images", children.sync_images(stored, images, touched), version)
    for field, rows in CHILDREN.items():
        table = f"product_{field}"
        fresh = rows(children.entries(good, field))
        stored = tables.state(table, buckets=held)
        tables.write(table, children.replace(stored, fresh, touched), version)

    run_rows = close_ledger(tables, version, sites, every_run, run_ids, items, done, outcomes, merged)
    tables.publish([(None if r.site_id in failed else r.site_id, r.run_id) for r in batch], version, aged, held)
    return run_rows


def judge(tables, version, site_ids, claimed, extracted) -> tuple[DataFrame, DataFrame]:
    """Accepted observations, and the outcomes of all others."""
    checked = quality.checked(records.records(extracted.withColumn("_url", F.col("url"))),
                              record_checks())
    sound = quality.good(checked)
    owned = tables.state("products", site_ids).select("site_id", "external_id", "canonical_url")
    claims = quality.second_claims(
        sound, owned, ["site_id"], "external_id", "canonical_url", "item_seq"
    )
    claims = quality.free_released(
        tables.write_plain("_claims", claims, version), owned,
        ["site_id"], "external_id", "canonical_url", "item_seq",
    )
    good = claims.where(~F.col("taken")).drop("taken").withColumnRenamed("_url", "url")
    refused = quality.quarantine(checked).select(
        "run_id", F.col("_url").alias("url"), F.lit("failed").alias("status"),
        F.lit("constraint").alias("error_type"),
        F.array_join("violations", ", ").alias("error_message"),
    )
    taken = claims.where("taken").select(
        "run_id", F.col("_url").alias("url"), F.lit("failed").alias("status"),
        F.lit("constraint").alias("error_type"),
        F.concat(F.lit("external_id already belongs to another URL: "), "external_id").alias(
            "error_message"
        ),
    )
    lost = claimed.join(extracted.select("run_id", "url"), ["run_id", "url"], "left_anti").select(
        "run_id", "url", F.lit("failed").alias("status"),
        F.lit("navigation_failed").alias("error_type"),
        F.lit("no saved page").alias("error_message"),
    )
    failed = records.failed_pages(extracted)
    return good, failed.unionByName(refused).unionByName(taken).unionByName(lost)


def close_ledger(tables, version, sites, runs, run_ids, items, done, failed, merged) -> DataFrame:
    """Item outcomes, failed-URL log, run rows with counters and summary.

    ``done``: the accepted items (:func:`changes.items_of`); ``runs`` with ``run_error``.
    """
    result = F.to_json(F.struct(
        "canonical_url", F.col("change_status").alias("status"), "content_hash"))
    none = F.lit(None).cast("string")
    done = done.select(
        "run_id", "url", F.col("change_status").alias("status"), none.alias("error_type"),
        none.alias("error_message"), result.alias("result"),
    )
    outcomes = tables.write_plain(
        "_outcomes", done.unionByName(failed.withColumn("result", none)), version
    )
    closed = ledger.record_outcomes(items, outcomes, F.col("updated_at"))
    closed = lookup(closed, runs.select("run_id", "site_id"), ["run_id"], "inner", ["url"])
    tables.write("run_items", closed, version)
    closed = tables.written("run_items", version)

    failures = ledger.failures(outcomes, runs)
    log = ledger.log_failures(
        tables.of_runs("failed_urls", run_ids), failures, F.col("new.run_ts")
    )
    tables.write("failed_urls", log, version)

    discovered = closed.groupBy("run_id").agg(F.count("*").alias("products_discovered"))
    rows = (
        reports.counted_runs(reports.with_site(runs.drop("status"), sites), reports.run_counters(closed))
        .join(changes.unavailable_of(merged), "site_id", "left")
        .join(discovered, "run_id", "left")
        .withColumn("products_discovered", F.coalesce("products_discovered", F.lit(0)))
        .withColumn("products_unavailable", F.coalesce("unavailable", F.lit(0)))
        .withColumn("status", F.when(F.col("run_error").isNotNull(), "failed").otherwise(
            reports.final_status(F.col("errors"))))
        .withColumn("completed_at", F.col("run_ts"))
    )
    rows = reports.run_checkpoint(reports.run_summary(reports.product_counters(rows)))
    tables.write(
        "runs",
        rows.select(*[F.col(n).cast(kind).alias(n) for n, kind in RUN_ROWS.items()]),
        version,
    )
    return tables.written("runs", version)


def export_run(tables: CatalogTables, sites: DataFrame, runs: DataFrame) -> DataFrame:
    """Export rows of the catalog of each run's site."""
    return reports.export_rows(tables.state("products"), sites, runs)
