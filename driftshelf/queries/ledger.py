"""Run ledger, summaries, exports and quality checks: orders as items, customers as runs,
nations as sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..operators import discovery, ledger, quality, reports
from ..operators.keyed import lookup
from ..operators.sites import upsert_sites
from ..plans import views
from ..sources import tables
from ..sources.tables import table

_T = "2024-03-01 00:00:00"


def _now() -> Column:
    return F.lit(_T).cast("timestamp")


def _stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def enqueue_new(spark: SparkSession, d: str) -> DataFrame:
    """The ledger holds the finished orders; all orders, each listed twice, are discovered."""
    items = views.order_items(spark, d).where(F.col("status").isin("new", "failed", "blocked", "skipped"))
    every = views.order_items(spark, d).select("run_id", "url", "item_seq")
    twice = every.unionByName(every.withColumn("item_seq", F.col("item_seq") + 1_000_000_000))
    return ledger.enqueue(items, twice, _now()).select(
        "run_id", "url", "item_seq", "status", _big("attempts"), _stamp("updated_at")
    )


def pending_items(spark: SparkSession, d: str) -> DataFrame:
    """What is left to do, in run order."""
    rows = ledger.pending(views.order_items(spark, d))
    return rows.select("run_id", "url", "item_seq", _big("attempts"))


def ledger_claim(spark: SparkSession, d: str) -> DataFrame:
    """Interrupted items return to pending, then the whole batch is claimed."""
    items = ledger.reset_interrupted(views.order_items(spark, d), _now())
    return ledger.claim(items, _now()).select(
        "run_id", "url", "status", _big("attempts"), _stamp("started_at"), _stamp("updated_at")
    )


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the items under way: even priorities fail, the rest succeed."""
    items = views.order_items(spark, d).where(F.col("status").isin("processing", "failed"))
    rank = F.col("attempts")
    return items.select(
        "run_id", "url",
        F.when(rank == 2, "blocked").when(F.col("status") == "failed", "failed")
        .otherwise("updated").alias("status"),
        F.lit("timeout").alias("error_type"),
        F.repeat(F.concat(F.lit("no answer from "), "url", F.lit("; ")), 150).alias("error_message"),
        F.to_json(F.struct("url")).alias("result"),
    )


def ledger_outcomes(spark: SparkSession, d: str) -> DataFrame:
    done = ledger.record_outcomes(views.order_items(spark, d), _outcomes(spark, d), _now())
    return done.select(
        "run_id", "url", "status", "error_type", F.md5("error_message").alias("message_md5"),
        F.coalesce(F.length("error_message"), F.lit(0)).cast("bigint").alias("message_length"),
        "result", _stamp("completed_at"), _stamp("updated_at"),
    )


def failed_url_log(spark: SparkSession, d: str) -> DataFrame:
    """The log holds the failed orders; this batch's failures add new rows and retries."""
    runs = views.customer_runs(spark, d)
    none = F.lit(None).cast("timestamp")
    before = ledger.failures(
        views.order_items(spark, d).where("status = 'failed' and attempts = 1"), runs
    ).select(
        "site_id", "run_id", "url", "error_type", "error_message",
        F.lit(3).alias("retry_count"), none.alias("last_retry_at"), F.col("run_ts").alias("updated_at"),
    )
    failed = ledger.failures(_outcomes(spark, d), runs)
    log = ledger.log_failures(before, failed, _now())
    return log.select(
        "site_id", "run_id", "url", "error_type",
        F.length("error_message").cast("bigint").alias("message_length"), _big("retry_count"),
        _stamp("last_retry_at"), _stamp("updated_at"),
    )


def requeue_failed(spark: SparkSession, d: str) -> DataFrame:
    """Resume: failed items of runs completed with errors are pending again."""
    items = ledger.requeue(views.order_items(spark, d), views.customer_runs(spark, d), _now())
    return items.select("run_id", "url", "status", _stamp("completed_at"), _stamp("updated_at"))


def resumed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run after a resume, and whether a batch would process it now."""
    runs = views.customer_runs(spark, d)
    resumed = ledger.resume_runs(runs)
    todo = ledger.unfinished(resumed).select("run_id", F.lit(True).alias("to_process"))
    can = ledger.resumable(runs).select("run_id", F.lit(True).alias("resumable"))
    return resumed.join(todo, "run_id", "left").join(can, "run_id", "left").select(
        "run_id", "status", _stamp("completed_at"),
        F.coalesce("to_process", F.lit(False)).alias("to_process"),
        F.coalesce("resumable", F.lit(False)).alias("resumable"),
    )


def item_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.item_counts(views.order_items(spark, d))


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    counters = reports.run_counters(views.order_items(spark, d))
    return counters.withColumn("last_item_seq", F.coalesce("last_item_seq", F.lit(-1)))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """Runs with site, counters and the report columns."""
    items = views.order_items(spark, d)
    runs = reports.with_site(views.customer_runs(spark, d), views.nation_sites(spark, d))
    counted = reports.counted_runs(runs, reports.run_counters(items))
    found = items.groupBy("run_id").agg(F.count_distinct("url").alias("products_discovered"))
    counted = reports.product_counters(counted.join(found, "run_id", "left"))
    return counted.withColumns(
        {
            "products_discovered": F.coalesce("products_discovered", F.lit(0)),
            "products_unavailable": F.lit(0).cast("bigint"),
            "run_error": F.when(F.col("status") == "failed", F.lit("lost")).cast("string"),
            "started_at": F.col("run_ts"),
            "summary": F.lit("{}"),
        }
    )


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Status and summary object of every run that was under way."""
    counted = _counted(spark, d)
    ended = F.when(F.col("status") == "failed", F.col("status")).otherwise(
        reports.final_status(F.col("errors"))
    )
    return reports.run_summary(counted.withColumn("status", ended)).select(
        "run_id", "site_code", "status", "processed", "errors", "summary"
    )


def run_overview(spark: SparkSession, d: str) -> DataFrame:
    """The view over all runs; it is not limited to the latest."""
    reports.run_overview(_counted(spark, d)).createOrReplaceTempView("latest_run_summary")
    rows = spark.table("latest_run_summary")
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "completed_at")})


def run_status(spark: SparkSession, d: str) -> DataFrame:
    """Status report: the run, its site, and its items per status."""
    return _counted(spark, d).select(
        "run_id", "site_code", "site_name", "base_url", "adapter", "run_type", "status",
        F.to_json(reports.status_map()).alias("items"),
    )


def run_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.success_report(_counted(spark, d), "http://localhost:5000")


def failure_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.failure_report(reports.run_summary(_counted(spark, d)))


def run_updates(spark: SparkSession, d: str) -> DataFrame:
    """Allowed columns of running runs are set; the site is not an allowed column."""
    values = {"status": F.lit("failed"), "errors": F.col("errors") + 1, "site_code": F.lit("x"),
              "checkpoint": F.struct(F.lit(True).alias("discovery_complete"), F.col("processed").cast("bigint").alias("processed"))}
    runs = reports.run_checkpoint(_counted(spark, d))
    rows = reports.update_runs(runs, values, F.col("status") == "running")
    return rows.select("run_id", "status", "errors", "site_code", "checkpoint")


def present_urls(spark: SparkSession, d: str) -> DataFrame:
    """Present URLs of every run, with the site code where the site is enabled."""
    present = ledger.present_urls(views.order_items(spark, d))
    runs = views.customer_runs(spark, d).select("run_id", "site_id")
    sited = lookup(present, runs, ["run_id"], "inner", ["url"])
    enabled = views.nation_sites(spark, d).where("enabled").select("site_id", "code")
    return lookup(sited, enabled, ["site_id"], "inner", ["url"]).select("run_id", "url", "code")


def unknown_sites(spark: SparkSession, d: str) -> DataFrame:
    """Codes asked for that name no enabled site: one per segment and nation in use."""
    wanted = table(spark, d, "customer").select(
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("code")
    ).unionByName(
        table(spark, d, "customer").select(F.lower("c_mktsegment").alias("code"))
    ).distinct()
    return tables.unknown_sites(wanted, views.nation_sites(spark, d))


def site_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Site dimension keyed by code: regions come in as sites, nations are renamed."""
    sites = views.nation_sites(spark, d)
    seed = sites.select(
        F.col("code"), F.concat("name", F.lit("!")).alias("name"), "base_url", "adapter",
        F.lit('{"delay":2}').alias("settings"), F.lit(0).cast("bigint").alias("site_id"),
    ).where("adapter <> 'asia'")
    extra = table(spark, d, "region").select(
        F.lower("r_name").alias("code"), F.col("r_name").alias("name"),
        F.lit("https://r.example").alias("base_url"), F.lit("none").alias("adapter"),
        F.lit("{}").alias("settings"), (F.col("r_regionkey") + 100).cast("bigint").alias("site_id"),
    )
    merged = upsert_sites(sites, seed.unionByName(extra), _now())
    return merged.select(
        "code", "site_id", "name", "base_url", "adapter", "enabled", "settings",
        _stamp("created_at"), _stamp("updated_at"),
    )


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """Catalog of the sites of some runs: parts as products of five region sites."""
    products = table(spark, d, "part").select(
        (F.col("p_size") % 5).cast("bigint").alias("site_id"),
        views.part_url(F.col("p_partkey")).alias("canonical_url"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").cast("decimal(14,2)").alias("current_price"),
        F.array("p_brand", "p_type").alias("highlights"),
        F.lit(_T).cast("timestamp").alias("last_seen_at"),
    )
    sites = table(spark, d, "region").select(
        F.col("r_regionkey").cast("bigint").alias("site_id"), F.lower("r_name").alias("code")
    )
    runs = views.customer_runs(spark, d).where("status = 'completed'").select("run_id", "site_id")
    rows = reports.export_rows(products, sites, runs)
    return rows.withColumn("highlights", F.to_json("highlights")).orderBy("site_id", "canonical_url")


def domain_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Orders as observations with bad values: domains, nulls, overflow, shared ids."""
    rank = F.substring("o_orderpriority", 1, 1)
    rows = table(spark, d, "orders").select(
        F.lit(1).cast("bigint").alias("site_id"),
        views.order_url().alias("canonical_url"),
        "o_orderkey",
        F.when(rank == "1", "weekly").when(rank == "2", "full").otherwise("incremental").alias("run_type"),
        F.when(F.col("o_orderstatus") == "P", "lost").otherwise("new").alias("status"),
        F.when(F.col("o_totalprice") > 1000, F.lit("Order")).alias("title"),
        F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("rating"),
        F.when(rank != "5", F.concat(F.lit("E"), F.col("o_custkey").cast("string"))).alias("external_id"),
    )
    checks = [
        quality.in_domain("run_type", fixed.RUN_TYPES),
        quality.in_domain("status", fixed.ITEM_STATUSES),
        quality.required("title"),
        quality.fits("rating", "decimal(7,2)"),
    ]
    checked = quality.checked(rows, checks)
    claims = quality.second_claims(
        quality.good(checked), None, ["site_id"], "external_id", "canonical_url", "o_orderkey"
    )
    refused = quality.quarantine(checked).select(
        "o_orderkey", F.array_join("violations", ",").alias("violations")
    )
    taken = claims.where("taken").select("o_orderkey", F.lit("external_id_taken").alias("violations"))
    kept = claims.where("not taken").select("o_orderkey", F.lit("").alias("violations"))
    return reduce(DataFrame.unionByName, [refused, taken, kept])


def orphan_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose parent is not there, per edge."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    rich = table(spark, d, "customer").where("c_acctbal > 1000")
    small = table(spark, d, "part").where("p_size <= 40")
    done = o.where("o_orderstatus <> 'P'")
    edges = [
        quality.orphans(o, rich, {"o_custkey": "c_custkey"}, "item_run"),
        quality.orphans(line, small, {"l_partkey": "p_partkey"}, "child_product"),
        quality.orphans(line, done, {"l_orderkey": "o_orderkey"}, "log_run"),
    ]
    return reduce(DataFrame.unionByName, edges)


def _line_links(spark: SparkSession, d: str, site: Column) -> DataFrame:
    return table(spark, d, "lineitem").select(
        site.cast("bigint").alias("site_id"), F.col("l_returnflag").alias("category"),
        F.col("l_linenumber").alias("page_no"), views.part_url(F.col("l_partkey")).alias("product"),
    )


def discover_limit(spark: SparkSession, d: str) -> DataFrame:
    """Two sites' parts, read page by page until 1500 are found."""
    site = F.when(F.col("l_linestatus") == "F", 1).otherwise(2)
    return discovery.discover(_line_links(spark, d, site), 1500)


def discover_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sites, 520 products each; customers seed the sites that fall short."""
    seeds = table(spark, d, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("site_id"),
        F.concat(F.lit(f"{views.SHOP}/dp/"), views.part_code(F.col("c_custkey"), "C")).alias("product"),
    )
    return discovery.discover(_line_links(spark, d, F.col("l_suppkey")), 520, seeds)


def discover_all(spark: SparkSession, d: str) -> DataFrame:
    """Without a limit every listed product is found: counted per site."""
    found = discovery.discover(_line_links(spark, d, F.col("l_suppkey")))
    return discovery.discovered_counts(found)


QUERIES = {
    f.__name__: f
    for f in (
        enqueue_new, pending_items, ledger_claim, ledger_outcomes, failed_url_log, requeue_failed,
        resumed_runs, item_counts, run_counters, run_summary, run_overview, run_status, run_report,
        failure_report, run_updates, present_urls, unknown_sites, site_upsert, export_rows,
        domain_quarantine, orphan_audit, discover_limit, discover_seeds, discover_all,
    )
}

_ITEMS = """
items AS (
  SELECT o_custkey AS run_id, 'https://shop.example/o/' || o_orderkey AS url, o_orderkey AS item_seq,
         CAST(substring(o_orderpriority, 1, 1) AS BIGINT) AS attempts, o_orderdate AS d,
         CASE o_orderstatus
           WHEN 'F' THEN CASE substring(o_orderpriority, 1, 1)
             WHEN '1' THEN 'failed' WHEN '2' THEN 'blocked' WHEN '3' THEN 'skipped' ELSE 'new' END
           WHEN 'P' THEN CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') THEN 'processing' ELSE 'pending' END
           ELSE CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'updated' ELSE 'unchanged' END
         END AS status
  FROM orders)"""
_RUNS = """
runs AS (
  SELECT c_custkey AS run_id, CAST(c_nationkey AS BIGINT) AS site_id,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'full' ELSE 'incremental' END AS run_type,
         CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 1000 THEN 'cancelled'
              WHEN c_acctbal < 3000 THEN 'completed' WHEN c_acctbal < 7000 THEN 'completed_with_errors'
              WHEN c_acctbal < 8000 THEN 'running' ELSE 'pending' END AS status
  FROM customer)"""
_COUNTS = f"""{_ITEMS},{_RUNS},
tally AS (
  SELECT run_id, count(*) AS found,
         count(*) FILTER (WHERE status = 'pending') AS n_pending,
         count(*) FILTER (WHERE status = 'processing') AS n_processing,
         count(*) FILTER (WHERE status = 'new') AS n_new,
         count(*) FILTER (WHERE status = 'updated') AS n_updated,
         count(*) FILTER (WHERE status = 'unchanged') AS n_unchanged,
         count(*) FILTER (WHERE status = 'failed') AS n_failed,
         count(*) FILTER (WHERE status = 'blocked') AS n_blocked,
         count(*) FILTER (WHERE status = 'skipped') AS n_skipped,
         coalesce(max(item_seq) FILTER (WHERE status NOT IN ('pending', 'processing')), -1) AS last_item_seq
  FROM items GROUP BY run_id),
counted AS (
  SELECT r.run_id, r.run_type, r.status, lower(n_name) AS site_code, n_name AS site_name,
         'https://' || lower(n_name) || '.example' AS base_url, lower(r_name) AS adapter,
         coalesce(found, 0) AS found, coalesce(n_new, 0) AS n_new, coalesce(n_updated, 0) AS n_updated,
         coalesce(n_unchanged, 0) AS n_unchanged,
         coalesce(n_failed + n_blocked, 0) AS errors,
         coalesce(n_new + n_updated + n_unchanged + n_failed + n_blocked + n_skipped, 0) AS processed,
         '{{' || array_to_string(list_filter([
           CASE WHEN n_pending > 0 THEN '"pending":' || n_pending END,
           CASE WHEN n_processing > 0 THEN '"processing":' || n_processing END,
           CASE WHEN n_new > 0 THEN '"new":' || n_new END,
           CASE WHEN n_updated > 0 THEN '"updated":' || n_updated END,
           CASE WHEN n_unchanged > 0 THEN '"unchanged":' || n_unchanged END,
           CASE WHEN n_failed > 0 THEN '"failed":' || n_failed END,
           CASE WHEN n_blocked > 0 THEN '"blocked":' || n_blocked END,
           CASE WHEN n_skipped > 0 THEN '"skipped":' || n_skipped END], lambda x: x IS NOT NULL), ',') || '}}' AS items
  FROM runs r JOIN nation ON n_nationkey = r.site_id JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN tally t USING (run_id))"""
_SUMMARY = """
CASE WHEN {status} = 'failed'
  THEN '{{"run_id":' || run_id || ',"site":"' || site_code || '","run_type":"' || run_type
       || '","status":"failed","error":"lost","resumable":true}}'
  ELSE '{{"run_id":' || run_id || ',"site":"' || site_code || '","run_type":"' || run_type
       || '","status":"' || {status} || '","items":' || items || ',"unavailable":0,"resumable":true}}' END"""
_FINAL = ("CASE WHEN status = 'failed' THEN 'failed' WHEN errors > 0 THEN 'completed_with_errors' "
          "ELSE 'completed' END")
_OUTCOMES = """
outcomes AS (
  SELECT run_id, url, CASE WHEN attempts = 2 THEN 'blocked' WHEN status = 'failed' THEN 'failed' ELSE 'updated' END AS out,
         repeat('no answer from ' || url || '; ', 150) AS message
  FROM items WHERE status IN ('processing', 'failed'))"""
_DISCOVERY = """
firsts AS (
  SELECT site_id, product, min((l_returnflag, l_linenumber)) AS page FROM links GROUP BY ALL),
pages AS (SELECT site_id, page, count(*) AS added FROM firsts GROUP BY ALL),
running AS (SELECT *, sum(added) OVER (PARTITION BY site_id ORDER BY page) AS total FROM pages),
cuts AS (SELECT site_id, min(page) AS cut FROM running WHERE total >= {limit} GROUP BY ALL),
found AS (
  SELECT f.site_id, f.product FROM firsts f LEFT JOIN cuts c USING (site_id)
  WHERE c.cut IS NULL OR f.page <= c.cut)"""

SQL = {
    "enqueue_new": f"""
WITH {_ITEMS}
SELECT run_id, url, item_seq, CASE WHEN status IN ('new', 'failed', 'blocked', 'skipped') THEN status ELSE 'pending' END AS status,
       CASE WHEN status IN ('new', 'failed', 'blocked', 'skipped') THEN attempts ELSE 0 END AS attempts,
       CASE WHEN status IN ('new', 'failed', 'blocked', 'skipped') THEN strftime(d, '%Y-%m-%d %H:%M:%S')
            ELSE '{_T}' END AS updated_at
FROM items""",
    "pending_items": f"""
WITH {_ITEMS}
SELECT run_id, url, item_seq, attempts FROM items WHERE status = 'pending' ORDER BY run_id, item_seq""",
    "ledger_claim": f"""
WITH {_ITEMS}
SELECT run_id, url, CASE WHEN status = 'pending' THEN 'processing' ELSE status END AS status,
       CASE WHEN status IN ('pending', 'processing') THEN attempts + 1 ELSE attempts END AS attempts,
       CASE WHEN attempts <> 5 THEN strftime(d, '%Y-%m-%d %H:%M:%S')
            WHEN status IN ('pending', 'processing') THEN '{_T}' END AS started_at,
       CASE WHEN status IN ('pending', 'processing') THEN '{_T}' ELSE strftime(d, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM items""",
    "ledger_outcomes": f"""
WITH {_ITEMS},{_OUTCOMES},
j AS (
  SELECT i.*, o.out, o.message, i.status IN ('failed', 'blocked') AS was_error, o.out IN ('failed', 'blocked') AS is_error
  FROM items i LEFT JOIN outcomes o USING (run_id, url)),
m AS (
  SELECT *, CASE WHEN is_error THEN message WHEN out IS NULL AND was_error THEN 'order ' || item_seq END AS text FROM j)
SELECT run_id, url, coalesce(out, status) AS status, CASE WHEN text IS NOT NULL THEN 'timeout' END AS error_type,
       md5(text) AS message_md5, CAST(coalesce(length(text), 0) AS BIGINT) AS message_length,
       CASE WHEN out = 'updated' THEN '{{"url":"' || url || '"}}' ELSE '{{}}' END AS result,
       CASE WHEN out IS NOT NULL THEN '{_T}' WHEN was_error THEN strftime(d, '%Y-%m-%d %H:%M:%S') END AS completed_at,
       CASE WHEN out IS NOT NULL THEN '{_T}' ELSE strftime(d, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM m""",
    "failed_url_log": f"""
WITH {_ITEMS},{_RUNS},{_OUTCOMES},
known AS (SELECT * FROM items WHERE status = 'failed' AND attempts = 1),
bad AS (SELECT * FROM outcomes WHERE out <> 'updated')
SELECT r.site_id, run_id, url, 'timeout' AS error_type,
       CAST(CASE WHEN b.url IS NOT NULL THEN length(b.message) ELSE length('order ' || k.item_seq) END AS BIGINT) AS message_length,
       CAST(CASE WHEN k.url IS NULL THEN 0 WHEN b.url IS NULL THEN 3 ELSE 4 END AS BIGINT) AS retry_count,
       CASE WHEN k.url IS NOT NULL AND b.url IS NOT NULL THEN '{_T}' END AS last_retry_at,
       CASE WHEN b.url IS NOT NULL THEN '{_T}' ELSE '2024-02-01 00:00:00' END AS updated_at
FROM known k FULL JOIN bad b USING (run_id, url) JOIN runs r USING (run_id)""",
    "requeue_failed": f"""
WITH {_ITEMS},{_RUNS},
j AS (
  SELECT i.*, r.status = 'completed_with_errors' AND i.status IN ('failed', 'blocked') AS again,
         i.status IN ('failed', 'blocked') AS was_error
  FROM items i LEFT JOIN runs r USING (run_id))
SELECT run_id, url, CASE WHEN again THEN 'pending' ELSE status END AS status,
       CASE WHEN was_error AND NOT again THEN strftime(d, '%Y-%m-%d %H:%M:%S') END AS completed_at,
       CASE WHEN again THEN '{_T}' ELSE strftime(d, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM j""",
    "resumed_runs": f"""
WITH {_RUNS}
SELECT run_id, CASE WHEN status IN ('completed', 'cancelled') THEN status ELSE 'pending' END AS status,
       CASE WHEN status IN ('completed', 'cancelled') THEN '2024-02-01 00:00:00' END AS completed_at,
       status NOT IN ('completed', 'cancelled') AS to_process, status NOT IN ('completed', 'cancelled') AS resumable
FROM runs""",
    "item_counts": f"WITH {_ITEMS} SELECT run_id, status, count(*) AS items FROM items GROUP BY ALL",
    "run_counters": f"""
WITH {_COUNTS}
SELECT run_id, n_pending, n_processing, n_new, n_updated, n_unchanged, n_failed, n_blocked, n_skipped,
       n_new + n_updated + n_unchanged + n_failed + n_blocked + n_skipped AS processed,
       n_failed + n_blocked AS errors, last_item_seq
FROM tally""",
    "run_summary": f"""
WITH {_COUNTS}, ended AS (SELECT * REPLACE ({_FINAL} AS status) FROM counted)
SELECT run_id, site_code, status, processed, errors, {_SUMMARY.format(status="status")} AS summary FROM ended""",
    "run_overview": f"""
WITH {_COUNTS}
SELECT run_id, site_code, run_type, status, found AS products_discovered, processed AS products_processed,
       n_new AS products_new, n_updated AS products_updated, n_unchanged AS products_unchanged,
       CAST(0 AS BIGINT) AS products_unavailable, errors, '2024-02-01 00:00:00' AS started_at,
       '2024-02-01 00:00:00' AS completed_at
FROM counted""",
    "run_status": f"""
WITH {_COUNTS}
SELECT run_id, site_code, site_name, base_url, adapter, run_type, status, items FROM counted""",
    "run_report": f"""
WITH {_COUNTS}
SELECT status, run_id, found AS discovered, n_new AS new, n_updated AS updated, n_unchanged AS unchanged,
       CAST(0 AS BIGINT) AS unavailable, errors,
       'http://localhost:5000/runs/' || run_id || '/export/json' AS json_export,
       'http://localhost:5000/runs/' || run_id || '/export/csv' AS csv_export
FROM counted WHERE status IN ('completed', 'completed_with_errors')""",
    "failure_report": f"""
WITH {_COUNTS}
SELECT status, run_id, {_SUMMARY.format(status="status")} AS details
FROM counted WHERE status IN ('failed', 'cancelled')""",
    "run_updates": f"""
WITH {_COUNTS}
SELECT run_id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status,
       CASE WHEN status = 'running' THEN errors + 1 ELSE errors END AS errors, site_code,
       CASE WHEN status = 'running' THEN '{{"discovery_complete":true,"processed":' || processed || '}}'
         WHEN status = 'failed' THEN '{{}}'
         WHEN processed = 0 THEN '{{"discovery_complete":true,"discovered_urls":' || found || '}}'
         ELSE '{{"discovery_complete":true,"last_item_id":' || last_item_seq || ',"processed":' || processed || '}}'
       END AS checkpoint
FROM counted LEFT JOIN (SELECT run_id, last_item_seq FROM tally) USING (run_id)""",
    "present_urls": f"""
WITH {_ITEMS},{_RUNS}
SELECT i.run_id, i.url, lower(n_name) AS code
FROM items i JOIN runs r USING (run_id) JOIN nation ON n_nationkey = r.site_id JOIN region ON r_regionkey = n_regionkey
WHERE i.status IN ('new', 'updated', 'unchanged') AND r_name <> 'AFRICA'""",
    "unknown_sites": """
SELECT code FROM (
  SELECT 'nation_' || c_nationkey AS code FROM customer UNION SELECT lower(c_mktsegment) FROM customer)
WHERE code NOT IN (SELECT lower(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA')""",
    "site_upsert": f"""
SELECT lower(n_name) AS code, CAST(n_nationkey AS BIGINT) AS site_id,
       CASE WHEN r_name <> 'ASIA' THEN n_name || '!' ELSE n_name END AS name,
       'https://' || lower(n_name) || '.example' AS base_url, lower(r_name) AS adapter, r_name <> 'AFRICA' AS enabled,
       CASE WHEN r_name <> 'ASIA' THEN '{{"delay":2}}' ELSE '{{}}' END AS settings, '2024-01-01 00:00:00' AS created_at,
       CASE WHEN r_name <> 'ASIA' THEN '{_T}' ELSE '2024-01-01 00:00:00' END AS updated_at
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT lower(r_name), CAST(r_regionkey + 100 AS BIGINT), r_name, 'https://r.example', 'none', TRUE, '{{}}', '{_T}', '{_T}' FROM region""",
    "export_rows": f"""
WITH {_RUNS}
SELECT CAST(p_size % 5 AS BIGINT) AS site_id, 'https://shop.example/dp/P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS canonical_url,
       p_name AS title, CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS VARCHAR) AS current_price,
       '["' || p_brand || '","' || p_type || '"]' AS highlights, '{_T}' AS last_seen_at, lower(r_name) AS site_code
FROM part JOIN region ON r_regionkey = p_size % 5
WHERE p_size % 5 IN (SELECT site_id FROM runs WHERE status = 'completed')""",
    "domain_quarantine": """
WITH o AS (
  SELECT o_orderkey, o_custkey, substring(o_orderpriority, 1, 1) AS rank,
         array_to_string(list_filter([
           CASE WHEN substring(o_orderpriority, 1, 1) = '1' THEN 'run_type_domain' END,
           CASE WHEN o_orderstatus = 'P' THEN 'status_domain' END,
           CASE WHEN NOT o_totalprice > 1000 THEN 'title_null' END,
           CASE WHEN CAST(o_totalprice AS DECIMAL(14,2)) >= 100000 THEN 'rating_overflow' END], lambda x: x IS NOT NULL), ',') AS v
  FROM orders),
first AS (SELECT o_custkey, min(o_orderkey) AS owner FROM o WHERE v = '' AND rank <> '5' GROUP BY 1)
SELECT o_orderkey, CASE WHEN v <> '' THEN v WHEN rank <> '5' AND owner <> o_orderkey THEN 'external_id_taken' ELSE '' END AS violations
FROM o LEFT JOIN first USING (o_custkey)""",
    "orphan_audit": """
SELECT 'item_run' AS edge, CAST(o_custkey AS VARCHAR) AS child_key, count(*) AS child_rows FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000) GROUP BY ALL
UNION ALL
SELECT 'child_product', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY ALL
UNION ALL
SELECT 'log_run', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL""",
    "discover_limit": f"""
WITH links AS (
  SELECT CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS BIGINT) AS site_id, l_returnflag, l_linenumber,
         'https://shop.example/dp/P' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS product
  FROM lineitem),
{_DISCOVERY.format(limit=1500)}
SELECT site_id, product FROM found QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY product) <= 1500""",
    "discover_seeds": f"""
WITH links AS (
  SELECT l_suppkey AS site_id, l_returnflag, l_linenumber,
         'https://shop.example/dp/P' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS product
  FROM lineitem),
{_DISCOVERY.format(limit=520)},
seeded AS (
  SELECT site_id, product FROM found
  UNION
  SELECT CAST(c_nationkey AS BIGINT), 'https://shop.example/dp/C' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') FROM customer
  WHERE c_nationkey NOT IN (SELECT site_id FROM cuts))
SELECT site_id, product FROM seeded QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY product) <= 520""",
    "discover_all": """
SELECT l_suppkey AS site_id, count(DISTINCT l_partkey) AS discovered FROM lineitem GROUP BY 1""",
}
