"""Buckets, publications and their conflicts, compaction, and listing pages ordered by their links."""

import glob
import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from driftshelf import fixed
from driftshelf.operators import children, discovery, reports
from driftshelf.plans.run import run_batch
from driftshelf.schemas import AVAILABILITY_HISTORY, IMAGES, PRICE_HISTORY, PRODUCTS, RECORD_FIELDS, ddl
from driftshelf.sinks.tables import CatalogTables, PublicationConflict, bucket_of
from driftshelf.sources import adapters

BASE, SITE = "https://shop.example", 1


@pytest.fixture(scope="module")
def sites(spark):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(f"s{i}", i, f"S{i}", BASE, fixed.STYLE_A, True, "{}", at, at) for i in (SITE, 2)],
        "code string, site_id long, name string, base_url string, adapter string, enabled boolean, settings string, created_at timestamp, updated_at timestamp")


def seen(spark, run, prices, site=SITE):
    """Observations of a run: product number to price, each with one specification."""
    spec = "specifications array<struct<section:string,name:string,value:string>>"
    rows = [(site, run, datetime(2024, 1, run), n, f"{BASE}/p/{n}", f"{BASE}/p/{n}", f"t{n}", str(price), [("S", "n", f"{run}")])
            for n, price in prices.items()]
    df = spark.createDataFrame(
        rows, f"site_id long, run_id long, run_ts timestamp, item_seq long, url string, canonical_url string, title string, "
              f"current_price string, {spec}")
    absent = {n: k for n, k in RECORD_FIELDS.items() if n not in df.columns}
    return df.withColumns({n: (F.array() if k.startswith("array") else F.lit(None)).cast(k) for n, k in absent.items()})


def runs_of(spark, run, limited=False, site=SITE, status="pending"):
    return spark.createDataFrame(
        [(run, site, datetime(2024, 1, run), "full", status, limited, 2)],
        "run_id long, site_id long, run_ts timestamp, run_type string, status string, limited boolean, missing_threshold int")


def files(root, version, table):
    return {f.split("bucket=")[1].split("/")[0] for f in glob.glob(f"{root}/{table}/version={version}/site_id=1/bucket=*/*.parquet")}


def test_a_run_of_one_product_leaves_other_buckets_alone(spark, sites, tmp_path):
    root = str(tmp_path / "catalog")
    tables = CatalogTables(spark, root)
    assert run_batch(tables, "v1", sites, runs_of(spark, 1), observations=seen(spark, 1, dict.fromkeys(range(60), 5))).first().products_new == 60
    assert len(files(root, "v1", "products")) > 20
    row = run_batch(tables, "v2", sites, runs_of(spark, 2, limited=True), observations=seen(spark, 2, {7: 6})).first()
    assert (row.status, row.products_updated, row.products_unavailable) == ("completed", 1, 0)
    own = spark.createDataFrame([(SITE, f"{BASE}/p/7")], "site_id long, canonical_url string")
    bucket = str(own.select(bucket_of()).first()[0])
    for table in ("products", "product_specifications"):
        assert files(root, "v2", table) == {bucket}
    state = {r.canonical_url: r for r in tables.state("products").collect()}
    assert len(state) == 60 and {float(r.current_price) for r in state.values()} == {5, 6}
    assert {r.consecutive_missing_runs for r in state.values()} == {0}
    specs = {r.canonical_url: r.spec_value for r in tables.state("product_specifications").collect()}
    assert len(specs) == 60 and specs[f"{BASE}/p/7"] == "2" and set(specs.values()) == {"1", "2"}
    read = tables.state("products", buckets={SITE: [int(bucket)]}).inputFiles()
    assert read and all(f"bucket={bucket}/" in f for f in read) and len({f.split("version=")[1][:2] for f in read}) == 1


def publish(spark, tables, version, run, prices, site=SITE):
    """Publish products and a price log without a run job."""
    at = datetime(2024, 1, run)
    products = [{"site_id": site, "canonical_url": f"u{n}", "title": "t", "current_price": Decimal(price), "content_hash": "h"}
                for n, price in prices.items()]
    logs = [{"site_id": site, "canonical_url": f"u{n}", "run_id": run, "new_price": Decimal(price), "changed_at": at}
            for n, price in prices.items()]
    rows = spark.createDataFrame(products, ddl(PRODUCTS))
    tables.write("products", rows, version)
    tables.write("price_history", spark.createDataFrame(logs, ddl(PRICE_HISTORY)), version)
    tables.write("availability_history", spark.createDataFrame([], ddl(AVAILABILITY_HISTORY)), version)
    return tables.publish([(site, run)], version, tables.touched(rows), {})


def test_of_two_batches_from_one_start_one_is_refused(spark, tmp_path):
    root = str(tmp_path / "catalog")
    publish(spark, CatalogTables(spark, root), "v1", 1, {1: 5, 2: 5})
    early, late, other = (CatalogTables(spark, root) for _ in range(3))
    assert early.base == late.base == other.base == 1
    assert publish(spark, early, "early", 2, {1: 6}) == 2
    assert publish(spark, other, "other", 9, {1: 6}, site=2) == 3  # another site is no conflict: it takes the next number
    with pytest.raises(PublicationConflict, match="published as 2"):
        publish(spark, late, "late", 3, {1: 7})
    with pytest.raises(PublicationConflict):
        late.publish([(5, 9)], "late")  # the run was published by the other one
    again = CatalogTables(spark, root)
    assert not again.is_published("late")
    assert {(r.canonical_url, float(r.current_price)) for r in again.state("products", [SITE]).collect()} == {("u1", 6), ("u2", 5)}
    late.refresh()
    assert publish(spark, late, "late", 3, {1: 7}) == 4  # begun again, it can
    assert not glob.glob(f"{root}/_published/.*.json") and len(glob.glob(f"{root}/_published/*.json")) == 4
    with pytest.raises(ValueError, match="32 buckets"):
        CatalogTables(spark, root, buckets=8).is_published("v1")


def test_a_number_has_one_owner(spark, tmp_path):
    log = CatalogTables(spark, str(tmp_path)).published
    assert log._take(1, "{}\n") and not log._take(1, "{}\n") and log.newest() == 1


def test_compacted_logs_read_the_same_from_one_folder(spark, tmp_path):
    root = str(tmp_path / "catalog")
    tables = CatalogTables(spark, root)
    for run in range(1, 5):
        publish(spark, tables, f"v{run}", run, {1: run} if run > 1 else {1: 1, 2: 1})
    prices = sorted(map(tuple, tables.log("price_history").collect()))
    state = sorted(map(str, tables.state("products").collect()))
    assert (len(prices), len(state), tables.compact()) == (5, 2, 4)
    assert sorted(map(tuple, tables.log("price_history").collect())) == prices
    assert {f.split("version=")[1].split("/")[0] for f in tables.log("price_history").inputFiles()} == {"upto-4"}
    gone = tables.expire(keep=1)
    assert "price_history/version=v2" in gone and "products/version=v2" in gone and "products/version=v1" not in gone
    assert not any("version=v4" in g for g in gone) and tables.expire(keep=1) == []
    assert sorted(map(str, tables.state("products").collect())) == state
    assert sorted(map(tuple, tables.log("price_history").collect())) == prices
    assert not glob.glob(f"{root}/_published/*.json") and tables.is_published("v1")
    assert publish(spark, tables, "v5", 5, {2: 9}) == 5 and tables.log("price_history").count() == 6
    assert tables.compact() == 5 and tables.log("price_history").count() == 6


def test_ten_thousand_publications_are_one_table(spark, tmp_path):
    tables = CatalogTables(spark, str(tmp_path))
    rows = [{"site_id": n % 7, "run_id": n, "version": f"v{n}", "published_no": n, "buckets": 32, "products": [n % 32],
             "children": []} for n in range(1, 10_001)]
    (tmp_path / "_published").mkdir()
    (tmp_path / "_published" / "000000000001.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "_published" / "000000010000.json").write_text("")
    tables.published.compact(10_000)
    assert tables.base == 10_000 and len(tables.publications().inputFiles()) == 1
    newest = {row[:2]: row[2] for row in tables._newest("site_id", None, "products")}
    want = {(n % 7, n % 32): f"v{n}" for n in range(1, 10_001)}
    assert newest == want


def test_images_read_each_table_once(spark, tmp_path):
    key = [("site_id", "bigint"), ("canonical_url", "string")]
    for name in ("stored", "fresh"):
        spark.createDataFrame([], ddl(IMAGES)).write.parquet(f"{tmp_path}/{name}")
    spark.createDataFrame([], ", ".join(" ".join(k) for k in key)).write.parquet(f"{tmp_path}/touched")
    plan = children.sync_images(*(spark.read.parquet(f"{tmp_path}/{n}") for n in ("stored", "fresh", "touched")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 3 and text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def card(*links, more=""):
    cards = "".join(f'<div class="card thumbnail"><a class="title" href="{x}">x</a></div>' for x in links)
    return f"<html><head><title>Shop</title></head><body>{cards}{more}</body></html>"


def test_runs_from_a_start_page(spark, sites, tmp_path):
    """Pages are read in the order of their next links, each category until a page comes again."""
    start = spark.createDataFrame(
        [(SITE, BASE, '<a class="category-link" href="/c/b/">B</a><a class="category-link" href="/c/a">A</a>')],
        "site_id long, url string, html string")
    pages = {"/c/a": (["/p/1"], "/c/z"), "/c/z": (["/p/2"], "/c/m/"), "/c/m": (["/p/3", "/p/1"], "/c/z"),
             "/c/b": (["/p/4"], "/c/b2"), "/c/b2": (["/p/5"], None), "/c/alone": (["/p/9"], "/c/a")}
    listing = spark.createDataFrame(
        [(SITE, BASE + u, card(*links, more=f'<a rel="next" href="{after}">n</a>' if after else "")) for u, (links, after) in pages.items()],
        "site_id long, url string, html string")

    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    found = seen(spark, 1, dict.fromkeys(range(1, 10), 5))
    row = run_batch(tables, "v1", sites, runs_of(spark, 1), observations=found, listing=listing, start=start, max_products=3).first()
    assert sorted(int(r.url[-1]) for r in tables.of_runs("run_items", [1]).collect()) == [1, 2, 3]
    assert json.loads(row.checkpoint) == {"discovery_complete": True, "last_item_id": row.last_item_seq, "processed": 3}
    lost = adapters.with_adapter(listing.where("url not like '%b2'"), sites)
    ordered = adapters.order_listing(lost, adapters.with_adapter(start, sites), [fixed.STYLE_A])
    links = adapters.read_listing(ordered, [fixed.STYLE_A]).cache()
    sound = links.where("error is null").drop("error")
    assert sorted(int(r.product[-1]) for r in discovery.discover(sound).collect()) == [1, 2, 3, 4]
    assert discovery.first_errors(links).first().error.endswith("/c/b2") and discovery.first_errors(links, 3).count() == 0


def test_page_order_equals_walking(spark):
    nexts = {n: (n * n + 3) % 97 if n % 13 else None for n in range(97)}
    starts = [0, 1, 5, 40, 96, 500]
    want = set()
    for category in starts:
        at, place, visited = category, 1, set()
        while at is not None and at not in visited:
            want.add((category, place, at))
            visited.add(at)
            at, place = nexts.get(at), place + 1
    got = discovery.order_pages(
        spark.createDataFrame([(1, str(s)) for s in starts], "site_id long, category string"),
        spark.createDataFrame([(1, str(a), None if b is None else str(b)) for a, b in nexts.items()], "site_id long, url string, next string"))
    assert {(int(r.category), r.page_no, int(r.url)) for r in got.collect()} == want


def test_run_updates_encode_nested_values(spark):
    runs = spark.createDataFrame([(1, "{}", "running"), (2, "{}", "completed")], "run_id long, checkpoint string, status string")
    values = {"checkpoint": F.struct(F.lit(True).alias("discovery_complete"), F.col("run_id").alias("processed")), "run_id": F.lit(9)}
    rows = reports.update_runs(runs, values, F.col("status") == "running").orderBy("run_id").collect()
    assert [tuple(r) for r in rows] == [(1, '{"discovery_complete":true,"processed":1}', "running"), (2, "{}", "completed")]
