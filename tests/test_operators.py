"""Keyed operators, children, ledger, quality and discovery on small inputs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from driftshelf.operators import children, discovery, keyed, ledger, quality, reports, rounds
from driftshelf.schemas import FAILED_URLS, IMAGES, RUN_ITEMS, ddl



def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_first_wins_keeps_every_null_key(spark):
    df = spark.createDataFrame(
        [(1, "a", None, 0), (1, "a", None, 1), (1, "a", "x", 2), (1, "a", "x", 3), (1, None, None, 4)],
        "p int, k string, n string, pos int")
    kept = keyed.first_wins(df, ["p", "k", "n"], ["pos"], ["n"])
    assert rows(kept, "pos") == [(0,), (1,), (2,), (4,)]


def test_insert_if_absent_ignores_null_keys(spark):
    target = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    new = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "a int, b string")
    assert rows(keyed.insert_if_absent(target, new, ["a", "b"]), "a") == [(1,), (3,)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_gives_the_same_rows_with_any_number_of_salts(spark, how):
    facts = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    broadcast = facts.join(F.broadcast(dim), ["k"], how)
    salted = keyed.lookup(facts, dim, ["k"], how, spread=["id"], salts=5)
    assert rows(keyed.lookup(facts, dim, ["k"], how), *broadcast.columns) == rows(broadcast, *broadcast.columns)
    assert "_salt" not in salted.columns
    assert rows(broadcast, *broadcast.columns) == rows(salted, *broadcast.columns)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_copies_the_side_only_if_salts_are_given(spark, how):
    facts = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 > 0, F.col("id") % 50))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    broadcast = facts.join(F.broadcast(dim), ["k"], how)
    plain, salted = (keyed.lookup(facts, dim, ["k"], how, spread=["id"], salts=s) for s in (None, 5))
    seen = [df._jdf.queryExecution().executedPlan().toString() for df in (plain, salted)]
    assert "Generate" not in seen[0]  # 64 copies of a million rows, broadcast, are too much for any driver
    assert "Generate" in seen[1] and "Broadcast" not in seen[1]
    assert rows(plain, *broadcast.columns) == rows(salted, *broadcast.columns) == rows(broadcast, *broadcast.columns)


def test_upsert_inserts_updates_and_keeps(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    out = keyed.upsert(old, new, ["k"], {"v": F.col("new.v"), "n": F.col("old.n") + 1}, {"n": F.lit(0)})
    assert rows(out, "k", "v", "n") == [(1, "a", 5), (2, "B", 7), (3, "C", 0)]


OBS = (
    "site_id long, canonical_url string, run_ts timestamp, "
    "images array<struct<url:string,high_resolution_url:string,type:string>>, "
    "relations array<struct<type:string,external_id:string,name:string,url:string,sku:string,price:string,currency:string>>, "
    "variants array<struct<name:string,value:string,sku:string,url:string,price:string,availability:string>>"
)


def observe(spark, when, listed):
    from datetime import datetime

    return spark.createDataFrame(
        [(1, u, datetime(2024, 1, when), i, r, v) for u, i, r, v in listed], OBS)


def test_images_are_synced(spark):
    first = observe(spark, 1, [
        ("p", [("a", "A", "main"), ("b", "B", None), ("a", "A2", "gallery")], [], []),
        ("q", [("z", None, "main")], [], []), ("r", [("y", None, "main")], [], [])])
    stored = children.image_rows(children.entries(first, "images"))
    assert rows(stored.where("canonical_url = 'p'"), "image_url", "high_resolution_url",
                "image_type", "display_order") == [("a", "A2", "gallery", 2), ("b", "B", "gallery", 1)]
    second = observe(spark, 2, [("p", [("c", None, "main"), ("b", "B9", "gallery")], [], []), ("r", [], [], [])])
    fresh = children.image_rows(children.entries(second, "images"))
    touched = children.products_of(second)
    synced = children.sync_images(stored, fresh, touched)
    assert rows(synced, "canonical_url", "image_url", "display_order", F.dayofmonth("first_seen_at"),
                F.dayofmonth("last_seen_at")) == [
        ("p", "b", 1, 1, 2), ("p", "c", 0, 2, 2), ("q", "z", 0, 1, 1)]
    assert rows(children.gone_images(stored, fresh, touched), "canonical_url", "image_url") == [
        ("p", "a"), ("r", "y")]


def test_children_without_key_parts_stay(spark):
    rel = [("related", None, "n", None, None, "1.00", None)] * 2 + [
        ("related", "e1", "n", "u", None, "5", "EUR"), ("related", "e2", "n", "u", None, None, None)]
    var = [("size", "L", None, None, None, None)] * 2 + [("size", "L", "s", None, "2", None)] * 2
    df = observe(spark, 1, [("p", [], rel, var)])
    out = children.relation_rows(children.entries(df, "relations"))
    assert rows(out, "related_external_id", "related_url", "currency") == [
        ("e1", "u", "EUR"), (None, None, "USD"), (None, None, "USD")]
    assert children.variant_rows(children.entries(df, "variants")).count() == 3


def items(spark, listed):
    df = spark.createDataFrame(listed, "run_id long, url string, item_seq long, status string, attempts int")
    have = set(df.columns)
    return df.select(*[
        F.col(n) if n in have else F.lit(None).cast(k).alias(n) for n, k in RUN_ITEMS.items()])


def test_ledger_walk(spark):
    empty = spark.createDataFrame([], ddl(RUN_ITEMS))
    found = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "a", 1)], "run_id long, url string, item_seq long")
    queued = ledger.enqueue(empty, found, now())
    assert rows(queued, "run_id", "url", "item_seq", "status", "attempts") == [
        (1, "a", 1, "pending", 0), (1, "b", 2, "pending", 0), (2, "a", 1, "pending", 0)]
    assert ledger.enqueue(queued, found, now()).count() == 3
    claimed = ledger.claim(queued, now())
    assert rows(claimed, "status", "attempts") == [("processing", 1)] * 3
    again = ledger.claim(ledger.reset_interrupted(claimed, now()), now())
    assert rows(again, "status", "attempts") == [("processing", 2)] * 3
    outcomes = spark.createDataFrame(
        [(1, "a", "new", None, None, '{"x":1}'), (1, "b", "failed", "E", "m" * 5000, None)],
        "run_id long, url string, status string, error_type string, error_message string, result string")
    done = ledger.record_outcomes(again, outcomes, now())
    assert rows(done, "run_id", "url", "status", "error_type", F.length("error_message"), "result") == [
        (1, "a", "new", None, None, '{"x":1}'), (1, "b", "failed", "E", 5000, "{}"),
        (2, "a", "processing", None, None, "{}")]
    runs = spark.createDataFrame(
        [(1, 9, "completed_with_errors"), (2, 9, "failed")], "run_id long, site_id long, status string"
    ).withColumn("run_ts", now()).withColumn("completed_at", now())
    log = spark.createDataFrame([], ddl(FAILED_URLS))
    for tries in range(3):
        log = ledger.log_failures(log, ledger.failures(outcomes, runs), now())
        assert rows(log, "site_id", "url", "retry_count", F.length("error_message")) == [(9, "b", tries, 5000)]
    back = ledger.requeue(done, runs, now())
    assert rows(back, "run_id", "url", "status") == [
        (1, "a", "new"), (1, "b", "pending"), (2, "a", "processing")]
    assert rows(ledger.resume_runs(runs), "run_id", "status", "completed_at") == [
        (1, "pending", None), (2, "pending", None)]
    assert rows(ledger.present_urls(done), "url") == [("a",)]


def test_counters_and_summary(spark):
    listed = items(spark, [
        (1, "a", 1, "new", 1), (1, "b", 2, "failed", 1), (1, "c", 3, "pending", 0), (2, "a", 4, "unchanged", 1)])
    counters = reports.run_counters(listed)
    assert rows(counters, "run_id", "processed", "errors", "last_item_seq") == [(1, 2, 1, 2), (2, 1, 0, 4)]
    runs = spark.createDataFrame([(1, "s", "full"), (3, "s", "full")], "run_id long, site_code string, run_type string")
    counted = reports.counted_runs(runs, counters).withColumns({
        "status": reports.final_status(F.col("errors")), "products_unavailable": F.lit(4),
        "run_error": F.lit(None).cast("string")})
    assert rows(reports.run_summary(counted), "summary") == [
        ('{"run_id":1,"site":"s","run_type":"full","status":"completed_with_errors",'
         '"items":{"pending":1,"new":1,"failed":1},"unavailable":4,"resumable":true}',),
        ('{"run_id":3,"site":"s","run_type":"full","status":"completed","items":{},"unavailable":4,"resumable":true}',)]


def test_second_url_of_an_id_is_refused(spark, monkeypatch):
    stored = spark.createDataFrame([(1, "X", "old"), (1, "Y", "y")], "site_id long, external_id string, canonical_url string")
    new = spark.createDataFrame(
        [(1, "X", "u1", 1), (1, "Z", "u3", 3), (1, "Z", "u2", 2), (1, None, "n1", 4), (1, None, "n2", 5),
         (1, "Y", "y", 6), (2, "X", "u9", 7)],
        "site_id long, external_id string, canonical_url string, item_seq long")
    for limit in (64, 1):
        monkeypatch.setattr(keyed, "MOST_SALTS", limit)
        out = quality.second_claims(new, stored, ["site_id"], "external_id", "canonical_url", "item_seq")
        assert rows(out.where("taken"), "canonical_url") == [("u1",), ("u3",)]
        assert out.count() == 7


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orphans_are_found_without_join_or_sort(spark):
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (None, "c"), (4, "d")], "k long, c string")
    parent = spark.createDataFrame([(2, "b"), (2, "b"), (4, "x"), (None, "c"), (5, "e")], "pk long, pc string")
    one = quality.orphans(child, parent, {"k": "pk"}, "e")
    assert rows(one, "edge", "child_key", "child_rows") == [("e", "1", 2), ("e", "3", 1)]
    two = quality.orphans(child, parent, {"k": "pk", "c": "pc"}, "e")
    assert rows(two, "child_key", "child_rows") == [("1|a", 2), ("4|d", 1)]
    assert "Join" not in planned(two) and "Sort" not in planned(two)


def test_outcomes_with_long_messages_are_dealt_out(spark):
    listed = items(spark, [(1, "a", 1, "processing", 1), (1, "b", 2, "processing", 1), (2, None, 3, "new", 0)])
    outcomes = spark.createDataFrame(
        [(1, "b", "failed", "E", "m" * 100_000, None), (2, None, "failed", "E", "m", None), (3, "c", "new", None, None, "{}")],
        "run_id long, url string, status string, error_type string, error_message string, result string")
    done = ledger.record_outcomes(listed, outcomes, now())
    assert "REPARTITION_BY_NUM" in planned(done) and "Broadcast" not in planned(done)
    assert rows(done, "run_id", "url", "status", F.length("error_message")) == [
        (1, "a", "processing", None), (1, "b", "failed", 100_000), (2, None, "new", None)]


def test_images_meet_in_one_sort(spark, tmp_path):
    layout = ddl(IMAGES)
    image = lambda url, seen: (1, "p", url, None, "main", 0, "h", seen, seen)
    day = [datetime.datetime(2024, 1, n) for n in (1, 2)]
    for name, urls in (("stored", ["a", "b", None]), ("fresh", ["b", None])):
        spark.createDataFrame([image(u, day[name == "fresh"]) for u in urls], layout).write.parquet(f"{tmp_path}/{name}")
    stored, fresh = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("stored", "fresh"))
    touched = spark.createDataFrame([(1, "p")], "site_id long, canonical_url string")
    gone, synced = (f(stored, fresh, touched) for f in (children.gone_images, children.sync_images))
    assert rows(gone, "image_url") == [("a",)]
    assert rows(synced, "image_url", "first_seen_at") == [("b", day[0]), (None, day[0])]
    for df in (gone, synced):
        assert planned(df).count("Sort [") == 1 and "REPARTITION_BY_NUM" in planned(df)


def test_checks_name_what_is_broken(spark):
    df = spark.createDataFrame(
        [("weekly", None, "123.4"), ("full", "t", "99.99"), (None, "t", None)],
        "run_type string, title string, rating string")
    checked = quality.checked(df, [
        quality.in_domain("run_type", ("full", "incremental")), quality.required("title"),
        quality.fits("rating", "decimal(4,2)")])
    assert [r.violations for r in quality.quarantine(checked).collect()] == [
        ["run_type_domain", "title_null", "rating_overflow"]]
    assert quality.good(checked).count() == 2


def page_by_page(pages, limit, seeds):
    """Sites read one page after the other."""
    found = set()
    for _, products in sorted(pages.items()):
        found |= products
        if limit and len(found) >= limit:
            return sorted(found)[:limit]
    found |= seeds
    return sorted(found)[:limit] if limit else sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_discovery_equals_reading_page_by_page(spark, seed):
    rng = random.Random(seed)
    limit = rng.choice([None, 1, 4, 9, 500])
    sites = {
        s: {(f"c{rng.randint(0, 3)}", n): {f"u{rng.randint(0, 25):02d}" for _ in range(rng.randint(1, 4))}
            for n in range(rng.randint(1, 6))} for s in (1, 2, 3)}
    seeds = {s: {f"s{rng.randint(0, 9)}" for _ in range(2)} for s in sites}
    links = spark.createDataFrame(
        [(s, c, n, u) for s, pages in sites.items() for (c, n), us in pages.items() for u in us],
        "site_id long, category string, page_no int, product string")
    extra = spark.createDataFrame([(s, u) for s, us in seeds.items() for u in us], "site_id long, product string")
    out = discovery.discover(links, limit, extra).collect()
    got = {s: sorted(r.product for r in out if r.site_id == s) for s in sites}
    assert got == {s: page_by_page(p, limit, seeds[s]) for s, p in sites.items()}


@pytest.mark.parametrize("gap", [1, 3, 256])
def test_page_order_equals_following_the_links(spark, monkeypatch, gap):
    monkeypatch.setattr(discovery, "HUB_GAP", gap)
    rng = random.Random(gap)
    leads = {(s, f"p{n}"): f"p{rng.choice([n + 1, n + 2, rng.randint(0, 60)])}"
             for s in (1, 2, 3) for n in range(60) if rng.random() < 0.97 or s == 3}
    leads |= {(4, "a"): "a", (4, "b"): "a", (4, "c"): "d", (4, "d"): "c", (4, "e"): "gone"}
    starts = [(s, f"p{n}") for s in (1, 2, 3) for n in range(0, 60, 4)] + [(4, c) for c in "abcdez"] + [(None, "p1"), (1, None)]
    expected = []
    for site, category in starts:
        url, seen = category, []
        while url is not None and url not in seen:
            seen.append(url)
            url = leads.get((site, url))
        expected += [(site, category, n, u) for n, u in enumerate(seen or [None], 1)]
    nexts = [(s, u, n) for (s, u), n in leads.items()] + [(1, "p1", None), (4, "a", "b"), (None, "p1", "p2")]
    out = discovery.order_pages(
        spark.createDataFrame(starts * 2, "site_id long, category string"),
        spark.createDataFrame(nexts, "site_id long, url string, next string"))
    assert rows(out, "site_id", "category", "page_no", "url") == sorted(expected, key=repr)


def test_rounds_of_page_order_move_pieces_not_rows(spark, monkeypatch):
    monkeypatch.setattr(discovery, "HUB_GAP", 8)
    moved, cut = [], discovery.cut

    def counted(df):
        moved.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(discovery, "cut", counted)
    ring = [(1, f"p{n}", f"p{(n + 1) % 400}") for n in range(400)]
    starts = spark.createDataFrame([(1, f"p{n}") for n in range(0, 400, 2)], "site_id long, category string")
    out = discovery.order_pages(starts, spark.createDataFrame(ring, "site_id long, url string, next string"))
    assert out.count() == 200 * 400
    assert max(moved) < 200 * 400 / 4


def test_a_cut_leaves_no_estimate_that_grows_with_the_rounds(spark):
    links = rounds.cut(spark.range(3).select("id", (F.col("id") + 1).alias("next")))
    for _ in range(9):
        on = links.select(F.col("id").alias("next"), F.col("next").alias("after"))
        links = rounds.cut(links.join(on, "next", "left").select("id", F.coalesce("after", "next").alias("next")))
    assert rows(links, "id", "next") == [(0, 3), (1, 3), (2, 3)]
    assert links._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64


def test_no_job_runs_while_a_lookup_is_planned(spark):
    facts, dim = spark.range(100).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    spark.sparkContext.setJobGroup("planning", "")
    keyed.lookup(facts, dim.groupBy("k").agg(F.count("*").alias("n")), ["k"])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_cut_of_a_null_category(spark):
    links = spark.createDataFrame(
        [(1, None, 1, "z"), (1, None, 2, "a"), (1, "c", 1, "b")],
        "site_id long, category string, page_no int, product string")
    assert rows(discovery.discover(links, 2), "product") == [("a",), ("z",)]


def test_pending_takes_a_limit_in_order(spark):
    listed = items(spark, [(1, "c", 3, "pending", 0), (1, "a", 1, "new", 0), (1, "b", 2, "pending", 0)])
    assert [r.url for r in ledger.pending(listed, 1).collect()] == ["b"]
    assert [r.url for r in ledger.pending(listed, 0).collect()] == ["b", "c"]
