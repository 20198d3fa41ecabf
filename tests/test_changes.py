"""Batch step and replay against the one-at-a-time model on random histories."""

import random

import pytest
from pyspark.sql import functions as F

from driftshelf.operators import changes, replay
from driftshelf.schemas import PRODUCTS, ddl

from model import Catalog, history

DAY = "timestamp'2024-01-01' + make_interval(0,0,0,{})"


def frames(spark, plan, seen):
    runs = spark.createDataFrame(
        [(1, r["no"] + 100, r["no"], r["limited"], r["threshold"]) for r in plan],
        "site_id long, run_id long, run_no long, limited boolean, missing_threshold int",
    ).withColumn("run_ts", F.expr(DAY.format("cast(run_no as int)")))
    rows = [
        (1, r["no"] + 100, i, u, t, None if p is None else str(p), a)
        for r, now in zip(plan, seen) for i, (u, (t, p, a)) in enumerate(now.items())
    ]
    observed = spark.createDataFrame(
        rows, "site_id long, run_id long, item_seq long, canonical_url string, title string, "
              "current_price string, availability string",
    ).withColumn("run_ts", F.expr(DAY.format("cast(run_id - 100 as int)")))
    return runs, observed


def digest(spark, plan, seen):
    """Hash per (title, price, availability), so that the model sees the same hashes."""
    keys = {v for now in seen for v in now.values()}
    df = spark.createDataFrame(
        [(t, None if p is None else str(p), a) for t, p, a in keys],
        "title string, current_price string, availability string",
    )
    found = changes.hashed(df).collect()
    by = {(r.title, r.current_price, r.availability): r.content_hash for r in found}
    return [
        {u: (by[t, None if p is None else str(p), a], p, a) for u, (t, p, a) in now.items()}
        for now in seen
    ]


def day(ts):
    return None if ts is None else (ts - __import__("datetime").datetime(2024, 1, 1)).days


def state_rows(df):
    return {
        r.canonical_url: (r.content_hash, r.current_price, r.availability,
                          r.consecutive_missing_runs, day(r.unavailable_since),
                          day(r.first_seen_at), day(r.last_seen_at), day(r.updated_at))
        for r in df.collect()
    }


def model_rows(catalog):
    return {
        u: (p["hash"], p["price"], p["stock"], p["missing"], p["since"], p["first"], p["last"], p["at"])
        for u, p in catalog.products.items()
    }


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_model(spark, seed):
    rng = random.Random(seed)
    plan, seen = history(rng, 12, 25)
    runs, observed = frames(spark, plan, seen)
    catalog = Catalog()
    for run, now in zip(plan, digest(spark, plan, seen)):
        catalog.run(run, now)
    steps = replay.sightings(observed, runs).cache()
    assert {(r.canonical_url, r.run_no): r.change_status for r in steps.collect()} == catalog.status
    prices = [(r.canonical_url, r.run_id - 100, r.old_price, r.new_price)
              for r in changes.price_changes_of(steps).collect()]
    assert sorted(prices, key=repr) == sorted(catalog.prices, key=repr)
    moves = [(r.canonical_url, r.run_id - 100, r.old_status, r.new_status)
             for r in changes.availability_changes_of(steps).collect()]
    assert sorted(moves, key=repr) == sorted(catalog.moves, key=repr)
    assert state_rows(replay.final_state(steps)) == model_rows(catalog)
    stock = {r.run_no: r.unavailable for r in replay.unavailable_by_run(steps, runs).collect()}
    assert stock == {r["no"]: 0 if r["limited"] else catalog.stock[r["no"]] for r in plan}


def test_batches_equal_model(spark):
    plan, seen = history(random.Random(7), 7, 20)
    runs, observed = frames(spark, plan, seen)
    catalog = Catalog()
    state = spark.createDataFrame([], ddl(PRODUCTS))
    for run, now in zip(plan, digest(spark, plan, seen)):
        prices, moves = len(catalog.prices), len(catalog.moves)
        catalog.run(run, now)
        this = F.col("run_id") == run["no"] + 100
        merged = changes.merge(state, changes.incoming(observed.where(this)), runs.where(this))
        rows = merged.collect()
        merged = spark.createDataFrame(rows, merged.schema)
        assert state_rows(merged) == model_rows(catalog)
        status = {(r.canonical_url, run["no"]): r.change_status
                  for r in changes.outcomes_of(merged).collect()}
        assert status == {k: v for k, v in catalog.status.items() if k[1] == run["no"]}
        got = [(r.canonical_url, r.old_price, r.new_price)
               for r in changes.price_changes_of(merged).collect()]
        assert sorted(got, key=repr) == sorted(
            [(u, a, b) for u, _, a, b in catalog.prices[prices:]], key=repr)
        got = [(r.canonical_url, r.old_status, r.new_status)
               for r in changes.availability_changes_of(merged).collect()]
        assert sorted(got, key=repr) == sorted(
            [(u, a, b) for u, _, a, b in catalog.moves[moves:]], key=repr)
        gone = {r.site_id: r.unavailable for r in changes.unavailable_of(merged).collect()}
        assert gone.get(1, 0) == catalog.stock[run["no"]]
        state = changes.state_of(merged)


def test_last_observation_of_a_run_wins(spark):
    df = spark.createDataFrame(
        [(1, "u", 5, i, f"t{i}") for i in range(10)],
        "site_id long, canonical_url string, run_id long, item_seq long, title string")
    assert [r.title for r in changes.last_in_run(df).collect()] == ["t9"]


def test_defaults_replace_empty_values(spark):
    df = spark.createDataFrame(
        [(1, "u", 5, 1, "", "", None, None, "1.005")],
        "site_id long, canonical_url string, run_id long, item_seq long, title string, "
        "currency string, review_count int, highlights array<string>, current_price string")
    row = changes.incoming(df).first()
    assert (row.title, row.currency, row.review_count, row.highlights, row.raw_data) == (
        "Untitled product", "USD", 0, [], "{}")
    assert str(row.current_price) == "1.01"


OLD, NEW = ("title", "availability"), ("title", "availability", "current_price")


def test_changed_fields_update_nothing_by_themselves(spark):
    """Over the old fields a record is the stored one or not; products not seen keep their version."""
    runs = spark.createDataFrame([(1, False, 2)], "site_id long, limited boolean, missing_threshold int").withColumn(
        "run_ts", F.lit("2024-01-01").cast("timestamp"))

    def step(state, rows, *lists):
        seen = spark.createDataFrame(
            [(1, 9, i, u, t, p, "in_stock") for i, (u, t, p) in enumerate(rows)],
            "site_id long, run_id long, item_seq long, canonical_url string, title string, current_price string, availability string",
        ).withColumn("run_ts", F.lit("2024-01-01").cast("timestamp"))
        merged = changes.merge(state, changes.incoming(seen, *lists), runs).cache()
        status = {r.canonical_url: r.change_status for r in merged.collect()}
        return changes.state_of(merged), status

    state, status = step(spark.createDataFrame([], ddl(PRODUCTS)), [("a", "A", "1"), ("b", "B", "1"), ("c", "C", "1")], OLD)
    assert set(status.values()) == {"new"}
    state, status = step(state, [("a", "A", "2"), ("b", "X", "1"), ("d", "D", "1")], NEW, (OLD,))
    assert status == {"a": "unchanged", "b": "updated", "c": None, "d": "new"}
    state, status = step(state, [("a", "A", "3"), ("b", "X", "1"), ("c", "C", "7")], NEW, (OLD,))
    assert status == {"a": "updated", "b": "unchanged", "c": "unchanged", "d": None}
    state, status = step(state, [("a", "A", "3")], OLD)  # a list that is not among the earlier ones
    assert status["a"] == "updated"


def test_hashes_without_a_version_are_of_the_fixed_fields(spark):
    seen = spark.createDataFrame([("A", "1")], "title string, current_price string")
    stored = changes.hashed(seen).first().content_hash
    row = changes.hashed(seen, NEW, (OLD, changes.fixed.TRACKED_FIELDS))
    as_now = changes.in_present_fields(F.lit(stored), F.lit(None).cast("string"), changes._hashes(row.columns))
    assert row.select(as_now == F.col("content_hash")).first()[0]
    assert changes.hashing.fields_version(OLD) == changes.hashing.fields_version(OLD[::-1])
