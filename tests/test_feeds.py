"""Observation files: broken lines are failed items, each file is read once."""

import json

import pytest
from pyspark.sql import functions as F
from test_run import A, BASE, runs_of, sites

from driftshelf.plans.run import run_batch
from driftshelf.schemas import OBSERVATIONS
from driftshelf.sinks.tables import CatalogTables
from driftshelf.sources import feeds

GOOD = {"site_id": A, "run_id": 1, "canonical_url": f"{BASE}/p/1", "item_seq": 1, "title": "t", "current_price": "5.00"}


def line(**changes):
    return json.dumps({k: v for k, v in {**GOOD, **changes}.items() if v is not ...})


@pytest.mark.parametrize("text, message", [
    (line(), None),
    (line(unknown=1, brand=None), None),
    (line() + " and more", None),
    (line(review_count="many"), "does not fit: review_count"),
    (line(review_count=2**31, run_ts="soon"), "does not fit: run_ts, review_count"),
    (line(images="x"), "does not fit: images"),
    (line(reviews=[{"review_date": "never"}]), "does not fit: a value in a list"),
    (line(canonical_url=...), "missing: canonical_url"),
    (line(site_id="1"), "does not fit: site_id"),
    ("{}", "missing: site_id, run_id, canonical_url"),
    (line()[:-9], "not a JSON object"),
    ("[" + line() + "]", "not a JSON object"),
    ("nope", "not a JSON object"),
])
def test_reasons(spark, text, message):
    row = feeds.parsed_lines(spark.createDataFrame([(text,)], "line string")).first()
    assert row.error_message == message
    assert row.error_type == (message and "invalid_record")


def test_blank_lines_ties_and_clashing_columns(spark):
    rows = [(None, "a"), ("", "b"), (" \t", "c"), (line(), "d"), (line(), "e")]
    lines = spark.createDataFrame(rows, "line string, title string").withColumns(
        {"error_type": F.lit("x"), "extra": F.lit(7)})
    got = feeds.parsed_lines(lines)
    assert set(got.columns) == {"line", "extra", *OBSERVATIONS, "url", "error_type", "error_message"}
    assert [(r.title, r.error_type, r.extra) for r in got.collect()] == [("t", None, 7)] * 2
    assert feeds.parsed_lines(lines.limit(0)).count() == 0


def test_files_are_read_once(spark, tmp_path):
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("inbox", "taken", "checkpoint"))
    (tmp_path / "inbox").mkdir()

    def drop(name, *lines):
        (tmp_path / "inbox" / name).write_text("\n".join(lines))

    def take():
        return feeds.take_files(spark, inbox, target, checkpoint, per_batch=2)

    drop("a.json", line(), "nope")
    drop("b.json", line(canonical_url=f"{BASE}/p/2"))
    drop("c.json", line(canonical_url=f"{BASE}/p/3", review_count="many"))
    assert take().count() == 4
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "taken").rglob("*.parquet")}
    drop("d.json", line(canonical_url=f"{BASE}/p/4"), line(item_seq=2, title="later"), line(item_seq=None, title="no place"))
    rows = take()
    assert rows.count() == 7
    after = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "taken").rglob("*.parquet")}
    assert before.items() <= after.items()
    assert take().count() == 7
    odd = feeds.homeless(rows).first()
    assert odd.file.endswith("a.json") and (odd.line, odd.error_message) == ("nope", "not a JSON object")

    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    run = run_batch(tables, "v1", sites(spark), runs_of(spark, [(1, A, "pending", False)]),
                    observations=feeds.observed(rows)).first()
    assert (run.products_new, run.errors, run.status) == (3, 1, "completed_with_errors")
    assert tables.state("products").where(F.col("canonical_url") == f"{BASE}/p/1").first().title == "later"
    bad = tables.of_runs("run_items", [1]).where("status = 'failed'").first()
    assert (bad.url, bad.error_type, bad.error_message) == (f"{BASE}/p/3", "invalid_record", "does not fit: review_count")


def test_a_batch_that_died_is_written_again(spark, tmp_path, monkeypatch):
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.json").write_text(line() + "\n" + line(item_seq=2))
    paths = [str(tmp_path / n) for n in ("inbox", "taken", "checkpoint")]
    whole = feeds.parsed_lines

    def dies(batch):
        whole(batch).limit(1).write.mode("overwrite").parquet(f"{paths[1]}/batch=0")
        raise RuntimeError("lost")

    monkeypatch.setattr(feeds, "parsed_lines", dies)
    with pytest.raises(Exception, match="lost"):
        feeds.take_files(spark, *paths)
    monkeypatch.setattr(feeds, "parsed_lines", whole)
    (tmp_path / "inbox" / "b.json").write_text(line(item_seq=3))
    assert sorted(r.item_seq for r in feeds.take_files(spark, *paths).collect()) == [1, 2, 3]


def test_runs_with_changed_fields(spark, tmp_path):
    """Several items of a product in the run that changes the list; the next run has the new list only."""
    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    old, new = ("title",), ("title", "current_price")

    def run(no, *rows, **lists):
        lines = spark.createDataFrame([(line(run_id=no, **r),) for r in rows], "line string")
        observed = feeds.parsed_lines(lines).drop("line").withColumn("url", F.concat("url", F.lit("?"), "item_seq"))
        run_batch(tables, f"v{no}", sites(spark), runs_of(spark, [(no, A, "pending", True)]), observations=observed, **lists)
        return [r.status for r in tables.of_runs("run_items", [no]).orderBy("url").collect()]

    a, b = ({"canonical_url": f"{BASE}/p/{n}", "title": f"t{n}"} for n in "ab")
    assert run(1, {**a, "item_seq": 1}, {**b, "item_seq": 2}, tracked=old) == ["new", "new"]
    assert run(2, {**a, "item_seq": 1, "current_price": "7.00"}, {**a, "item_seq": 2, "current_price": "8.00"},
               {**b, "item_seq": 3, "title": "other"}, tracked=new, earlier=[old]) == ["unchanged", "updated", "updated"]
    assert run(3, {**a, "item_seq": 1, "current_price": "8.00"}, tracked=new) == ["unchanged"]
