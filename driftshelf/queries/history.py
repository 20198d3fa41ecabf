"""Change tracking over the event table: users as products, days as runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes, replay
from ..operators.keyed import lookup
from ..plans import views
from ..schemas import KEY, PRODUCTS, ddl


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return replay.sightings(views.event_observations(spark, d), views.event_runs(spark, d))


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def change_status(spark: SparkSession, d: str) -> DataFrame:
    """Which products are new, updated or unchanged in each run."""
    return _seen(spark, d).select(*KEY, "run_no", "change_status", "content_hash")


def hash_versions(spark: SparkSession, d: str) -> DataFrame:
    """Products seen again after the tracked fields changed: events of even ids under the old
    list, those of odd ids under the new one."""
    old, new = ("title", "availability"), ("title", "availability", "current_price")
    observed = views.event_observations(spark, d)
    half = F.col("item_seq.event_id") % 2
    state = spark.createDataFrame([], ddl(PRODUCTS))
    for no, fields, earlier in ((0, old, ()), (1, new, (old,))):
        ts = F.lit(f"2024-01-0{no + 1}").cast("timestamp")
        rows = observed.where(half == no).withColumns({"run_id": F.lit(no).cast("bigint"), "run_ts": ts})
        runs = spark.range(1, 4).select(
            F.col("id").alias("site_id"), ts.alias("run_ts"), F.lit(False).alias("limited"), F.lit(2).alias("missing_threshold"))
        merged = changes.merge(state, changes.incoming(rows, fields, earlier), runs)
        state = changes.state_of(merged)
    return merged.where("change_status IS NOT NULL").select(
        *KEY, "change_status", "content_hash",
        (F.col("old_version") != F.col("hash_version")).alias("fields_changed"), F.coalesce("old_hash", F.lit("")).alias("old_hash"),
    ).withColumn("fields_changed", F.coalesce("fields_changed", F.lit(False)))


def price_history(spark: SparkSession, d: str) -> DataFrame:
    changed = changes.price_changes_of(_seen(spark, d))
    return changed.select(
        *KEY, "run_id", F.col("old_price").cast("double").alias("old_price"),
        F.col("new_price").cast("double").alias("new_price"), "currency", _stamp("changed_at"),
    )


def availability_history(spark: SparkSession, d: str) -> DataFrame:
    changed = changes.availability_changes_of(_seen(spark, d))
    return changed.select(*KEY, "run_id", "old_status", "new_status", _stamp("changed_at"))


def missing_aging(spark: SparkSession, d: str) -> DataFrame:
    spells = replay.missing_spells(_seen(spark, d), views.event_runs(spark, d))
    return spells.select(
        *KEY, "last_seen_no", F.col("missed_runs").cast("bigint").alias("missed_runs"),
        F.coalesce("unavailable_from_no", F.lit(-1)).cast("bigint").alias("unavailable_from_no"),
    )


def unavailable_by_run(spark: SparkSession, d: str) -> DataFrame:
    return replay.unavailable_by_run(_seen(spark, d), views.event_runs(spark, d))


def _shown(state: DataFrame) -> list:
    times = ("first_seen_at", "last_seen_at", "unavailable_since", "updated_at")
    return [
        *KEY, "external_id", "title", F.col("current_price").cast("double").alias("current_price"),
        "currency", "availability", F.col("review_count").cast("bigint").alias("review_count"),
        "content_hash", "raw_data",
        F.col("consecutive_missing_runs").cast("bigint").alias("consecutive_missing_runs"),
        *[_stamp(t) for t in times],
    ]


def replay_final_state(spark: SparkSession, d: str) -> DataFrame:
    state = replay.final_state(_seen(spark, d))
    return state.select(*_shown(state))


def missing_products(spark: SparkSession, d: str) -> DataFrame:
    """Products known to a site that its last run did not see."""
    seen, last = _seen(spark, d), F.max("run_no").over(Window.partitionBy("site_id"))
    ends = views.event_runs(spark, d).withColumn("l", last).where("run_no = l").select("run_id")
    present = lookup(seen, ends, ["run_id"], "left_semi", ["canonical_url"]).select(*KEY)
    known = replay.final_state(seen)
    return changes.missing_products(known, present).select(*KEY, "availability")


def _last_step(spark: SparkSession, d: str) -> DataFrame:
    """The last run of each site as a batch against the state of all runs before it."""
    runs = views.event_runs(spark, d)
    last = F.max("run_no").over(Window.partitionBy("site_id"))
    marked = runs.withColumn("is_last", F.col("run_no") == last)
    before, now = marked.where("not is_last"), marked.where("is_last")
    observed = views.event_observations(spark, d)

    def of(some: DataFrame) -> DataFrame:
        return lookup(observed, some.select("run_id"), ["run_id"], "left_semi", ["item_seq"])

    stored = replay.final_state(replay.sightings(of(before), before))
    return changes.merge(stored, changes.incoming(of(now)), now)


def state_after_run(spark: SparkSession, d: str) -> DataFrame:
    merged = _last_step(spark, d)
    return merged.select(
        *_shown(merged), F.coalesce("change_status", F.lit("missing")).alias("change_status")
    )


def batch_equals_replay(spark: SparkSession, d: str) -> DataFrame:
    """Rows compared, and rows that differ, between the batch step and the replay."""
    merged, seen = _last_step(spark, d), _seen(spark, d)
    last = F.max("run_no").over(Window.partitionBy("site_id"))
    last_runs = views.event_runs(spark, d).withColumn("l", last).where("run_no = l").select("run_id")

    def of_last(log: DataFrame) -> DataFrame:
        return lookup(log, last_runs, ["run_id"], "left_semi", ["canonical_url"])

    pairs = {
        "state": (changes.state_of(merged), replay.final_state(seen)),
        "price_history": (changes.price_changes_of(merged),
                          of_last(changes.price_changes_of(seen))),
        "availability_history": (changes.availability_changes_of(merged),
                                 of_last(changes.availability_changes_of(seen))),
    }
    return reduce(DataFrame.unionByName, [_compare(n, a, b) for n, (a, b) in pairs.items()])


def _compare(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    columns = [c for c in a.columns if c not in KEY]
    left = a.select(*KEY, F.struct(*columns).alias("a"))
    right = b.select(*KEY, F.struct(*columns).alias("b"))
    both = left.join(right, KEY, "full_outer")
    return both.agg(
        F.count("*").alias("compared"),
        F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"),
    ).select(F.lit(name).alias("output"), "compared", "differing")


QUERIES = {
    "change_status": change_status,
    "hash_versions": hash_versions,
    "price_history": price_history,
    "availability_history": availability_history,
    "missing_aging": missing_aging,
    "unavailable_by_run": unavailable_by_run,
    "missing_products": missing_products,
    "state_after_run": state_after_run,
    "replay_final_state": replay_final_state,
    "batch_equals_replay": batch_equals_replay,
}

# One observation per product and run: the last event of the day.
_LAST = """
ev AS (
  SELECT user_id % 3 + 1 AS site_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS run_no,
         'https://shop.example/u/' || user_id AS canonical_url, 'U' || user_id AS external_id,
         'User ' || user_id AS title,
         CAST(CAST(floor(value / 100) * 100 AS DECIMAL(14,2)) AS VARCHAR) AS price,
         CASE WHEN event_type = 'error' THEN 'out_of_stock' ELSE 'in_stock' END AS avail,
         props, ts, event_id
  FROM events),
last AS (
  SELECT *, sha256(CAST(to_json(struct_pack(
      availability := avail, brand := NULL, category := NULL, currency := NULL,
      current_price := price, description := NULL, highlights := NULL, images := NULL,
      model_number := NULL, original_price := NULL, rating := NULL, review_count := NULL,
      sku := NULL, specifications := NULL, subcategory := NULL, title := title,
      whats_in_the_box := NULL)) AS VARCHAR)) AS hash
  FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url, run_no
                                     ORDER BY ts DESC, event_id DESC) AS rn FROM ev)
  WHERE rn = 1),
runs AS (
  SELECT DISTINCT site_id, run_no, site_id * 1000 + run_no AS run_id, run_no % 5 = 3 AS limited,
         run_no % 3 + 1 AS thr,
         strftime(DATE '2024-01-01' + CAST(run_no AS INTEGER), '%Y-%m-%d') || ' 00:00:00' AS run_ts
  FROM ev)
"""
# The same rules run by run: every product at every run since it was first seen.
_GRID = _LAST + """,
firsts AS (SELECT site_id, canonical_url, min(run_no) AS first_no FROM last GROUP BY ALL),
grid AS (
  SELECT f.site_id, f.canonical_url, r.run_no, r.run_id, r.run_ts, r.limited, r.thr,
         l.hash, l.price, l.avail, l.canonical_url IS NOT NULL AS seen
  FROM firsts f JOIN runs r ON r.site_id = f.site_id AND r.run_no >= f.first_no
  LEFT JOIN last l ON l.canonical_url = f.canonical_url AND l.run_no = r.run_no),
islands AS (
  SELECT *, max(CASE WHEN seen THEN run_no END) OVER (PARTITION BY canonical_url ORDER BY run_no) AS island,
         NOT seen AND NOT limited AS missed
  FROM grid),
counted AS (
  SELECT *, sum(CAST(missed AS INTEGER)) OVER (PARTITION BY canonical_url, island ORDER BY run_no) AS misses
  FROM islands),
aged AS (
  SELECT *, min(CASE WHEN missed AND misses >= thr THEN run_no END)
              OVER (PARTITION BY canonical_url, island ORDER BY run_no) AS gone_no,
         max(avail) OVER (PARTITION BY canonical_url, island) AS island_avail
  FROM counted),
full_state AS (
  SELECT *, CASE WHEN gone_no IS NOT NULL THEN 'unavailable' ELSE island_avail END AS status
  FROM aged)
"""
_STATE = """
tail AS (
  SELECT * FROM full_state QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY run_no DESC) = 1),
touch AS (
  SELECT canonical_url, max(run_ts) FILTER (WHERE seen) AS seen_ts, min(run_ts) AS first_ts,
         max(run_ts) FILTER (WHERE seen OR missed) AS touched_ts
  FROM full_state GROUP BY ALL),
state AS (
  SELECT t.site_id, t.canonical_url, l.external_id, l.title, CAST(l.price AS DOUBLE) AS current_price,
         'USD' AS currency, t.status AS availability, CAST(0 AS BIGINT) AS review_count,
         l.hash AS content_hash, l.props AS raw_data, CAST(t.misses AS BIGINT) AS consecutive_missing_runs,
         c.first_ts AS first_seen_at, c.seen_ts AS last_seen_at,
         strftime(DATE '2024-01-01' + CAST(t.gone_no AS INTEGER), '%Y-%m-%d') || ' 00:00:00' AS unavailable_since,
         c.touched_ts AS updated_at
  FROM tail t JOIN touch c USING (canonical_url)
  JOIN last l ON l.canonical_url = t.canonical_url AND l.run_no = t.island)
"""
_STEPS = _LAST + """,
steps AS (
  SELECT l.*, r.run_id, r.run_ts,
         lag(hash) OVER w AS old_hash, lag(price) OVER w AS old_price_text
  FROM last l JOIN runs r USING (site_id, run_no)
  WINDOW w AS (PARTITION BY canonical_url ORDER BY l.run_no))
"""
_AVAILABILITY = _GRID + """,
moves AS (
  SELECT *, lag(status) OVER (PARTITION BY canonical_url ORDER BY run_no) AS old_status FROM full_state)
"""

SQL = {
    "hash_versions": r"""
WITH e AS (
  SELECT user_id % 3 + 1 AS site_id, 'https://shop.example/u/' || user_id AS canonical_url, 'User ' || user_id AS title,
    CASE WHEN event_type = 'error' THEN 'out_of_stock' ELSE 'in_stock' END AS avail,
    CAST(CAST(floor(value / 100) * 100 AS DECIMAL(14,2)) AS VARCHAR) AS price, event_id % 2 AS half, ts, event_id
  FROM events),
l AS (
  SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY site_id, canonical_url, half ORDER BY ts DESC, event_id DESC) = 1),
a AS (SELECT *, sha256('{"availability":"' || avail || '","title":"' || title || '"}') AS hash FROM l WHERE half = 0),
b AS (
  SELECT *, sha256('{"availability":"' || avail || '","current_price":"' || price || '","title":"' || title || '"}') AS hash
  FROM l WHERE half = 1)
SELECT b.site_id, b.canonical_url,
  CASE WHEN a.avail IS NULL THEN 'new' WHEN a.avail = b.avail THEN 'unchanged' ELSE 'updated' END AS change_status,
  b.hash AS content_hash, a.hash IS NOT NULL AS fields_changed, coalesce(a.hash, '') AS old_hash
FROM b LEFT JOIN a USING (site_id, canonical_url)""",
    "change_status": f"""
WITH {_STEPS}
SELECT site_id, canonical_url, run_no,
       CASE WHEN old_hash IS NULL THEN 'new' WHEN old_hash <> hash THEN 'updated' ELSE 'unchanged' END
         AS change_status,
       hash AS content_hash
FROM steps""",
    "price_history": f"""
WITH {_STEPS}
SELECT site_id, canonical_url, run_id, CAST(old_price_text AS DOUBLE) AS old_price,
       CAST(price AS DOUBLE) AS new_price, 'USD' AS currency, run_ts AS changed_at
FROM steps WHERE old_hash IS NOT NULL
  AND CAST(old_price_text AS DECIMAL(14,2)) IS DISTINCT FROM CAST(price AS DECIMAL(14,2))""",
    "availability_history": f"""
WITH {_AVAILABILITY}
SELECT site_id, canonical_url, run_id, old_status, avail AS new_status, run_ts AS changed_at
FROM moves WHERE seen AND old_status IS NOT NULL AND old_status <> avail""",
    "missing_aging": f"""
WITH {_GRID}
SELECT site_id, canonical_url, island AS last_seen_no, CAST(max(misses) AS BIGINT) AS missed_runs,
       CAST(coalesce(min(gone_no), -1) AS BIGINT) AS unavailable_from_no
FROM aged GROUP BY site_id, canonical_url, island HAVING max(misses) > 0""",
    "unavailable_by_run": f"""
WITH {_GRID},
stock AS (
  SELECT site_id, run_no, count(*) FILTER (WHERE missed AND gone_no IS NOT NULL) AS n
  FROM aged GROUP BY ALL)
SELECT r.site_id, r.run_id, r.run_no,
       CAST(CASE WHEN r.limited THEN 0 ELSE coalesce(s.n, 0) END AS BIGINT) AS unavailable
FROM runs r LEFT JOIN stock s USING (site_id, run_no)""",
    "missing_products": f"""
WITH {_GRID}
SELECT site_id, canonical_url, status AS availability FROM full_state
QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY run_no DESC) = 1 AND NOT seen""",
    "replay_final_state": f"WITH {_GRID},\n{_STATE}\nSELECT * FROM state",
    "state_after_run": f"""
WITH {_GRID},
{_STATE}
SELECT s.*, CASE WHEN NOT t.seen THEN 'missing'
                 WHEN p.canonical_url IS NULL THEN 'new'
                 WHEN p.hash <> s.content_hash THEN 'updated' ELSE 'unchanged' END AS change_status
FROM state s JOIN tail t USING (canonical_url)
LEFT JOIN (SELECT l.canonical_url, l.hash FROM last l JOIN tail t USING (canonical_url)
           WHERE l.run_no < t.run_no
           QUALIFY row_number() OVER (PARTITION BY l.canonical_url ORDER BY l.run_no DESC) = 1) p
  USING (canonical_url)""",
    "batch_equals_replay": f"""
WITH {_AVAILABILITY},
ends AS (SELECT site_id, max(run_no) AS run_no FROM runs GROUP BY ALL),
prices AS (
  SELECT site_id, canonical_url, run_no, price,
         lag(price) OVER (PARTITION BY canonical_url ORDER BY run_no) AS old_price
  FROM last)
SELECT 'state' AS output, count(*) AS compared, CAST(0 AS BIGINT) AS differing FROM firsts
UNION ALL
SELECT 'price_history', count(*), CAST(0 AS BIGINT) FROM prices JOIN ends USING (site_id, run_no)
WHERE old_price IS NOT NULL AND old_price <> price
UNION ALL
SELECT 'availability_history', count(*), CAST(0 AS BIGINT) FROM moves JOIN ends USING (site_id, run_no)
WHERE seen AND old_status IS NOT NULL AND old_status <> avail""",
}
