"""Child-table operators over line items, parts, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from ..operators import children
from ..operators.keyed import first_wins, insert_if_absent
from ..plans import views
from ..schemas import KEY
from ..sources.tables import table

T1, T2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def _stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _str(name: str) -> Column:
    return F.col(name).cast("string")


def _supplier_links(spark: SparkSession, d: str) -> DataFrame:
    """Line items as links on a supplier's page to their parts; codes follow from the keys,
    so they are written out only for the rows that stay."""
    return table(spark, d, "lineitem").select(
        "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"
    )


def _code() -> Column:
    return views.part_code(F.col("l_partkey"))


def _shown() -> Column:
    price = F.concat(F.lit(" $"), F.format_number("l_extendedprice", 2))
    return F.concat(F.lit("Part "), _str("l_partkey"), price)


_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"]


def relations_topk(spark: SparkSession, d: str) -> DataFrame:
    """Related parts of a supplier's page: first link per part, ranked by code."""
    links = _supplier_links(spark, d).where("l_partkey <> l_suppkey")
    firsts = children.first_per_id(links, ["l_suppkey"], "l_partkey", _ORDER)
    coded = firsts.withColumn("code", _code())
    kept = children.top_per_owner(coded, ["l_suppkey"], ["code"])
    return kept.withColumn("shown", _shown()).select(
        "l_suppkey", F.col("rank").cast("bigint").alias("rank"), "code",
        F.col("shown").alias("name"),
        text.price(F.col("shown")).cast("double").alias("price"),
    )


def variants_topk(spark: SparkSession, d: str) -> DataFrame:
    """Options of a supplier's page: title, else text, else code as label; ranked by code."""
    title = F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" Size "), _str("l_linenumber")))
    shown = F.when(F.col("l_returnflag") == "N", _shown())
    label = text.strip(text.first_filled(title, shown, _code()))
    only_code = "l_partkey = l_suppkey and l_returnflag not in ('A', 'N')"
    options = _supplier_links(spark, d).where(f"not ({only_code})")
    firsts = children.first_per_id(options, ["l_suppkey"], "l_partkey", _ORDER)
    labelled = firsts.select("l_suppkey", _code().alias("code"), label.alias("label"))
    kept = children.top_per_owner(labelled, ["l_suppkey"], ["code", "label"])
    return kept.select(
        "l_suppkey", F.col("rank").cast("bigint").alias("rank"), "code",
        F.col("label").alias("value"),
    )


def _turns(spark: SparkSession, d: str, seen: str) -> DataFrame:
    """Conversation turns as reviews of their conversation."""
    none = F.lit(None).cast("string")
    entry = F.struct(
        none.alias("external_id"), F.col("role").alias("reviewer_name"),
        F.lit(None).cast("date").alias("review_date"), F.lit("4.5").alias("rating"),
        none.alias("title"), F.col("text").alias("text"),
        F.lit(True).alias("verified_purchase"),
    )
    return table(spark, d, "conversations").select(
        F.lit(1).cast("bigint").alias("site_id"),
        F.concat(F.lit(f"{views.SHOP}/c/"), _str("conv_id")).alias("canonical_url"),
        F.lit(seen).cast("timestamp").alias("seen_at"),
        F.col("turn").cast("int").alias("pos"), entry.alias("entry"),
    )


def reviews_sync(spark: SparkSession, d: str) -> DataFrame:
    """Stored: user turns. The batch brings all turns of conversations of three or more."""
    stored = children.review_rows(_turns(spark, d, T1).where("entry.reviewer_name = 'user'"))
    again = _turns(spark, d, T2)
    touched = again.groupBy(*KEY).agg(F.max("pos").alias("top")).where("top >= 2").select(*KEY)
    fresh = children.review_rows(again.join(touched, KEY, "left_semi"))
    return children.replace(stored, fresh, touched).select(
        "canonical_url", "reviewer_name", F.col("rating").cast("double").alias("rating"),
        "review_text", "review_hash", "verified_purchase", _stamp("first_seen_at"),
    )


def _part_specs(parts: DataFrame, seen: str, rows: list[tuple[str, str, Column]]) -> DataFrame:
    listed = F.array(
        *[
            F.struct(
                F.lit(s).cast("string").alias("section"), F.lit(n).alias("name"), v.alias("value")
            )
            for s, n, v in rows
        ]
    )
    return parts.select(
        F.lit(1).cast("bigint").alias("site_id"), views.part_url(F.col("p_partkey")).alias("canonical_url"),
        F.lit(seen).cast("timestamp").alias("run_ts"), listed.alias("specifications"),
    )


def specs_replace(spark: SparkSession, d: str) -> DataFrame:
    """Stored: two rows per part. The batch replaces those of the larger parts."""
    parts = table(spark, d, "part")
    size = _str("p_size")
    old = _part_specs(parts, T1, [(None, "Brand", F.col("p_brand")), ("Tech", "Size", size)])
    new = _part_specs(
        parts.where("p_size > 25"), T2,
        [("Tech", "Size", size), ("Tech", "Type", F.col("p_type")), ("Tech", "Size", size)],
    )
    stored = children.specification_rows(children.entries(old, "specifications"))
    fresh = children.specification_rows(children.entries(new, "specifications"))
    return children.replace(stored, fresh, children.products_of(new)).select(
        "canonical_url", "section", "spec_name", "spec_value", _stamp("first_seen_at")
    )


def _line_images(spark: SparkSession, d: str, flags: list[str], seen: str) -> DataFrame:
    url = F.concat(F.lit("https://img.example/"), _str("l_partkey"))
    entry = F.struct(
        url.alias("url"),
        F.concat(url, F.lit("?s="), _str("l_suppkey")).alias("high_resolution_url"),
        F.when(F.col("l_linestatus") == "F", "main").alias("type"),
    )
    pos = (F.col("l_linenumber") * 100_000 + F.col("l_suppkey") * 2
           + (F.col("l_linestatus") == "F").cast("int")).cast("int")
    line = table(spark, d, "lineitem").where(F.col("l_returnflag").isin(flags))
    return line.select(*views.line_child(entry, pos, seen))


def images_sync(spark: SparkSession, d: str) -> DataFrame:
    """Stored: images of lines A and R. The batch brings lines R and N of its orders."""
    stored = children.image_rows(_line_images(spark, d, ["A", "R"], T1))
    batch = _line_images(spark, d, ["R", "N"], T2)
    touched = batch.select(*KEY).distinct()
    synced = children.sync_images(stored, children.image_rows(batch), touched)
    return synced.select(
        "canonical_url", "image_url", "high_resolution_url", "image_type",
        F.col("display_order").cast("bigint").alias("display_order"),
        _stamp("first_seen_at"), _stamp("last_seen_at"),
    )


def images_gone(spark: SparkSession, d: str) -> DataFrame:
    """Stored images of the batch's orders that their new lists no longer hold."""
    stored = children.image_rows(_line_images(spark, d, ["A", "R"], T1))
    batch = _line_images(spark, d, ["R", "N"], T2)
    gone = children.gone_images(stored, children.image_rows(batch), batch.select(*KEY).distinct())
    return gone.select("canonical_url", "image_url")


def null_key_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """First order per customer, priority and year, but open orders have no year and never
    collide; then only those whose key a finished order does not hold yet."""
    year = F.when(F.col("o_orderstatus") != "O", F.year("o_orderdate")).cast("bigint")
    o = table(spark, d, "orders").withColumn("year", year)
    keys = ["o_custkey", "o_orderpriority", "year"]
    rows = first_wins(o.where("o_orderstatus <> 'F'"), keys, ["o_orderkey"], ["year"])
    target = o.where("o_orderstatus = 'F'")
    return insert_if_absent(target, rows, keys).select(
        "o_custkey", "o_orderpriority", F.coalesce("year", F.lit(0)).alias("year"), "o_orderkey"
    )


QUERIES = {
    f.__name__: f
    for f in (
        relations_topk, variants_topk, reviews_sync, specs_replace, images_sync, images_gone,
        null_key_dedupe,
    )
}

_LINKS = """
links AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_returnflag,
         'P' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS own_code,
         'P' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS code,
         'Part ' || l_partkey || ' $' || format('{:,.2f}', l_extendedprice) AS shown
  FROM lineitem)"""
_FIRST = "row_number() OVER (PARTITION BY l_suppkey, code ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_returnflag) = 1"
_IMAGES = """
lines AS (
  SELECT 'https://shop.example/o/' || l_orderkey AS canonical_url,
         'https://img.example/' || l_partkey AS image_url,
         'https://img.example/' || l_partkey || '?s=' || l_suppkey AS high_resolution_url,
         CASE WHEN l_linestatus = 'F' THEN 'main' ELSE 'gallery' END AS image_type,
         l_linenumber * 100000 + l_suppkey * 2 + CAST(l_linestatus = 'F' AS INTEGER) AS display_order, l_returnflag
  FROM lineitem),
stored AS (
  SELECT * FROM lines WHERE l_returnflag IN ('A', 'R')
  QUALIFY row_number() OVER (PARTITION BY canonical_url, image_url ORDER BY display_order DESC) = 1),
batch AS (
  SELECT * FROM lines WHERE l_returnflag IN ('R', 'N')
  QUALIFY row_number() OVER (PARTITION BY canonical_url, image_url ORDER BY display_order DESC) = 1)"""

SQL = {
    "relations_topk": f"""
WITH {_LINKS},
firsts AS (SELECT * FROM links WHERE code <> own_code QUALIFY {_FIRST})
SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY code) AS rank, code, shown AS name,
       CAST(CAST(split_part(shown, ' ', 2) AS DECIMAL(14,2)) AS DOUBLE) AS price
FROM firsts""",
    "variants_topk": f"""
WITH {_LINKS},
labelled AS (
  SELECT *, CASE l_returnflag WHEN 'A' THEN 'Size ' || l_linenumber WHEN 'N' THEN shown ELSE code END AS value
  FROM links),
firsts AS (SELECT * FROM labelled WHERE NOT (code = own_code AND value = code) QUALIFY {_FIRST})
SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY code) AS rank, code, value
FROM firsts""",
    "reviews_sync": """
WITH turns AS (
  SELECT 'https://shop.example/c/' || conv_id AS canonical_url, turn, role AS reviewer_name, text AS review_text,
         sha256(CAST(to_json(struct_pack(external_id := NULL, rating := '4.5', review_date := NULL,
           reviewer_name := role, text := text, title := NULL, verified_purchase := TRUE)) AS VARCHAR)) AS review_hash,
         max(turn) OVER (PARTITION BY conv_id) >= 2 AS touched
  FROM conversations),
kept AS (
  SELECT *, CASE WHEN touched THEN '2024-01-02 00:00:00' ELSE '2024-01-01 00:00:00' END AS first_seen_at
  FROM turns WHERE touched OR reviewer_name = 'user'
  QUALIFY row_number() OVER (PARTITION BY canonical_url, review_hash ORDER BY turn) = 1)
SELECT canonical_url, reviewer_name, CAST(4.5 AS DOUBLE) AS rating, review_text, review_hash,
       TRUE AS verified_purchase, first_seen_at
FROM kept""",
    "specs_replace": """
WITH p AS (SELECT *, 'https://shop.example/dp/P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS canonical_url FROM part)
SELECT canonical_url, 'General' AS section, 'Brand' AS spec_name, p_brand AS spec_value,
       '2024-01-01 00:00:00' AS first_seen_at FROM p WHERE p_size <= 25
UNION ALL
SELECT canonical_url, 'Tech', 'Size', CAST(p_size AS VARCHAR),
       CASE WHEN p_size <= 25 THEN '2024-01-01 00:00:00' ELSE '2024-01-02 00:00:00' END FROM p
UNION ALL
SELECT canonical_url, 'Tech', 'Type', p_type, '2024-01-02 00:00:00' FROM p WHERE p_size > 25""",
    "images_sync": f"""
WITH {_IMAGES}
SELECT b.canonical_url, b.image_url, b.high_resolution_url, b.image_type,
       CAST(b.display_order AS BIGINT) AS display_order,
       CASE WHEN s.image_url IS NULL THEN '2024-01-02 00:00:00' ELSE '2024-01-01 00:00:00' END AS first_seen_at,
       '2024-01-02 00:00:00' AS last_seen_at
FROM batch b LEFT JOIN stored s USING (canonical_url, image_url)
UNION ALL
SELECT canonical_url, image_url, high_resolution_url, image_type, CAST(display_order AS BIGINT),
       '2024-01-01 00:00:00', '2024-01-01 00:00:00'
FROM stored WHERE canonical_url NOT IN (SELECT canonical_url FROM batch)""",
    "images_gone": f"""
WITH {_IMAGES}
SELECT canonical_url, image_url FROM stored s
WHERE canonical_url IN (SELECT canonical_url FROM batch)
  AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.canonical_url = s.canonical_url AND b.image_url = s.image_url)""",
    "null_key_dedupe": """
WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN year(o_orderdate) END AS y FROM orders),
rows AS (
  SELECT * FROM o WHERE o_orderstatus = 'O'
  UNION ALL
  SELECT * FROM o WHERE o_orderstatus = 'P'
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority, y ORDER BY o_orderkey) = 1)
SELECT o_custkey, o_orderpriority, CAST(coalesce(y, 0) AS BIGINT) AS year, o_orderkey FROM rows r
WHERE NOT EXISTS (SELECT 1 FROM o f WHERE f.o_orderstatus = 'F' AND f.o_custkey = r.o_custkey
                  AND f.o_orderpriority = r.o_orderpriority AND f.y = r.y)""",
}
