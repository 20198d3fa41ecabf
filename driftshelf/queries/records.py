"""Field rules over the given tables: texts built from their columns, read back by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, jsonld, text, urls
from ..plans import views
from ..sources import feeds
from ..sources.style_a import image_entries
from ..sources.tables import table


def _str(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.groupBy(urls.canonicalize_url(F.col("url")).alias("canonical_url")).agg(
        F.count("*").alias("pages"), F.min(urls.url_host(F.col("url"))).alias("host")
    )


def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Links of every page resolved against it."""
    hrefs = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    links = table(spark, d, "pages").select(
        "page_id", "url", F.explode(hrefs).alias("raw")
    ).select("page_id", "url", F.replace("raw", F.lit("&amp;"), F.lit("&")).alias("href"))
    resolved = links.withColumn("link", urls.resolve(F.col("url"), F.col("href")))
    return resolved.select(
        "page_id", "href", "link", urls.last_segment(F.col("link")).alias("external_id")
    )


def price_text(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("k"),
        F.concat(F.lit("$"), F.format_number("p_retailprice", 2), F.lit(" each")).alias("label"),
    )
    lines = table(spark, d, "lineitem").select(
        F.lit("line").alias("kind"), F.col("l_orderkey").alias("k"),
        F.concat(
            F.when(F.col("l_returnflag") == "A", "Hello, ").otherwise("USD "),
            F.format_number("l_extendedprice", 2),
        ).alias("label"),
    )
    label = F.col("label")
    return parts.unionByName(lines).select(
        "kind", "k", text.price_text(label).alias("cleaned"),
        text.price(label).cast("double").alias("price"),
    )


def _event_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, some broken: a value that does not fit, a cut line, a list, a blank."""
    e = table(spark, d, "events")
    kind, text_of = F.col("event_id") % 9, _str("event_id")
    count = F.when(kind == 1, F.lit('"many"')).when(
        kind == 2, _str(F.lit(3000000000) + F.col("event_id"))).otherwise(_str("user_id"))
    address = F.when(kind == 5, "address").otherwise("canonical_url")
    more = F.when(kind == 6, F.lit(',"images":"x"')).otherwise("")
    whole = F.concat(
        F.lit('{"site_id":'), _str(F.col("user_id") % 3 + 1), F.lit(',"run_id":'), text_of, F.lit(',"item_seq":'),
        F.when(kind == 6, F.lit("1.5")).otherwise(text_of), F.lit(',"'), address, F.lit(f'":"{views.SHOP}/u/'),
        _str("user_id"), F.lit('","title":"'), F.col("event_type"), F.lit('","review_count":'), count, more,
        F.lit(',"raw_data":'), F.col("props"), F.lit("}"),
    )
    line = (F.when(kind == 3, F.substr(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int")))
            .when(kind == 4, F.concat(F.lit("["), whole, F.lit("]"))).when(kind == 7, F.lit(" \t")).otherwise(whole))
    return e.select("event_id", line.alias("line"))


def feed_records(spark: SparkSession, d: str) -> DataFrame:
    """Every line with what could be read of it, and why it is no record."""
    rows = feeds.parsed_lines(_event_lines(spark, d)).withColumn("k", F.get_json_object("raw_data", "$.k"))
    numbers = ("site_id", "run_id", "item_seq", "review_count", "k")
    return rows.select(
        "event_id", *[F.coalesce(F.col(n).cast("bigint"), F.lit(-1)).alias(n) for n in numbers],
        "url", "title", "error_type", "error_message",
    )


def brand_clean(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 4
    byline = (
        F.when(size == 0, F.concat(F.lit("Visit the "), "p_brand", F.lit(" Store")))
        .when(size == 1, F.concat(F.lit("brand:  "), "p_brand"))
        .when(size == 2, F.concat(F.lit(" "), "p_brand", F.lit(" \t")))
    )
    p = table(spark, d, "part").withColumn("byline", byline)
    model = F.when(size == 3, F.lit("")).otherwise(F.col("p_type"))
    return p.select(
        "p_partkey",
        text.first_filled(
            text.clean_brand(F.col("byline")), text.first_word(F.col("p_name"))
        ).alias("brand"),
        text.first_filled(model, F.concat(F.lit("M"), _str("p_size"))).alias("model_number"),
        text.clean_text(F.when(size == 2, F.lit("   ")).otherwise(F.col("byline"))).alias("line"),
    )


def box_contents(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    listed = F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(", ,"), "p_type", F.lit(" "))
    lines = F.array(
        F.concat(F.lit(" "), "p_name"), F.lit(" › See more product details "), F.lit(" "), "p_type"
    )
    blocks = F.array("p_name", F.lit(""), "p_type", "p_name", F.lit(None).cast("string"))
    return p.select(
        "p_partkey",
        F.array_join(text.split_list(listed), "|").alias("box"),
        F.array_join(text.highlight_lines(lines), "|").alias("highlights"),
        text.join_blocks(blocks).alias("description"),
    )


def category_paths(spark: SparkSession, d: str) -> DataFrame:
    """Breadcrumbs region > nation, and stock texts from the customer segment."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(
        r, F.col("n_regionkey") == F.col("r_regionkey")
    )
    rich = F.col("c_acctbal") > 0
    crumbs = F.when(rich, F.array(F.lit(" Home "), "r_name", F.lit(" "), "n_name")).otherwise(
        F.array(F.lit("HOME"), "r_name")
    )
    parts = joined.withColumn("parts", text.without_home(crumbs))
    schema = F.when(F.col("c_mktsegment") == "MACHINERY", "https://schema.org/OutOfStock").when(
        F.col("c_mktsegment") == "BUILDING", "InStock"
    )
    line = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Currently UNAVAILABLE.").otherwise("In stock")
    return parts.select(
        "c_custkey", text.item(F.col("parts"), 1).alias("category"),
        text.category_second(F.col("parts")).alias("second"),
        text.category_last(F.col("parts")).alias("last"),
        text.stock_from_schema(schema).alias("stock_a"),
        text.stock_from_text(line).alias("stock_b"),
    )


def rating_counts(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    tenth = F.format_number(F.col("l_quantity") / 10, 1)
    rating = F.concat(tenth, F.lit(" out of 5 stars"))
    none = F.when(F.col("l_returnflag") == "A", "no reviews yet")
    count = F.coalesce(
        none, F.concat(F.format_number(F.floor("l_extendedprice"), 0), F.lit(" ratings"))
    )
    return line.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        text.to_decimal(text.price_text(rating), 4, 2).cast("double").alias("rating"),
        text.first_count(count).cast("bigint").alias("first_count"),
        text.comma_count(count).cast("bigint").alias("comma_count"),
    )


def review_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    line = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(day, F.lit(" was the day")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("Reviewed on Smarch 3, 1999"))
        .otherwise(F.concat(F.lit("Reviewed in Nation on "), day))
    )
    badge = F.when(F.col("o_orderstatus") == "F", "Verified Purchase")
    return o.select(
        "o_orderkey", text.review_date(line).cast("string").alias("review_date"),
        badge.isNotNull().alias("verified_purchase"),
    )


def image_urls(spark: SparkSession, d: str) -> DataFrame:
    """Image records per part: size tokens dropped, distinct, sorted, first is main."""
    stem = F.concat(F.lit("https://img.example/I/p"), _str("p_partkey"))
    other = F.concat(F.lit("https://img.example/I/p"), _str(F.col("p_partkey") + 1))
    found = F.array(
        F.concat(stem, F.lit("._SX300_.jpg")), F.concat(stem, F.lit("._AC_SL1500_.jpg")),
        F.concat(other, F.lit("._SS40_.PNG")), F.concat(stem, F.lit(".b.webp")),
        F.concat(stem, F.lit("._x_.gif")),
    )
    full = F.array_sort(F.array_distinct(F.transform(found, text.full_size_image)))
    p = table(spark, d, "part").select("p_partkey", F.posexplode(image_entries(full)).alias("pos", "image"))
    return p.select(
        "p_partkey", F.col("pos").cast("bigint").alias("display_order"),
        F.col("image.url").alias("url"), F.col("image.type").alias("type"),
    )


def _coded_text() -> Column:
    code, which = views.part_code(F.col("p_partkey")), F.col("p_size") % 7
    return (
        F.when(which == 0, F.concat(F.lit("https://h.example/x/dp/"), F.lower(code)))
        .when(which == 1, F.concat(F.lit("/gp/product/"), code, F.lit("?ref=1")))
        .when(which == 2, F.concat(F.lit("https://h.example/dp/product/"), code, F.lit("/more")))
        .when(which == 3, F.concat(F.lit("  "), F.lower(code), F.lit("\n")))
        .when(which == 4, F.concat(F.lit("/dp/"), code, F.lit("#a")))
        .when(which == 5, F.concat(F.lit("/dp/"), code, F.lit("7")))
        .otherwise(code)
    )


def product_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("given", _coded_text())
    code = text.product_code(F.col("given"))
    return p.select(
        "p_partkey", code.alias("code"), text.product_url(code).alias("url"),
        text.is_code(F.col("given")).alias("bare_code"),
    )


def spec_lookup(spark: SparkSession, d: str) -> DataFrame:
    def spec(section: str, name: str, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(name).alias("name"), value.alias("value")
        )

    size = _str("p_size")
    specs = F.array(
        spec("Tech", "Brand", F.col("p_brand")), spec("General", "brand", F.concat(F.lit("x"), size)),
        spec("Tech", "BRAND", F.col("p_type")), spec("General", "Type", F.col("p_type")),
    )
    cells = F.filter(
        F.array(F.lit("Size"), size, F.when(F.col("p_size") > 25, "big").otherwise("")),
        lambda c: c != "",
    )
    return table(spark, d, "part").withColumn("specs", specs).select(
        "p_partkey", text.spec_value(F.col("specs"), "brand").alias("brand"),
        text.spec_value(F.col("specs"), "type").alias("type"),
        text.spec_value(F.col("specs"), "colour").alias("colour"),
        text.join_cells(cells).alias("size_value"),
        F.array_join(
            F.transform(F.array_sort("specs"), lambda s: F.concat(s["section"], F.lit("/"), s["name"])), ";"
        ).alias("sorted_names"),
    )


def _scripts() -> Column:
    """Structured-data blocks built from a part: a broken one, then a list with a product."""
    size = F.col("p_size")
    brand = F.when(size % 2 == 0, F.concat(F.lit('{"name":"'), "p_brand", F.lit('"}'))).otherwise(
        F.concat(F.lit('"'), "p_brand", F.lit('"'))
    )
    currency = (
        F.when(size % 3 == 0, F.lit(',"priceCurrency":"EUR"'))
        .when(size % 3 == 1, F.lit(',"priceCurrency":null')).otherwise("")
    )
    image = F.when(size % 5 == 0, F.lit('"http://i/a.jpg"')).when(
        size % 5 == 1, F.lit('["http://i/a.jpg","","http://i/b.jpg"]')
    ).otherwise("null")
    stock = F.when(size > 40, "OutOfStock").otherwise("InStock")
    offers = F.when(size == 50, F.lit("[]")).otherwise(
        F.concat(
            F.lit('{"price":"'), _str(F.col("p_retailprice").cast("decimal(14,2)")), F.lit('"'),
            currency, F.lit(',"availability":"https://schema.org/'), stock, F.lit('"}'),
        )
    )
    product = F.concat(
        F.lit('{"@type":"Product","name":"'), "p_name", F.lit('","brand":'), brand,
        F.lit(',"image":'), image, F.lit(',"offers":'), offers, F.lit("}"),
    )
    return F.array(
        F.lit("{broken"), F.lit('{"@type":"Thing","name":"no"}'),
        F.concat(F.lit('[{"@type":["Product"]},'), product, F.lit(',{"@type":"Product"}]')),
    )


def json_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("ld", jsonld.product_block(_scripts()))
    ld = F.col("ld")
    return p.select(
        "p_partkey", jsonld.read(ld, "$.name").alias("name"), jsonld.brand(ld).alias("brand"),
        text.price(jsonld.read(ld, "$.offers.price")).cast("double").alias("price"),
        jsonld.currency(ld, "USD").alias("currency"),
        text.stock_from_schema(jsonld.read(ld, "$.offers.availability")).alias("availability"),
        F.array_join(jsonld.image_list(ld), "|").alias("images"),
        F.coalesce(jsonld.bad_offers(ld), F.lit(False)).alias("bad_offers"),
    )


def raw_data_paths(spark: SparkSession, d: str) -> DataFrame:
    """Events per value of a key inside their raw data."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("events"))


def stable_hash_children(spark: SparkSession, d: str) -> DataFrame:
    """Image and review hashes of every line item."""
    url = F.concat(F.lit("https://img.example/"), _str("l_partkey"))
    image = F.struct(
        url.alias("url"), url.alias("high_resolution_url"), F.col("l_returnflag").alias("type")
    )
    review = F.struct(
        _str("l_suppkey").alias("external_id"), F.lit(None).cast("string").alias("reviewer_name"),
        F.to_date("l_shipdate").alias("review_date"),
        _str(F.col("l_quantity").cast("decimal(4,1)")).alias("rating"),
        F.concat(F.lit('say "'), "l_returnflag", F.lit('"\té\\')).alias("title"),
        F.col("l_linestatus").alias("text"), (F.col("l_tax") > 0).alias("verified_purchase"),
    )
    given = F.when(F.col("l_returnflag") == "R", "given").otherwise("")
    line = table(spark, d, "lineitem").withColumns({"image": image, "review": review})
    return line.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        hashing.image_hash(F.col("image")).alias("image_hash"),
        hashing.review_hash(F.col("review"), given).alias("review_hash"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        canonical_urls, link_resolution, price_text, feed_records, brand_clean, box_contents, category_paths,
        rating_counts, review_dates, image_urls, product_ids, spec_lookup, json_paths,
        raw_data_paths, stable_hash_children,
    )
}

SQL = {
    "canonical_urls": r"""
WITH parts AS (
  SELECT lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
         rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path
  FROM pages)
SELECT scheme || '://' || host || path AS canonical_url, count(*) AS pages, min(host) AS host
FROM parts GROUP BY 1""",
    "link_resolution": r"""
WITH links AS (
  SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) AS origin,
         replace(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '&amp;', '&') AS href
  FROM pages)
SELECT page_id, href, origin || href AS link,
       list_extract(string_split(rtrim(regexp_replace(href, '[?#].*$', ''), '/'), '/'), -1) AS external_id
FROM links""",
    "feed_records": r"""
WITH w AS (
  SELECT event_id, event_id % 9 AS kind,
    '{"site_id":' || (user_id % 3 + 1) || ',"run_id":' || event_id || ',"item_seq":'
    || CASE WHEN event_id % 9 = 6 THEN '1.5' ELSE event_id::VARCHAR END || ',"'
    || CASE WHEN event_id % 9 = 5 THEN 'address' ELSE 'canonical_url' END || '":"https://shop.example/u/' || user_id
    || '","title":"' || event_type || '","review_count":'
    || CASE event_id % 9 WHEN 1 THEN '"many"' WHEN 2 THEN (3000000000 + event_id)::VARCHAR ELSE user_id::VARCHAR END
    || CASE WHEN event_id % 9 = 6 THEN ',"images":"x"' ELSE '' END || ',"raw_data":' || props || '}' AS whole
  FROM events),
l AS (
  SELECT event_id, CASE kind WHEN 3 THEN left(whole, length(whole) // 2) WHEN 4 THEN '[' || whole || ']' ELSE whole END AS line
  FROM w WHERE kind <> 7),
o AS (
  SELECT event_id, json_valid(line) AND coalesce(json_type(CASE WHEN json_valid(line) THEN line END), '') = 'OBJECT' AS sound, line
  FROM l),
j AS (SELECT event_id, sound, CASE WHEN sound THEN line ELSE '{}' END AS doc FROM o),
v AS (
  SELECT event_id, sound, json_extract_string(doc, '$.canonical_url') AS url, json_extract_string(doc, '$.title') AS title,
    json_extract_string(doc, '$.site_id')::BIGINT AS site_id, json_extract_string(doc, '$.run_id')::BIGINT AS run_id,
    CASE WHEN json_type(doc, '$.item_seq') = 'UBIGINT' THEN json_extract_string(doc, '$.item_seq')::BIGINT END AS item_seq,
    CASE WHEN json_type(doc, '$.review_count') = 'UBIGINT' THEN TRY_CAST(json_extract_string(doc, '$.review_count') AS INTEGER)::BIGINT END
      AS review_count,
    json_extract_string(doc, '$.raw_data.k')::BIGINT AS k, doc
  FROM j),
m AS (
  SELECT *, concat_ws(', ',
      CASE WHEN json_exists(doc, '$.item_seq') AND item_seq IS NULL THEN 'item_seq' END,
      CASE WHEN json_exists(doc, '$.review_count') AND review_count IS NULL THEN 'review_count' END,
      CASE WHEN json_exists(doc, '$.images') AND json_type(doc, '$.images') <> 'ARRAY' THEN 'images' END
    ) AS misfits
  FROM v),
r AS (
  SELECT *, CASE WHEN NOT sound THEN 'not a JSON object' WHEN misfits <> '' THEN 'does not fit: ' || misfits
    WHEN url IS NULL THEN 'missing: canonical_url' END AS error_message
  FROM m)
SELECT event_id, coalesce(site_id, -1) AS site_id, coalesce(run_id, -1) AS run_id, coalesce(item_seq, -1) AS item_seq, url, title,
  coalesce(review_count, -1) AS review_count, coalesce(k, -1) AS k,
  CASE WHEN error_message IS NOT NULL THEN 'invalid_record' END AS error_type, error_message
FROM r""",
    "price_text": r"""
WITH t AS (
  SELECT 'part' AS kind, p_partkey AS k, '$' || format('{:,.2f}', p_retailprice) || ' each' AS label FROM part
  UNION ALL
  SELECT 'line', l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'Hello, ' ELSE 'USD ' END
         || format('{:,.2f}', l_extendedprice) FROM lineitem),
n AS (
  SELECT *, nullif(replace(regexp_extract(label, '-?[0-9,]+(?:\.[0-9]+)?'), ',', ''), '') AS cleaned FROM t)
SELECT kind, k, cleaned,
       CAST(TRY_CAST(cleaned AS DECIMAL(14,2)) AS DOUBLE) AS price
FROM n""",
    "brand_clean": r"""
WITH t AS (
  SELECT *, CASE p_size % 4 WHEN 0 THEN 'Visit the ' || p_brand || ' Store'
                            WHEN 1 THEN 'brand:  ' || p_brand
                            WHEN 2 THEN chr(160) || p_brand || ' ' || chr(9) END AS byline
  FROM part)
SELECT p_partkey,
       CASE WHEN p_size % 4 = 3 THEN string_split(p_name, ' ')[1] ELSE p_brand END AS brand,
       CASE WHEN p_size % 4 = 3 THEN 'M' || p_size ELSE p_type END AS model_number,
       CASE WHEN p_size % 4 = 2 THEN NULL ELSE byline END AS line
FROM t""",
    "box_contents": r"""
SELECT p_partkey,
       array_to_string(list_filter(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda x: trim(x)),
                                   lambda x: x <> ''), '|') AS box,
       p_name || '|' || p_type AS highlights,
       CASE WHEN p_name = p_type THEN p_name ELSE p_name || chr(10) || chr(10) || p_type END AS description
FROM part""",
    "category_paths": r"""
SELECT c_custkey, r_name AS category, CASE WHEN c_acctbal > 0 THEN n_name END AS second,
       CASE WHEN c_acctbal > 0 THEN n_name END AS last,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'out_of_stock' ELSE 'in_stock' END AS stock_a,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'out_of_stock' ELSE 'in_stock' END AS stock_b
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "rating_counts": r"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(CAST(l_quantity / 10 AS DECIMAL(4,2)) AS DOUBLE) AS rating,
       CASE WHEN l_returnflag = 'A' THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS first_count,
       CASE WHEN l_returnflag = 'A' THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS comma_count
FROM lineitem""",
    "review_dates": r"""
SELECT o_orderkey,
       CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
            THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS review_date,
       o_orderstatus = 'F' AS verified_purchase
FROM orders""",
    "image_urls": r"""
WITH u AS (
  SELECT p_partkey, list_sort(list_distinct(
      [s || '.jpg', s || '.jpg', o || '.PNG', s || '.b.webp', s || '._x_.gif'])) AS urls
  FROM (SELECT p_partkey, 'https://img.example/I/p' || p_partkey AS s,
               'https://img.example/I/p' || (p_partkey + 1) AS o FROM part))
SELECT p_partkey, pos - 1 AS display_order, urls[pos] AS url,
       CASE WHEN pos = 1 THEN 'main' ELSE 'gallery' END AS type
FROM (SELECT p_partkey, urls, unnest(range(1, len(urls) + 1)) AS pos FROM u)""",
    "product_ids": r"""
WITH t AS (SELECT p_partkey, p_size % 7 AS w, 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS code FROM part)
SELECT p_partkey, CASE WHEN w NOT IN (4, 5) THEN code END AS code,
       CASE WHEN w NOT IN (4, 5) THEN 'https://www.amazon.com/dp/' || code END AS url,
       w = 6 AS bare_code
FROM t""",
    "spec_lookup": r"""
SELECT p_partkey, greatest_by_name AS brand, p_type AS type, CAST(NULL AS VARCHAR) AS colour,
       CASE WHEN p_size > 25 THEN p_size || ' | big' ELSE CAST(p_size AS VARCHAR) END AS size_value,
       'General/Type;General/brand;Tech/BRAND;Tech/Brand' AS sorted_names
FROM (SELECT p.*, (SELECT arg_max(v, (s, n, v)) FROM (VALUES ('Tech', 'Brand', p_brand),
             ('General', 'brand', 'x' || p_size), ('Tech', 'BRAND', p_type)) AS x(s, n, v)) AS greatest_by_name
      FROM part p)""",
    "json_paths": r"""
SELECT p_partkey, p_name AS name, p_brand AS brand,
       CASE WHEN p_size <> 50 THEN CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS DOUBLE) END AS price,
       CASE WHEN p_size = 50 THEN 'USD' WHEN p_size % 3 = 0 THEN 'EUR' WHEN p_size % 3 = 2 THEN 'USD' END AS currency,
       CASE WHEN p_size > 40 AND p_size <> 50 THEN 'out_of_stock' ELSE 'in_stock' END AS availability,
       CASE p_size % 5 WHEN 0 THEN 'http://i/a.jpg' WHEN 1 THEN 'http://i/a.jpg|http://i/b.jpg' ELSE '' END AS images,
       p_size = 50 AS bad_offers
FROM part""",
    "raw_data_paths": r"""
SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS events FROM events GROUP BY 1""",
    "stable_hash_children": r"""
WITH t AS (
  SELECT *, 'https://img.example/' || l_partkey AS u FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       sha256(CAST(to_json(struct_pack(high_resolution_url := u, type := l_returnflag, url := u)) AS VARCHAR)) AS image_hash,
       CASE WHEN l_returnflag = 'R' THEN 'given' ELSE
         sha256(CAST(to_json(struct_pack(
           external_id := CAST(l_suppkey AS VARCHAR), rating := CAST(CAST(l_quantity AS DECIMAL(4,1)) AS VARCHAR),
           review_date := strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d'), reviewer_name := NULL,
           text := l_linestatus, title := 'say "' || l_returnflag || '"' || chr(9) || 'é\',
           verified_purchase := l_tax > 0)) AS VARCHAR)) END AS review_hash
FROM t""",
}
