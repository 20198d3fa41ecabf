"""Saved pages through whole runs: discovery, extraction, tables, ledger, exports."""

import csv
import glob
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftshelf import fixed
from driftshelf.plans.run import export_run, run_batch, with_options
from driftshelf.operators import discovery
from driftshelf.schemas import RECORD_FIELDS, ddl, SITES
from driftshelf.sinks.export import export
from driftshelf.sinks.tables import CatalogTables
from driftshelf.sources import adapters, style_a, style_b
from driftshelf.sources.tables import observations, site, site_urls

A, B = 1, 2
BASE = "https://shop.example"
LONG_NAME = "N" * 600


def shop_page(title, price, extra=""):
    return f"""<html><head><title>Shop</title><script type="application/ld+json">{{broken</script>
<script type="application/ld+json">[{{"@type":"Thing"}},{{"@type":"Product","brand":{{"name":"Acme"}},
"image":["{BASE}/i/1.png"],"offers":{{"price":"{price}","availability":"https://schema.org/InStock"}}}}]</script></head>
<body><ol class="breadcrumb"><li>Home<li>Phones<li> Touch </ol><h4 class="title">{title}</h4>
<p class="description">Nice &amp; small
<div class="price">${price}</div><img class="image" src="/i/2.png"><img class="image" src="{BASE}/i/1.png">
<table><tr><th>Size</th><td>5</td><td>wide</td></tr><tr><td>alone</td></tr></table>
<div class="ratings"><p data-rating="4">1,234 reviews</p></div>{extra}</body></html>"""


def listing(*links, more=""):
    cards = "".join(f'<div class="card thumbnail"><a class="title" href="{x}">x</a></div>' for x in links)
    return f"<body><a class='category-link' href='/c/1/'>C</a>{cards}{more}</body>"


def market_page(code, name="Deck", extra=""):
    links = "".join(f'<a href="/dp/B{n:09d}?r=1">Part {n} ${n}.50</a>' for n in range(40, 0, -1))
    options = "".join(f'<li data-asin="c{n:09d}" title="Opt {n}">x</li>' for n in range(60, 0, -1))
    return f"""<html><head><title>{name}</title></head><body><span id="productTitle"> {name} </span>
<a id="bylineInfo">Visit the Pioneer Store</a><div id="availability"> Currently unavailable. </div>
<div id="corePrice_feature_div"><span class="a-price"><span class="a-offscreen">$99.50</span></span>
<span class="a-price a-text-price"><span class="a-offscreen">$120</span></span></div>
<div id="wayfinding-breadcrumbs_feature_div"><ul><li><a>Electronics</a></li><li><a>Car</a></li><li><a>Decks</a></li></ul></div>
<div id="feature-bullets"><ul><li><span class="a-list-item"> Loud </span></li><li><span class="a-list-item">› See more product details</span></li></ul></div>
<div id="productOverview_feature_div"><table><tr><td>Brand</td><td>Pio</td></tr><tr><td>Model Name</td><td>M1</td></tr>
<tr><td>Included Components</td><td>Unit, Cable , </td></tr><tr><td>Brand</td><td>Pio</td></tr></table></div>
<img id="landingImage" data-a-dynamic-image='{{"https://i/b._SX300_.jpg":[1],"https://i/a.jpg":[2]}}' src="/z.png">
<div id="altImages"><img src="https://i/c._SS40_.PNG"></div><div id="productDescription">One</div><div id="aplus">Two</div>
<span id="acrCustomerReviewText">1,204 ratings</span><span id="acrPopover">4.4 out of 5 stars</span>
<div data-hook="review" id="R2"><span class="a-profile-name">Al</span><span data-hook="review-date">Reviewed in X on July 5, 2024</span>
<i data-hook="review-star-rating">5.0 out of 5</i><span data-hook="reviewTitle">Good</span><span data-hook="review-body">Fine</span><span data-hook="avp-badge">Verified</span></div>
<div data-hook="review" id="R1"><span data-hook="reviewText">Meh</span></div><div data-hook="review" id="R0"></div>{links}
<a href="https://x/gp/product/B000000002/">late</a><a href="/dp/{code}">self</a><a href="/dp/B000000099"></a><a href="/dp/D000000001">{LONG_NAME}</a>
{options}<div data-asin="{code}"></div><div data-asin="bad"></div>{extra}</body></html>"""


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "site_id long, run_id long, run_ts timestamp, item_seq long, url string, html string")


def sites(spark):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([
        (A, "shop", "Shop", BASE, "webscraper_demo", True, "{}", t, t),
        (B, "market", "Market", "https://www.amazon.com/", "amazon", True,
         '{"seed_urls":["B00SEED001","nothing"],"catalog_max_pages":1}', t, t)], ddl(SITES))


def runs_of(spark, rows):
    return spark.createDataFrame(
        [(i, s, datetime(2024, 1, i), st, lim, 2, "full") for i, s, st, lim in rows],
        "run_id long, site_id long, run_ts timestamp, status string, limited boolean, missing_threshold int, run_type string")


def test_shop_page(spark):
    extra = '<div class="review"><b class="reviewer">Bo</b><i class="rating">4.5 stars</i><p class="review-text">Good<br>one</div><div class="review"></div>'
    rows = [(A, 1, None, 1, "HTTPS://Shop.example/p/12/?a=1", shop_page("Nokia  <b>3</b>", "1,249.95", extra))]
    r = style_a.extract(pages_of(spark, rows)).first()
    assert (r.external_id, r.canonical_url, r.title, r.description, r.brand, r.sku) == (
        "12", "https://shop.example/p/12", "Nokia 3", "Nice & small", "Acme", "12")
    assert (r.current_price, r.currency, r.availability, r.category, r.subcategory, r.rating, r.review_count) == (
        "1249.95", "USD", "in_stock", "Phones", "Touch", "4", 1234)
    assert [(i.url, i.type) for i in r.images] == [
        (f"{BASE}/i/1.png", "main"), ("https://Shop.example/i/2.png", "gallery")]
    assert [tuple(s) for s in r.specifications] == [("General", "Size", "5 | wide")]
    assert [(x.reviewer_name, x.rating, x.text) for x in r.reviews] == [("Bo", "4.5", "Good\none")]
    assert json.loads(r.raw_data)["source"] == "webscraper-demo"


def test_market_page(spark):
    rows = [(B, 1, None, 1, "https://h/dp/b00deck001?x", market_page("B00DECK001")),
            (B, 1, None, 2, "https://h/none", market_page("B00DECK001")),
            (B, 1, None, 3, "https://h/dp/B00DECK003", market_page("B00DECK003", extra='<div data-hook="review"><i data-hook="review-date">on Smarch 1, 2024</i><b data-hook="review-body">x</b></div>'))]
    out = {r.item_seq: r for r in style_b.extract(pages_of(spark, rows)).collect()}
    r = out[1]
    assert (r.external_id, r.canonical_url, r.title, r.brand, r.model_number) == (
        "B00DECK001", "https://www.amazon.com/dp/B00DECK001", "Deck", "Pioneer", "M1")
    assert (r.current_price, r.original_price, r.availability, r.category, r.subcategory) == (
        "99.50", "120", "out_of_stock", "Electronics", "Decks")
    assert (r.highlights, r.whats_in_the_box, r.rating, r.review_count, r.description) == (
        ["Loud"], ["Unit", "Cable"], "4.4", 1204, "One\n\nTwo")
    assert [i.url for i in r.images] == ["https://h/z.png", "https://i/a.jpg", "https://i/b.jpg", "https://i/c.PNG"]
    assert [s.name for s in r.specifications] == ["Brand", "Included Components", "Model Name"]
    assert [(x.external_id, str(x.review_date), x.title, x.verified_purchase) for x in r.reviews] == [
        ("R1", "None", None, False), ("R2", "2024-07-05", "Good", True)]
    assert len(r.relations) == 41 and r.relations[1].name == "Part 2 $2.50" and r.relations[1].price == "2"
    assert [v.sku for v in r.variants] == [f"C{n:09d}" for n in range(1, 61)]
    assert out[2].error_type == "no_product_code" and out[3].error_type == "bad_review_date"


def test_long_link_names_are_cut(spark):
    html = f'<span id="productTitle">x</span><a href="/dp/D000000001">{LONG_NAME}</a>'
    r = style_b.extract(pages_of(spark, [(B, 1, None, 1, "https://h/dp/B00DECK001", html)])).first()
    assert [len(x.name) for x in r.relations] == [600]


def test_all_styles_in_one_pass_equal_each_alone(spark):
    shop, market = shop_page("Nokia", "1.00"), market_page("B00DECK001")
    blocked = shop_page("Are you", "2.00", "<p>solve the CAPTCHA</p>")
    a = pages_of(spark, [(A, 1, None, 1, f"{BASE}/p/1", shop), (A, 1, None, 2, f"{BASE}/p/2", market),
                         (A, 1, None, 3, f"{BASE}/p/3", None), (A, 1, None, 4, f"{BASE}/p/4", blocked), (A, 1, None, 5, None, shop)])
    b = pages_of(spark, [(B, 1, None, 1, "https://h/dp/B00DECK001", market), (B, 1, None, 2, "https://h/none", market),
                         (B, 1, None, 3, "https://h/dp/B00DECK003", shop), (B, 1, None, 4, None, "")])
    other = pages_of(spark, [(9, 1, None, 1, "https://o/1", shop), (9, 1, None, 2, "https://o/2", shop)])
    alone = sorted(map(repr, style_a.extract(a).unionByName(style_b.extract(b)).collect()))
    named = a.withColumn("adapter", F.lit(fixed.STYLE_A)).unionByName(b.withColumn("adapter", F.lit(fixed.STYLE_B)))
    mixed = named.unionByName(other.withColumn("adapter", F.lit("nobody"))).unionByName(
        other.limit(1).withColumn("adapter", F.lit(None).cast("string")))
    together = adapters.extract(mixed)
    assert sorted(map(repr, together.collect())) == alone
    assert [r.error_type for r in together.where("item_seq = 4 and site_id = 1").collect()] == [fixed.BLOCKED_ERROR]
    # A style with a job of its own reads its pages by itself.
    own = adapters.STYLES | {"nobody": adapters.PageStyle(style_a.listing_links, lambda p: style_a.extract(p))}
    assert adapters.extract(mixed, styles=own).count() == together.count() + 2
    # Where a caller limits the search to the opening of a page, a marker further down is part of the text.
    near = adapters.PageStyle(style_a.listing_links, style_a.extractor(
        fixed.STYLE_A_SELECTORS, fixed.STYLE_A_REQUIRED, opening=10))
    found = adapters.extract(mixed, styles={fixed.STYLE_A: near}).where("item_seq = 4").collect()
    assert [(r.error_type, r.title) for r in found] == [(None, "Are you")]


def test_discovery_from_saved_listing_pages(spark):
    rows = [
        (A, "c1", 1, f"{BASE}/c/1", listing("/p/1", "/p/2?x=1", "/p/1#y")), (A, "c1", 2, f"{BASE}/c/1?2", listing("/p/3")),
        (A, "c2", 1, f"{BASE}/c/2", listing("/p/4")),
        (B, "s", 1, "https://m/s?k=1", '<div data-component-type="s-search-result" data-asin="b000000001"></div>'
         '<div data-component-type="s-search-result" data-asin=""></div><div data-asin="B000000009"></div>'),
        (B, "s", 2, "https://m/s?k=2", '<div data-component-type="s-search-result" data-asin="B000000002"></div>')]
    pages = spark.createDataFrame(rows, "site_id long, category string, page_no int, url string, html string")
    assert {r.category for r in style_a.category_urls(pages.where(f"site_id = {A}")).collect()} == {f"{BASE}/c/1"}
    seeds = adapters.configured_seeds(sites(spark))
    found = adapters.discover(adapters.with_adapter(pages, sites(spark)), None, seeds)
    assert sorted(r.product for r in found.collect()) == [
        *[f"{BASE}/p/{n}" for n in (1, 2, 3, 4)],
        *[f"https://www.amazon.com/dp/{c}" for c in ("B000000001", "B00SEED001")]]
    few = adapters.discover(adapters.with_adapter(pages, sites(spark)), 1, seeds)
    assert sorted(r.product for r in few.collect()) == [f"{BASE}/p/1", "https://www.amazon.com/dp/B000000001"]


def test_unknown_style_is_an_error():
    with pytest.raises(ValueError):
        adapters.style("nobody")


def test_runs_end_to_end(spark, tmp_path):
    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    home = spark.createDataFrame(
        [(A, "c", 1, f"{BASE}/c/1", listing(*[f"/p/{n}" for n in range(1, 6)]))],
        "site_id long, category string, page_no int, url string, html string")

    def fold(version, run, pages, status="pending", limited=False):
        rows = [(A, run, datetime(2024, 1, run), 0, f"{BASE}/p/{n}", html) for n, html in pages]
        return run_batch(tables, version, sites(spark), runs_of(spark, [(run, A, status, limited)]),
                         pages=pages_of(spark, rows), listing=home).first()

    blocked = '<title>Captcha</title><b class="title">x</b>'
    one = fold("v1", 1, [(1, shop_page("a", "10.00")), (2, shop_page("b", "20.00")), (3, blocked), (4, "<p>no</p>"),
                         (5, shop_page("e", "9" * 15))])
    assert (one.status, one.products_discovered, one.products_new, one.errors, one.products_unavailable) == (
        "completed_with_errors", 5, 2, 3, 0)
    assert json.loads(one.summary)["items"] == {"new": 2, "failed": 2, "blocked": 1}
    ledger = {r.url[-1]: r for r in tables.of_runs("run_items", [1]).collect()}
    assert {k: (r.status, r.error_type) for k, r in ledger.items()} == {
        "1": ("new", None), "2": ("new", None), "3": ("blocked", "access_blocked"),
        "4": ("failed", "navigation_failed"), "5": ("failed", "constraint")}
    assert ledger["3"].error_message == "Access challenge detected: captcha"
    assert tables.of_runs("failed_urls", [1]).count() == 3

    again = fold("v1", 1, [])
    assert (again.status, tables.state("products").count()) == ("completed_with_errors", 2)
    over = fold("v1a", 1, [], status="completed")
    assert over.summary == one.summary and not tables.is_published("v1a")

    resumed = fold("v1b", 1, [(3, shop_page("c", "30.00")), (4, "<p>no</p>"), (5, shop_page("e", "50.00"))],
                   status="completed_with_errors")
    assert (resumed.products_new, resumed.errors) == (4, 1)
    failed = tables.of_runs("failed_urls", [1]).collect()
    assert {r.url[-1]: r.retry_count for r in failed} == {"3": 0, "4": 1, "5": 0}
    assert {r.attempts for r in tables.of_runs("run_items", [1]).collect() if r.url[-1] in "345"} == {2}

    two = fold("v2", 2, [(1, shop_page("a", "11.00")), (2, shop_page("b", "20.00")), (3, shop_page("c2", "30.00"))])
    assert (two.products_new, two.products_updated, two.products_unchanged, two.errors, two.products_unavailable) == (
        0, 2, 1, 2, 0)
    prices = tables.log("price_history").collect()
    assert [(r.run_id, float(r.old_price), float(r.new_price)) for r in prices] == [(2, 10.0, 11.0)]
    three = fold("v3", 3, [(1, shop_page("a", "11.00"))])
    assert three.products_unavailable == 1
    state = {r.canonical_url[-1]: r for r in tables.state("products").collect()}
    assert {k: (r.availability, r.consecutive_missing_runs) for k, r in state.items()} == {
        "1": ("in_stock", 0), "2": ("in_stock", 1), "3": ("in_stock", 1), "5": ("unavailable", 2)}
    four = fold("v4", 4, [(5, shop_page("e", "50.00"))], limited=True)
    assert (four.products_unchanged, four.products_unavailable) == (1, 0)
    moves = tables.log("availability_history").collect()
    assert [(r.run_id, r.old_status, r.new_status) for r in moves] == [(4, "unavailable", "in_stock")]

    images = tables.state("product_images").where("canonical_url like '%/p/1'").orderBy("display_order").collect()
    assert [(r.image_type, r.first_seen_at.day, r.last_seen_at.day) for r in images] == [("main", 1, 3), ("gallery", 1, 3)]
    assert tables.state("product_specifications").count() == 4

    rows = export_run(tables, sites(spark), runs_of(spark, [(4, A, "completed", False)]))
    export(rows, "json", str(tmp_path / "json"))
    lines = [json.loads(x) for f in sorted(glob.glob(str(tmp_path / "json" / "*.json"))) for x in open(f, encoding="utf-8")]
    assert [x["canonical_url"][-1] for x in lines] == ["1", "2", "3", "5"]
    assert lines[0]["current_price"] == "11.00" and lines[0]["model_number"] is None and lines[0]["site_code"] == "shop"
    export(rows, "csv", str(tmp_path / "csv"))
    got = [r for f in sorted(glob.glob(str(tmp_path / "csv" / "*.csv"))) for r in csv.DictReader(open(f, encoding="utf-8"))]
    assert [r["title"] for r in got] == ["a", "b", "c2", "e"]
    assert got[0]["highlights"] == '["Nice & small"]' and got[0]["model_number"] == ""
    with pytest.raises(ValueError):
        export(rows, "xlsx", str(tmp_path / "x"))


def test_options_say_whether_a_run_is_limited(spark):
    runs = spark.createDataFrame(
        [(1, '{"max_products":3}'), (2, '{"max_products":0,"missing_threshold":5}'), (3, "{}")],
        "run_id long, options string")
    rows = with_options(runs).orderBy("run_id").collect()
    assert [(r.limited, r.missing_threshold) for r in rows] == [(True, 2), (False, 5), (False, 2)]


def test_observations_made_elsewhere(spark, tmp_path):
    """Observation files are folded without pages; the files follow the record layout."""
    line = {"site_id": A, "run_id": 1, "run_ts": "2024-01-01T00:00:00Z", "canonical_url": f"{BASE}/p/1",
            "title": "t", "current_price": "5.00", "images": [{"url": "i"}], "relations": [{"type": "odd", "name": "n"}]}
    (tmp_path / "obs.json").write_text("\n".join(json.dumps(x) for x in (
        line, {**line, "canonical_url": f"{BASE}/p/2", "relations": []})))
    found = observations(spark, str(tmp_path / "obs.json")).withColumn("url", F.col("canonical_url"))
    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    row = run_batch(tables, "v1", sites(spark), runs_of(spark, [(1, A, "pending", False)]), observations=found).first()
    assert (row.products_new, row.errors) == (1, 1)
    bad = tables.of_runs("run_items", [1]).where("status = 'failed'").first()
    assert (bad.error_type, bad.error_message) == ("constraint", "relation_type_domain")
    assert site_urls(tables.state("products"), A).first().canonical_url == f"{BASE}/p/2"
    assert site(sites(spark), "shop").count() == 1 and site(sites(spark), "none").count() == 0


def test_two_sites_in_one_batch_and_untouched_files(spark, tmp_path):
    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    a = [(A, 1, datetime(2024, 1, 1), 0, f"{BASE}/p/{n}", shop_page("a", "1.00")) for n in (1, 2)]
    b = [(B, 2, datetime(2024, 1, 2), 0, f"https://www.amazon.com/dp/B00DECK00{n}", market_page(f"B00DECK00{n}")) for n in (1, 2)]
    runs = runs_of(spark, [(1, A, "pending", False), (2, B, "pending", False)])
    out = run_batch(tables, "v1", sites(spark), runs, pages=pages_of(spark, a + b)).collect()
    assert {r.run_id: (r.products_new, r.errors) for r in out} == {1: (2, 0), 2: (2, 0)}
    assert tables.state("product_relations").count() == 82
    assert tables.state("product_variants").count() == 120
    assert tables.state("product_reviews").count() == 4
    third = [(A, 3, datetime(2024, 1, 3), 0, f"{BASE}/p/1", shop_page("b", "1.00"))]
    run_batch(tables, "v2", sites(spark), runs_of(spark, [(3, A, "pending", False)]), pages=pages_of(spark, third))
    assert tables.state("products").groupBy("site_id").count().orderBy("site_id").collect() == [(A, 2), (B, 2)]
    assert {row[0]: row[-1] for row in tables._newest("site_id", None, "products")} == {A: "v2", B: "v1"}
    with pytest.raises(ValueError):
        run_batch(tables, "v3", sites(spark), runs_of(spark, [(4, A, "pending", False), (5, A, "pending", False)]),
                  pages=pages_of(spark, third))


def items_of(spark, run, rows, **more):
    """Observations of a run: (item_seq, url, canonical_url, price, external_id)."""
    t = datetime(2024, 1, run)
    made = [(A, run, t, i, u, c, "t", p, x) for i, u, c, p, x in rows]
    return spark.createDataFrame(made, "site_id long, run_id long, run_ts timestamp, item_seq long, url string, "
                                 "canonical_url string, title string, current_price string, external_id string") \
        .select("*", *[F.lit(None).cast(k).alias(n) for n, k in RECORD_FIELDS.items()
                       if n not in ("canonical_url", "title", "current_price", "external_id")])


def test_items_of_one_product_are_taken_in_order(spark, tmp_path):
    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    p = f"{BASE}/p/1"
    first = items_of(spark, 1, [(1, p + "?a", p, "1.00", None), (2, p + "?b", p, "2.00", None), (3, p + "?c", p, "2.00", None)])
    row = run_batch(tables, "v1", sites(spark), runs_of(spark, [(1, A, "pending", False)]), observations=first).first()
    assert (row.products_new, row.products_updated, row.products_unchanged) == (1, 1, 1)
    assert [(float(r.old_price), float(r.new_price)) for r in tables.log("price_history").collect()] == [(1, 2)]
    second = items_of(spark, 2, [(1, p + "?a", p, "2.00", None), (2, p + "?b", p, "3.00", None)])
    row = run_batch(tables, "v2", sites(spark), runs_of(spark, [(2, A, "pending", False)]), observations=second).first()
    assert (row.products_new, row.products_updated, row.products_unchanged) == (0, 1, 1)
    assert tables.state("products").count() == 1 and tables.log("price_history").count() == 2


def test_a_freed_id_can_be_taken(spark, tmp_path):
    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    a, b, c = (f"{BASE}/p/{n}" for n in "abc")

    def fold(run, rows):
        runs = runs_of(spark, [(run, A, "pending", False)])
        row = run_batch(tables, f"v{run}", sites(spark), runs, observations=items_of(spark, run, rows)).first()
        return row.errors, {r.canonical_url[-1]: r.external_id for r in tables.state("products").collect()}

    assert fold(1, [(1, a, a, "1", "X")]) == (0, {"a": "X"})
    assert fold(2, [(1, a, a, "1", "Y"), (2, b, b, "1", "X"), (3, c, c, "1", "X")]) == (1, {"a": "Y", "b": "X"})
    # a wants b's id first, so neither id is free
    assert fold(3, [(1, a, a, "1", "X"), (2, b, b, "1", "Y")]) == (2, {"a": "Y", "b": "X"})


def test_a_resumed_run_counts_its_unavailable_products(spark, tmp_path):
    tables = CatalogTables(spark, str(tmp_path / "catalog"))

    def fold(version, run, rows, status="pending"):
        runs = runs_of(spark, [(run, A, status, False)]).withColumn("missing_threshold", F.lit(1))
        pages = pages_of(spark, [(A, run, datetime(2024, 1, run), 0, f"{BASE}/p/{n}", html) for n, html in rows])
        return run_batch(tables, version, sites(spark), runs, pages=pages).first()

    good = shop_page("a", "1.00")
    fold("v1", 1, [(n, good) for n in (1, 2, 3, 4)])
    two = fold("v2", 2, [(1, good), (2, "<p>no</p>")])
    assert (two.errors, two.products_unavailable) == (1, 3)
    again = fold("v2b", 2, [(2, good)], "completed_with_errors")
    assert (again.errors, again.products_unavailable) == (0, 2)
    missed = {r.canonical_url[-1]: r.consecutive_missing_runs for r in tables.state("products").collect()}
    assert missed == {"1": 0, "2": 0, "3": 1, "4": 1}


def test_runs_of_unknown_or_disabled_sites_are_refused(spark, tmp_path):
    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    found = items_of(spark, 1, [(1, f"{BASE}/p/1", f"{BASE}/p/1", "1", None)])
    runs = runs_of(spark, [(1, A, "pending", False)])
    for some in (sites(spark).where(f"site_id <> {A}"), sites(spark).withColumn("enabled", F.col("site_id") != A)):
        with pytest.raises(ValueError, match="unknown or disabled"):
            run_batch(tables, "v1", some, runs, observations=found)
    assert not tables.is_published("v1")


def test_unreadable_listing_pages_fail_the_run_of_their_site(spark, tmp_path):
    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    found = "site_id long, category string, page_no int, url string, html string"
    home = [(A, "c", 1, f"{BASE}/c/1", listing("/p/1")), (A, "c", 2, f"{BASE}/c/2", listing("/p/2")),
            (B, "s", 1, "https://m/s?k=1", '<div data-component-type="s-search-result" data-asin="B00DECK001"></div>')]
    rows = [(A, n, datetime(2024, 1, n), 0, f"{BASE}/p/1", shop_page("a", "1.00")) for n in (1, 2, 3, 4)]
    rows += [(B, 12, datetime(2024, 1, 12), 0, "https://www.amazon.com/dp/B00DECK001", market_page("B00DECK001"))]
    pages = pages_of(spark, rows)

    def fold(version, runs, home, **more):
        out = run_batch(tables, version, sites(spark), runs_of(spark, runs), pages=pages,
                        listing=spark.createDataFrame(home, found), **more)
        return {r.run_id: r for r in out.collect()}

    fold("v1", [(1, A, "pending", False)], home)
    blocked = [home[0], (A, "c", 2, f"{BASE}/c/2", listing("/p/2", more="<p>Please solve the captcha")), home[2]]
    out = fold("v2", [(2, A, "pending", False), (12, B, "pending", False)], blocked)
    assert (out[2].status, out[2].products_discovered) == ("failed", 0)
    # the product listed, and the site's configured seed, which has no saved page
    assert (out[12].status, out[12].products_new, out[12].errors) == ("completed_with_errors", 1, 1)
    summary = json.loads(out[2].summary)
    assert (summary["error"], summary["resumable"]) == (
        f"Access challenge detected: captcha: {BASE}/c/2", True)
    state = {r.site_id: r for r in tables.state("products").collect()}
    assert (state[A].consecutive_missing_runs, state[B].external_id) == (0, "B00DECK001")
    empty = [home[0], (A, "c", 2, f"{BASE}/c/2", "<p>nothing")]
    assert fold("v3", [(3, A, "pending", False)], empty)[3].status == "failed"
    limited = fold("v4", [(4, A, "pending", False)], empty, max_products=1)[4]
    assert (limited.status, limited.products_unchanged) == ("completed", 1)
    resumed = fold("v2b", [(2, A, "failed", False)], home)[2]
    assert (resumed.status, resumed.products_unchanged, resumed.errors) == ("completed_with_errors", 1, 1)


def test_a_limit_in_the_options_limits_discovery(spark, tmp_path):
    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    made = [(n, f"{BASE}/p/{n}", f"{BASE}/p/{n}", "1", None) for n in range(1, 6)]
    runs = runs_of(spark, [(1, A, "pending", False)]).drop("limited", "missing_threshold")
    runs = runs.withColumn("options", F.lit('{"max_products":2}'))
    row = run_batch(tables, "v1", sites(spark), runs, observations=items_of(spark, 1, made)).first()
    assert (row.products_discovered, row.products_new) == (2, 2)


def test_limits_per_site(spark):
    links = spark.createDataFrame(
        [(s, "c", n, f"p{s}{n}{x}") for s in (1, 2, 3) for n in (1, 2, 3) for x in "ab"],
        "site_id long, category string, page_no int, product string")
    limits = spark.createDataFrame([(1, 3), (2, 0), (3, None)], "site_id long, max_products long")
    found = discovery.discover(links, limits).groupBy("site_id").count().orderBy("site_id").collect()
    assert [tuple(r) for r in found] == [(1, 3), (2, 6), (3, 6)]
