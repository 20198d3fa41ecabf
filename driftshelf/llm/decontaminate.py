"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every `WINDOW` consecutive k-gram hashes the smallest is kept. A span of
`WINDOW + GRAM - 1` words that a document and an item share has the same k-grams in both,
so both keep its smallest: every such span shows up as a shared hash. Hits are extended to
all windows around them, and those are compared word by word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, by_key, checked_broadcast, keyed, real_id, table, written

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
#: Words are runs of ASCII letters and digits and of all other characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    plain = F.length(text) == F.octet_length(text)  # lower() changes other letters too
    low = F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def _places(count: Column) -> Column:
    """0 to count - 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, size: int) -> Column:
    """A hash of each run of `size` words."""
    return F.transform(
        _places(F.size(words) - (size - 1)),
        lambda i: F.xxhash64(F.lit(size), *(F.get(words, i + d) for d in range(size))),
    )


def _with_prints(df: DataFrame, short: list[int], item: bool) -> DataFrame:
    """Add `prints`: winnowed hashes, and the hashes of all runs as long as a short item.

    Of an item only those of its own kind are taken. The columns words and grams stay.
    """
    df = df.withColumn("grams", F.when(F.size("words") >= SPAN, _grams(F.col("words"), GRAM)))
    kept = F.transform(
        _places(F.size("grams") - (WINDOW - 1)),
        lambda i: F.least(*(F.get(F.col("grams"), i + d) for d in range(WINDOW))),
    )
    prints = [F.coalesce(kept, F.array().cast("array<bigint>"))]
    for size in short:
        runs = _grams(F.col("words"), size)
        prints.append(F.when(F.size("words") == size, runs).otherwise(F.array().cast("array<bigint>"))
                      if item else runs)
    return df.withColumn("prints", F.array_distinct(F.concat(*prints)))


def _windows(words: Column, starts: Column, size: int) -> Column:
    return F.transform(starts, lambda i: F.struct(
        i.alias("start"), F.lit(size).alias("size"),
        F.array_join(F.slice(words, i + 1, size), " ").alias("words"),
    ))


def _hit_places(words: Column, size: int) -> Column:
    """Starts of the runs of `size` words whose hash is among the hits."""
    runs = _grams(words, size)
    return F.filter(
        _places(F.size(words) - (size - 1)), lambda i: F.array_contains(F.col("hits"), F.get(runs, i))
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Written table (k_id, k_text, n_words, n_rows, spans, items) of all documents by key.

    spans are (start, size) of windows that occur in an item, items the ids of these items;
    both are null for clean documents. Only documents with a shared hash are read again.
    """
    items = written(
        benchmark.select(F.col("item_id").alias("item"), words_of(F.col("text")).alias("words"))
        .where("size(words) > 0"), "items",
    )
    lengths = items.select(F.least(F.size("words"), F.lit(SPAN)).alias("n")).distinct().where(f"n < {SPAN}")
    short = sorted(r["n"] for r in lengths.collect())  # at most nine numbers
    own = F.least(F.size("words"), F.lit(SPAN))
    item_windows = written(
        items.select("item", "words", own.alias("size")).select(
            "item", "size",
            F.explode(F.transform(
                _places(F.size("words") - F.col("size") + 1),
                lambda i: F.array_join(F.slice(F.col("words"), i + 1, F.col("size")), " "),
            )).alias("words"),
        ).distinct(), "windows",
    )
    item_prints = written(
        _with_prints(items, short, item=True).select(F.explode("prints").alias("print")).distinct(), "prints"
    )

    base = keyed(docs).select("k_id", "k_text", words_of(F.col("text")).alias("words"))
    base = written(
        _with_prints(base, short, item=False).select("k_id", "k_text", F.size("words").alias("n_words"), "prints"),
        "bases",
    )
    shared = base.select("k_id", "k_text", F.explode("prints").alias("print")).join(
        checked_broadcast(item_prints), "print"
    )
    hits = written(shared.groupBy(*KEY).agg(F.collect_set("print").alias("hits")), "hits")

    near = by_key(docs.select("doc_id", "text"), hits, "inner").select(
        "found.k_id", "found.k_text", words_of(F.col("row.text")).alias("words"), "found.hits",
    ).dropDuplicates(KEY)
    near = near.withColumn("grams", F.when(F.size("words") >= SPAN, _grams(F.col("words"), GRAM)))
    at = F.filter(
        _places(F.size("grams")), lambda i: F.array_contains(F.col("hits"), F.get(F.col("grams"), i))
    )
    around = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(
        F.greatest(i - (WINDOW - 1), F.lit(0)), F.least(i, F.size("words") - SPAN)
    ))))
    around = F.filter(around, lambda i: i >= 0)
    found = [F.coalesce(_windows(F.col("words"), around, SPAN), F.array())]
    found += [_windows(F.col("words"), _hit_places(F.col("words"), size), size) for size in short]
    windows = near.select("k_id", "k_text", F.explode(F.concat(*found)).alias("w")).select(
        "k_id", "k_text", "w.start", "w.size", "w.words"
    )
    verified = windows.join(item_windows, ["size", "words"])
    results = verified.groupBy(*KEY).agg(
        F.collect_set(F.struct("start", "size")).alias("spans"), F.collect_set("item").alias("items")
    )
    lengths = base.groupBy(*KEY).agg(F.first("n_words").alias("n_words"), F.count("*").alias("n_rows"))
    return written(lengths.join(results, KEY, "left"), "contamination")


def covered(spans: Column) -> Column:
    """Number of words inside any of the spans."""
    places = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    return F.coalesce(F.size(F.array_distinct(places)), F.lit(0))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a word inside a window of an item; all columns are kept."""
    hit = contamination(docs, benchmark).where("spans IS NOT NULL").select(*KEY)
    return by_key(docs, written(hit, "hit"), "left_anti").select("row.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the benchmark has too.

    Null, empty and word-less texts and items have no windows. Repeated rows are kept and
    judged alike; a null item_id is not listed in items_sha256 nor counted in n_items.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    rows = found.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    names = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda i: i.cast("string")))
    return rows.select(
        real_id().alias("doc_id"), F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("spans")).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), "
    f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{BETWEEN}'), lambda w: w <> '')"
)
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {SPAN}) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)
  WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS x
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b))),
hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (n, x)),
total AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN item USING (doc_id)
"""
