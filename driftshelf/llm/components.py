"""Connected components of a table of links, as rounds of joins written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LINK = ["a", "b"]


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (large) or smaller (small) neighbours on its smallest one."""
    both = links if not large else links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("n"), F.least("a", "m").alias("m")
    )
    joined = both.join(least, both["a"] == least["n"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # links run from the larger to the smaller node here
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, the root being the smallest node reachable.

    `links` has columns a, b; order, repeats and self-links don't matter. Each round is a
    large star and a small star; rounds grow with the logarithm of the number of nodes. Only
    a count and a check sum reach the driver.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    links, before = written(links.distinct(), "links"), None
    while True:
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select("b", "b").distinct()
            )
        links, before = written(_star(_star(links, large=True), large=False), "links"), now
