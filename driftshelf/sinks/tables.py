"""Published catalog tables on Parquet.

State is kept in buckets by the hash of the product key, one folder for each site and bucket.
A batch writes the buckets it changes, and everything else, under its own version, and then
publishes that: state readers take each bucket's newest published version, log readers all
published versions. Half-written versions are never seen, a batch that was published is not
folded in twice, untouched buckets keep their files, and of two batches that began at the same
state of a site the second one is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .publications import PublicationConflict, PublicationLog

__all__ = ["BUCKETS", "CatalogTables", "PublicationConflict", "bucket_of"]

STATE_TABLES = {
    "products": schemas.PRODUCTS,
    "product_images": schemas.IMAGES,
    "product_specifications": schemas.SPECIFICATIONS,
    "product_reviews": schemas.REVIEWS,
    "product_relations": schemas.RELATIONS,
    "product_variants": schemas.VARIANTS,
}
LOG_TABLES = {
    "price_history": schemas.PRICE_HISTORY,
    "availability_history": schemas.AVAILABILITY_HISTORY,
}
RUN_TABLES = {
    "run_items": {"site_id": "bigint", **schemas.RUN_ITEMS},
    "failed_urls": schemas.FAILED_URLS,
    "runs": schemas.RUN_ROWS,
}
LAYOUTS = {**STATE_TABLES, **LOG_TABLES, **RUN_TABLES}
#: Buckets of a site's products and of their children; fixed once the first batch is published.
BUCKETS = 32


def bucket_of(buckets: int = BUCKETS) -> Column:
    """Bucket of a product, from the columns of its key."""
    return F.pmod(F.xxhash64(*schemas.KEY), F.lit(buckets)).cast("int")


class CatalogTables:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.published = PublicationLog(spark, self.root)
        self._known: dict[tuple, list] = {}
        self._base: int | None = None

    def refresh(self) -> None:
        """Forget which versions were newest; a batch looks once, at its start."""
        self._known.clear()
        self._base = None

    @property
    def base(self) -> int:
        """The number that reads go up to, until the next refresh."""
        if self._base is None:
            self._base = self.published.newest()
            first = self.published.rows(self._base).where("buckets IS NOT NULL").first()
            if first and first.buckets != self.buckets:
                raise ValueError(f"these tables have {first.buckets} buckets, not {self.buckets}")
        return self._base

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def publications(self) -> DataFrame:
        return self.published.rows(self.base)

    def is_published(self, version: str) -> bool:
        return not self.publications().where(F.col("version") == version).isEmpty()

    def _read(
        self, table: str, versions: list[str], keep: Column, extra: dict[str, str] | None = None
    ) -> DataFrame:
        layout = {**LAYOUTS[table], **(extra or {})}
        if not versions:
            return self.spark.createDataFrame([], schemas.ddl(layout))
        paths = [f"{self.path(table)}/version={v}" for v in versions]
        bucket = {"bucket": "int"} if table in STATE_TABLES else {}
        return (
            self.spark.read.option("basePath", self.path(table))
            .schema(schemas.ddl({**layout, **bucket, "version": "string"}))
            .parquet(*paths)
            .where(keep)
            .select(*layout)
        )

    def _newest(self, key: str, only: list[int] | None, group: str | None = None) -> list:
        """Newest version per run, or per site and bucket of a table group: a row per folder to be read."""
        asked = (key, None if only is None else tuple(only), group)
        if asked not in self._known:
            log = self.publications().where(F.col(key).isNotNull())
            if only is not None:
                log = log.where(F.col(key).isin(only))
            names = [key]
            if group:
                log = log.withColumn("bucket", F.explode(group))
                names = [key, "bucket"]
            best = log.groupBy(*names).agg(F.max_by("version", "published_no").alias("version"))
            self._known[asked] = [tuple(row) for row in best.toLocalIterator()]
        return self._known[asked]

    def _current(self, table: str, names: list[str], newest: list[tuple]) -> DataFrame:
        held = F.concat_ws("@", *(F.col(n).cast("string") for n in names), "version")
        keep = held.isin(["@".join(map(str, row)) for row in newest])
        return self._read(table, sorted({row[-1] for row in newest}), keep)

    def state(
        self, table: str, sites: list[int] | None = None, buckets: dict[int, list[int]] | None = None
    ) -> DataFrame:
        """Current rows of a state table, of all sites, of some, or of some buckets of each.

        Only their folders are read: site, bucket and version are partition columns.
        """
        sites = list(buckets) if sites is None and buckets is not None else sites
        newest = self._newest("site_id", sites, _group(table))
        if buckets is not None:
            newest = [row for row in newest if row[1] in buckets.get(row[0], ())]
        return self._current(table, ["site_id", "bucket"], newest)

    def of_runs(self, table: str, runs: list[int]) -> DataFrame:
        """Ledger rows of some runs, as last published."""
        return self._current(table, ["run_id"], self._newest("run_id", runs))

    def log(self, table: str) -> DataFrame:
        """A change log over all published versions: those put together, and the later ones."""
        done = min(self.published.upto(), self.base)
        later = self.publications().where(F.col("published_no") > done).select("version").distinct()
        versions = [row.version for row in later.toLocalIterator()]
        return self._read(table, [*sorted(versions), *([_upto(done)] if done else [])], F.lit(True))

    def written(
        self, table: str, version: str, extra: dict[str, str] | None = None
    ) -> DataFrame:
        """A table of one version, published or not, with columns kept beside its layout."""
        return self._read(table, [version], F.col("version") == version, extra)

    def touched(self, products: DataFrame) -> dict[int, list[int]]:
        """Buckets of each site that hold some of the products: at most `buckets` rows a site."""
        rows = products.select("site_id", bucket_of(self.buckets).alias("bucket")).distinct()
        found: dict[int, list[int]] = {}
        for row in sorted(rows.toLocalIterator()):
            found.setdefault(row.site_id, []).append(row.bucket)
        return found

    def write(self, table: str, df: DataFrame, version: str) -> None:
        """Write one table of a version; a retry of the same version replaces it.

        Rows are rebalanced by folder first, so that not every task writes a file per folder;
        a large one is split again at run time.
        """
        folders = ["site_id"]
        if table in STATE_TABLES:
            df, folders = df.withColumn("bucket", bucket_of(self.buckets)), ["site_id", "bucket"]
        (
            df.hint("rebalance", *folders).write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(*folders)
            .parquet(f"{self.path(table)}/version={version}")
        )

    def write_plain(self, table: str, df: DataFrame, version: str) -> DataFrame:
        """Write an intermediate result of a version and read it back, cutting lineage."""
        path = f"{self.path(table)}/version={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def publish(
        self, runs: list[tuple[int | None, int]], version: str,
        products: dict[int, list[int]] | None = None, children: dict[int, list[int]] | None = None,
    ) -> int:
        """Make a version current for (site_id, run_id) rows and the buckets it holds of the sites.

        Buckets not given are all of them. A null ``site_id`` publishes the run's own rows only
        and leaves the site's state. Raises PublicationConflict if one of the sites or runs was
        published by others since this object last looked; nothing is changed then.
        """
        every = list(range(self.buckets))

        def of(held: dict[int, list[int]] | None, site: int | None) -> list[int]:
            return [] if site is None else every if held is None else held.get(site, [])

        number = self.published.append([
            {"site_id": site, "run_id": run, "version": version, "buckets": self.buckets,
             "products": of(products, site), "children": of(children, site)} for site, run in runs
        ], self.base)
        self.refresh()
        return number

    def compact(self) -> int:
        """Put the logs of all publications so far together, so that readers open one folder for them."""
        self.refresh()
        number = self.base
        if number > self.published.upto():
            for table in LOG_TABLES:
                self.write(table, self.log(table), _upto(number))
            self.published.compact(number)
        self.refresh()
        return number

    def expire(self, keep: int = 100) -> list[str]:
        """Remove folders of versions no reader needs, and return them.

        Kept are versions that are newest for some bucket or run, and the last `keep`
        publications, so that readers who began before those still find theirs. Logs and
        publications are removed where `compact` has put them together.
        """
        self.refresh()
        done, edge = self.published.upto(), self.base - keep
        known = {r.version: r.number for r in self.publications().groupBy("version").agg(
            F.max("published_no").alias("number")).toLocalIterator()}
        recent = {v for v, number in known.items() if number > edge}
        needed = {group: recent | {row[-1] for row in self._newest("site_id", None, group)} for group in ("products", "children")}
        runs = recent | {row[-1] for row in self._newest("run_id", None)}
        late = recent | {v for v, number in known.items() if number > done} | {_upto(done)}
        gone = []
        for table in LAYOUTS:
            wanted = late if table in LOG_TABLES else runs if table in RUN_TABLES else needed[_group(table)]
            for name in self.published.names(self.path(table)):
                version = name.removeprefix("version=")
                if version not in wanted and (version in known or version.startswith("upto-")):
                    gone.append(f"{table}/{name}")
        for folder in gone:
            self.published.remove(f"{self.root}/{folder}")
        self.published.forget()
        return gone


def _group(table: str) -> str:
    return "products" if table == "products" else "children"


def _upto(number: int) -> str:
    return f"upto-{number}"
