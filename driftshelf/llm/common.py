"""Helpers of this subpackage: the shared folder, row keys, checked broadcasts.

Rows are told apart by (doc_id, hash of the text): two rows with one doc_id and different
texts are two documents, repeated rows are the same document twice and get the same result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside joins; sorts before every other id.
NO_ID = -(2**63)
KEY = ["k_id", "k_text"]
#: What a broadcast side may hold, estimated from a written table; beyond it, rows are shuffled.
BROADCAST_BYTES = 32 << 20

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _own_folders[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: evaluated once, lineage cut, safe to lose executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(table: DataFrame, wide: str | None = None) -> DataFrame:
    """Broadcast a written table if it is small; else leave the join to Spark.

    The size is 64 bytes a row and the bytes of column `wide`. Only the plan depends on it.
    """
    size = F.count("*") * 64 + (F.coalesce(F.sum(F.octet_length(wide)), F.lit(0)) if wide else F.lit(0))
    return F.broadcast(table) if table.select(size).first()[0] <= BROADCAST_BYTES else table


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """k_id, k_text, text and the columns named; other columns are left behind, so none can clash."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k_id"),
        F.xxhash64("text").alias("k_text"),
        "text", *more,
    )


def real_id(name: str = "k_id") -> Column:
    """doc_id of k_id: null again where it was null."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def small_batches(spark: SparkSession) -> None:
    """Pass 1,000 rows to Python at a time: rows hold whole texts, and 10,000 take too much memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(docs: DataFrame, verdicts: DataFrame, how: str, wide: str | None = None) -> DataFrame:
    """Join documents with a written table keyed by KEY, as (row, found).

    `row` is a struct of the documents' own columns, whatever their names, `found` one of the
    table's; it is null where a left join finds none. An anti join gives `row` only.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("row_id"),
        F.xxhash64("text").alias("row_text"),
    )
    side = verdicts.select(F.struct("*").alias("found"), *KEY)
    side = checked_broadcast(side, f"found.{wide}" if wide else None)
    joined = rows.join(side, (rows["row_id"] == side["k_id"]) & (rows["row_text"] == side["k_text"]), how)
    return joined.select("row") if how == "left_anti" else joined.select("row", "found")


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores after it as it takes to be new."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


#: Tables of a SQL query that works out CRC-32: `lookup` has one row, to be joined to.
CRC_SQL = """digit AS (SELECT range AS i, range::UBIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1
  FROM digit WHERE k < 8),
lookup AS (SELECT list(c ORDER BY i) AS crc_table FROM digit WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of a text of ASCII characters, beside a row of `lookup`."""
    return f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
        range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::UBIGINT)),
      lambda c, x: xor(c >> 8, crc_table[(xor(c & 255, x) + 1)::BIGINT])), 4294967295::UBIGINT)"""
