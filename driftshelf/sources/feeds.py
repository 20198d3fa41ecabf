"""Observations from JSON line files: whole, or failed with the reason; each file is read once.

A line that is no object, or holds a value its field can't take, stays as a row with an error.
Spark's file stream keeps the list of files already read, in its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import clean_text
from ..operators.keyed import last_wins
from .records import ERRORS

INVALID_RECORD = "invalid_record"
#: Fields a line must have to be the item of a run.
REQUIRED = ("site_id", "run_id", "canonical_url")
#: Where a line comes from, beside what was read of it.
ORIGIN = ("file", "line")


def _misfits(raw: Column, record: Column) -> Column:
    """Names of the fields that hold a value which the layout can't take."""
    names = [
        F.when(raw[name].isNotNull() & record[name].isNull(), F.lit(name)) for name in schemas.OBSERVATIONS
    ]
    return F.array_compact(F.array(*names))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Observations of lines (column ``line``), ``url`` and error columns beside them.

    ``error_type`` is ``invalid_record`` with the first reason that holds: no JSON object, values
    that don't fit (their fields in layout order, or a value in a list of records), a
    missing field of `REQUIRED`. What could be read of such a line is kept. Blank and null
    lines are no records; what follows an object on its line is ignored. Other columns of ``lines`` stay, unless the layout has their name.
    """
    names = {*schemas.OBSERVATIONS, *ERRORS, "url"}
    carried = [c for c in lines.columns if c not in names]
    strict = schemas.ddl({**schemas.OBSERVATIONS, "_broken": "string"})
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    kept = lines.where(clean_text(F.col("line")).isNotNull()).select(
        *carried,
        F.from_json("line", strict, options).alias("_record"),
        F.from_json("line", "map<string,string>").alias("_raw"),
        F.json_object_keys("line").isNull().alias("_odd"),
    )
    record, raw = F.col("_record"), F.col("_raw")
    misfits = F.filter(_misfits(raw, record), lambda x: ~F.col("_odd"))
    lacking = F.array_compact(F.array(*[F.when(record[n].isNull(), F.lit(n)) for n in REQUIRED]))
    message = (
        F.when(F.col("_odd"), "not a JSON object")
        .when(F.size("_misfits") > 0, F.concat(F.lit("does not fit: "), F.array_join("_misfits", ", ")))
        .when(record["_broken"].isNotNull(), "does not fit: a value in a list")
        .when(F.size("_lacking") > 0, F.concat(F.lit("missing: "), F.array_join("_lacking", ", ")))
    )
    return kept.withColumns({"_misfits": misfits, "_lacking": lacking}).select(
        *carried,
        *[record[n].alias(n) for n in schemas.OBSERVATIONS],
        record["canonical_url"].alias("url"),
        F.when(message.isNotNull(), INVALID_RECORD).alias("error_type"),
        message.alias("error_message"),
    )


def _placed() -> Column:
    return F.col("site_id").isNotNull() & F.col("run_id").isNotNull() & F.col("url").isNotNull()


def observed(rows: DataFrame) -> DataFrame:
    """Observations for the run job: whole ones, and failed ones whose run and address are known.

    Of several lines for one address in a run the last by ``item_seq`` stands, then by file and text.
    """
    return last_wins(rows.where(_placed()), ["run_id", "url"], ["item_seq", *ORIGIN]).drop(*ORIGIN, "batch")


def homeless(rows: DataFrame) -> DataFrame:
    """Lines that belong to no item of a run, with file and reason."""
    return rows.where(~_placed()).select(*ORIGIN, *ERRORS)


def take_files(spark: SparkSession, path: str, target: str, checkpoint: str, per_batch: int = 1000) -> DataFrame:
    """Read the files of a folder that were not read before; returns all rows taken so far.

    Files come in batches of at most ``per_batch``. A batch that dies is written again, over what
    it left, with the same files. ``target`` and ``checkpoint`` are shared folders kept between calls.
    """
    def write(batch: DataFrame, number: int) -> None:
        parsed_lines(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    lines = spark.readStream.option("maxFilesPerTrigger", per_batch).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    query = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    query.awaitTermination()
    return taken(spark, target)


def taken(spark: SparkSession, target: str) -> DataFrame:
    """All rows taken so far."""
    layout = {"file": "string", "line": "string", **schemas.OBSERVATIONS, "url": "string",
              **dict.fromkeys(ERRORS, "string"), "batch": "bigint"}
    return spark.read.schema(schemas.ddl(layout)).parquet(target)
