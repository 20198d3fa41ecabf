"""JSON and CSV exports, written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..schemas import KEY


def nested_to_json(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, for flat formats."""
    nested = {
        name: F.to_json(name)
        for name, kind in df.dtypes
        if kind.startswith(("array", "struct", "map", "variant"))
    }
    return df.withColumns(nested) if nested else df


def export(rows: DataFrame, file_format: str, path: str) -> None:
    """Write export rows in product order: JSON Lines with nulls kept, or CSV.

    ``orderBy`` range-partitions, so the part files in name order are the whole order.
    """
    if file_format not in fixed.EXPORT_FORMATS:
        raise ValueError(f"supported formats: {', '.join(fixed.EXPORT_FORMATS)}")
    ordered = rows.orderBy(*KEY)
    if file_format == "json":
        ordered.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        (
            nested_to_json(ordered)
            .write.mode("overwrite")
            .option("header", True)
            .option("emptyValue", "")
            .option("escape", '"')
            .csv(path)
        )
