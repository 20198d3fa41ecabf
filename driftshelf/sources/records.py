"""Common frame of page-to-record jobs: required node, block check, errors as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from ..schemas import RECORD_FIELDS, RUN_FIELDS
from . import html

ERRORS = ("error_type", "error_message")
#: Holds what is not the business of a style's rules; `finish` leaves it alone.
CARRIED = "_carried"


@dataclass(frozen=True)
class PageRules:
    """An extraction job for one style of product pages: the nodes it takes, and the rules that
    make a record of them (``nodes``, ``url``, run and error columns to the observation layout)."""

    nodes: html.PageNodes
    fields: Callable[[DataFrame], DataFrame]

    def __call__(self, pages: DataFrame) -> DataFrame:
        return extract_styles(pages.withColumn("adapter", F.lit("")), {"": self})


def extract_styles(pages: DataFrame, rules: dict[str, PageRules]) -> DataFrame:
    """Observations of pages of several styles (``adapter`` names it), errors as columns: one scan
    of the pages and one Python evaluation, however many styles."""
    read = html.styled_nodes({name: r.nodes for name, r in rules.items()}, fixed.BLOCK_MARKERS)
    # Not deterministic to the optimizer: a filter on the results must not run it again.
    page = read.asNondeterministic()("adapter", "url", "html")
    df = pages.where(F.col("adapter").isin(*rules)).select(*RUN_FIELDS, "url", "adapter", page.alias("page"))
    df = _errors(df.select("*", "page.lost", "page.marker"))
    for at, one in enumerate(rules.values()):
        kept = "page", "adapter", *(f"record_{i}" for i in range(at))
        mine = df.select(*RUN_FIELDS, "url", *ERRORS, F.struct(*kept).alias(CARRIED),
                         F.col(f"page.nodes.style_{at}").alias("nodes"))
        found = one.fields(mine)
        df = found.select(
            *RUN_FIELDS, "url", f"{CARRIED}.*", F.col(f"{CARRIED}.page.lost"), F.col(f"{CARRIED}.page.marker"),
            F.struct(*RECORD_FIELDS, *ERRORS).alias(f"record_{at}"),
        )
        df = _errors(df)
    chosen = F.lit(None)
    for at, name in reversed(list(enumerate(rules))):
        chosen = F.when(F.col("adapter") == name, F.col(f"record_{at}")).otherwise(chosen)
    return df.select(*RUN_FIELDS, "url", chosen.alias("record")).select(*RUN_FIELDS, "url", "record.*")


def with_errors(df: DataFrame) -> DataFrame:
    """The first error of parsed pages (``nodes`` with ``required, page_title, page_body``)."""
    n = F.col("nodes")
    marker = text.block_marker(html.first_text(n, "page_title"), html.first_text(n, "page_body"))
    return _errors(df.withColumns({"marker": marker, "lost": F.size(html.nodes_of(n, "required")) == 0}))


def _errors(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "error_type": F.when(F.col("lost"), "navigation_failed").when(
                F.col("marker").isNotNull(), fixed.BLOCKED_ERROR
            ),
            "error_message": F.when(F.col("lost"), "required element not found").when(
                F.col("marker").isNotNull(),
                F.concat(F.lit("Access challenge detected: "), F.col("marker")),
            ),
        }
    )


def listed(pages: DataFrame, parse, links: str) -> DataFrame:
    """Link nodes ``n`` of listing pages; a page without its cards or with a block marker
    gives one row with an ``error`` and no node."""
    nodes = parse.asNondeterministic()("url", "html")
    df = with_errors(pages.select("site_id", "category", "page_no", "url", nodes.alias("nodes")))
    sound = F.when(F.col("error_type").isNull(), F.col(f"nodes.{links}"))
    return df.select(
        "site_id", "category", "page_no",
        F.concat_ws(": ", "error_message", "url").alias("message"), "error_type",
        F.explode_outer(sound).alias("n"),
    ).withColumn("error", F.when(F.col("error_type").isNotNull(), F.col("message"))).drop(
        "message", "error_type")


def failing(df: DataFrame, **rules: Column) -> DataFrame:
    """Record the first broken rule of rows that have no error yet."""
    hit = F.coalesce(
        *[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]
    )
    df = df.withColumn("_rule", F.when(F.col("error_type").isNull(), hit))
    return df.withColumns(
        {
            "error_message": F.coalesce(
                "error_message",
                F.when(F.col("_rule").isNotNull(), F.concat(F.col("_rule"), F.lit(": "), F.col("url"))),
            ),
            "error_type": F.coalesce("error_type", "_rule"),
        }
    ).drop("_rule")


def finish(df: DataFrame) -> DataFrame:
    """The observation layout plus ``url`` and the error columns; absent fields default."""
    have = set(df.columns)
    out = [F.col(c) for c in RUN_FIELDS] + [F.col("url")]
    for name, kind in RECORD_FIELDS.items():
        if name in have:
            out.append(F.col(name).cast(kind).alias(name))
        elif kind.startswith("array"):
            out.append(F.array().cast(kind).alias(name))
        else:
            out.append(F.lit(None).cast(kind).alias(name))
    return df.select(*out, *ERRORS, *([CARRIED] if CARRIED in have else []))


def records(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("error_type").isNull()).drop("url", *ERRORS)


def page_status() -> Column:
    """What became of a page: a record, or blocked or failed without one."""
    return (
        F.when(F.col("error_type").isNull(), "record")
        .when(F.col("error_type") == fixed.BLOCKED_ERROR, "blocked")
        .otherwise("failed")
    )


def failed_pages(extracted: DataFrame) -> DataFrame:
    """Outcome rows of pages that gave no record; blocked ones apart from failed ones."""
    return extracted.where(F.col("error_type").isNotNull()).select(
        "run_id", "url", page_status().alias("status"), *ERRORS
    )
