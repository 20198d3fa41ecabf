"""Constraint checks: rows that would be refused go to a quarantine, with the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import lookup


def in_domain(column: str, allowed: tuple[str, ...]) -> tuple[str, Column]:
    return f"{column}_domain", F.col(column).isNotNull() & ~F.col(column).isin(*allowed)


def required(column: str) -> tuple[str, Column]:
    return f"{column}_null", F.col(column).isNull()


def fits(column: str, kind: str, label: str | None = None) -> tuple[str, Column]:
    """Text that is there but does not fit its store type."""
    c = F.col(column)
    return f"{label or column}_overflow", c.isNotNull() & c.try_cast(kind).isNull()


def violations(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks a row breaks."""
    marks = [F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in checks]
    return F.array_compact(F.array(*marks))


def checked(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    return df.withColumn("violations", violations(checks))


def good(df: DataFrame) -> DataFrame:
    return df.where(F.size("violations") == 0).drop("violations")


def quarantine(df: DataFrame) -> DataFrame:
    return df.where(F.size("violations") > 0)


def id_owners(
    rows: DataFrame, owned: DataFrame | None, scope: list[str], code: str, url: str, order: str
) -> DataFrame:
    """Ids claimed by more than one URL, with the URL that keeps each.

    The stored URL owns its id, else the first in ``order``. Aggregates only, so a hot
    id is folded in the map tasks and one row per contested id remains.
    """
    first = F.struct(F.lit(1).alias("late"), F.col(order).alias("at"), F.col(url).alias("u"))
    claims = rows.where(F.col(code).isNotNull()).select(*scope, code, first.alias("claim"))
    if owned is not None:
        at = F.lit(None).cast(rows.schema[order].dataType).alias("at")
        stored = F.struct(F.lit(0).alias("late"), at, F.col(url).alias("u"))
        claims = claims.unionByName(
            owned.where(F.col(code).isNotNull()).select(*scope, code, stored.alias("claim"))
        )
    return (
        claims.groupBy(*scope, code)
        .agg(
            F.min("claim").alias("owner"),
            F.min("claim.u").alias("low"),
            F.max("claim.u").alias("high"),
        )
        .where("low <> high")
        .select(*scope, code, F.col("owner.u").alias("owner_url"))
    )


def second_claims(
    rows: DataFrame, owned: DataFrame | None, scope: list[str], code: str, url: str, order: str
) -> DataFrame:
    """Rows flagged ``taken`` where their id already belongs to another URL."""
    owners = id_owners(rows, owned, scope, code, url, order)
    joined = lookup(rows, owners, [*scope, code], "left", spread=[url])
    taken = F.col("owner_url").isNotNull() & (F.col("owner_url") != F.col(url))
    return joined.withColumn("taken", taken).drop("owner_url")


def free_released(
    claims: DataFrame, owned: DataFrame, scope: list[str], code: str, url: str, order: str
) -> DataFrame:
    """Claims on stored ids that their URL gave up earlier in the batch are no longer ``taken``.

    ``claims``: a written result of :func:`second_claims`, read three times. A stored id is
    free from the first accepted row on that brings its URL another id; the first claim
    after that has it, with all later rows of the same URL. An id given up by a row that
    itself needs a freed id stays taken.
    """
    moves = (
        owned.where(F.col(code).isNotNull()).select(*scope, url, F.col(code).alias("_held"))
        .join(claims.where(~F.col("taken")).select(*scope, url, F.col(code).alias("_new"), order), [*scope, url])
        .where("not(_held <=> _new)")
        .groupBy(*scope, F.col("_held").alias(code)).agg(F.min(order).alias("_free_from"))
    )
    heirs = (
        claims.where("taken").select(*scope, code, url, order).join(moves, [*scope, code])
        .where(F.col(order) > F.col("_free_from"))
        .groupBy(*scope, code).agg(F.min(F.struct(order, url)).alias("_heir"))
    )
    joined = lookup(claims, heirs, [*scope, code], "left", spread=[url])
    inherits = (F.col(f"_heir.{url}") == F.col(url)) & (F.col(order) >= F.col(f"_heir.{order}"))
    return joined.withColumn("taken", F.col("taken") & ~F.coalesce(inherits, F.lit(False))).drop("_heir")


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str], edge: str) -> DataFrame:
    """Child keys without a parent and how many rows carry each.

    Children and parents are counted together per key, folded in the map tasks: one exchange
    and one hash table a task, no join and no sort.
    """
    keys, one, none = list(on), F.lit(1), F.lit(None).cast("int")
    children = child.select(*keys, one.alias("_child"), none.alias("_parent"))
    parents = parent.select(*[F.col(p).alias(c) for c, p in on.items()], none.alias("_child"), one.alias("_parent"))
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    counted = children.unionByName(parents).where(known).groupBy(*keys).agg(
        F.count("_child").alias("child_rows"), F.count("_parent").alias("_parents")
    )
    return counted.where("child_rows > 0 AND _parents = 0").select(
        F.lit(edge).alias("edge"), F.concat_ws("|", *keys).alias("child_key"), "child_rows"
    )
