"""Keyed operators: one row per key, insert-if-absent, upsert, salted lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A salted key is spread over as many tasks as a shuffle has partitions, up to this many.
MOST_SALTS = 64


def keep_one(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``.

    ``row_number() = 1`` lets Spark drop all but one row per key in each map task
    (WindowGroupLimit) before the exchange, so a hot key does not travel whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_wins(df: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    return keep_one(df, keys, [F.col(p).desc() for p in position])


def first_wins(
    df: DataFrame, keys: list[str], position: list[str], nullable: list[str] | None = None
) -> DataFrame:
    """First row of each key; rows with a null in a ``nullable`` key part never collide.

    A null-keyed row carries its own position in the key, so it stays alone and such
    rows spread over the cluster instead of meeting in one group.
    """
    order = [F.col(p).asc() for p in position]
    if not nullable:
        return keep_one(df, keys, order)
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in nullable])
    apart = F.when(any_null, F.struct(*position))
    return keep_one(df.withColumn("_apart", apart), [*keys, "_apart"], order).drop("_apart")


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key in as many tasks as a shuffle has partitions, also if they compress well.

    Spark joins small partitions by their compressed size: of long texts that repeat
    themselves, or of addresses, gigabytes can then meet in one sort.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the target (null keys never match)."""
    return rows.join(target.select(*keys), keys, "left_anti")


def upsert(
    target: DataFrame,
    rows: DataFrame,
    keys: list[str],
    update: dict[str, Column] | list[str],
    insert: dict[str, Column] | None = None,
) -> DataFrame:
    """Target after inserting new keys and updating known ones, as one full outer join.

    ``update`` names the columns a match changes: a list takes the incoming value, a
    mapping gives expressions over ``old.*`` and ``new.*``. ``insert`` overrides what a
    new key gets (default: the incoming value). Other columns keep the stored value.
    """
    if isinstance(update, list):
        update = {c: F.col(f"new.{c}") for c in update}
    insert = insert or {}
    incoming_columns = set(rows.columns)
    old = target.withColumn("_stored", F.lit(True)).alias("old")
    new = rows.withColumn("_incoming", F.lit(True)).alias("new")
    same = reduce(lambda a, b: a & b, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys])
    joined = old.join(new, same, "full_outer")
    out = []
    for field in target.schema:
        name = field.name
        if name in keys:
            out.append(F.coalesce(f"old.{name}", f"new.{name}").alias(name))
            continue
        given = F.col(f"new.{name}") if name in incoming_columns else F.lit(None)
        fresh = insert.get(name, given)
        changed = update.get(name, F.col(f"old.{name}"))
        value = (
            F.when(F.col("new._incoming").isNull(), F.col(f"old.{name}"))
            .when(F.col("old._stored").isNull(), fresh)
            .otherwise(changed)
        )
        out.append(value.cast(field.dataType).alias(name))
    return joined.select(*out)


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    spread: list[str] | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Join facts to a narrow side with one row per key, whatever the key skew.

    No job runs while the plan is built: Spark broadcasts the side if its size, estimated or
    seen at run time, allows, and otherwise splits the partition of a key with a third of all
    facts (adaptive skew join), so the side is never copied. With ``salts``, or in a session
    without that, the join is on key plus salt: facts take a salt from their own ``spread``
    columns, the side is copied once per salt. Copies are merged, not broadcast: Spark's
    estimate knows nothing of the copying.
    """
    conf = facts.sparkSession.conf
    if salts is None:
        if all(conf.get(f"spark.sql.adaptive.{name}") == "true" for name in ("enabled", "skewJoin.enabled")):
            return facts.join(dim, on, how)
        salts = min(MOST_SALTS, int(conf.get("spark.sql.shuffle.partitions")))
    spread = spread or [c for c in facts.columns if c not in on] or on
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
