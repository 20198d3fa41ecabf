"""One run against the stored catalog: classify, upsert, log changes, age out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import hashing, text
from ..schemas import KEY, PRODUCTS
from .keyed import last_wins, lookup


def absent(column: str) -> Column:
    return F.lit(None).cast(PRODUCTS[column]).alias(column)


def last_in_run(observations: DataFrame) -> DataFrame:
    """The last observation of a product within each run stands for the run."""
    return last_wins(observations, [*KEY, "run_id"], ["item_seq"])


def hashed(observations: DataFrame, tracked: Iterable[str] = fixed.TRACKED_FIELDS,
           earlier: Sequence[Iterable[str]] = ()) -> DataFrame:
    """Add the content hash and the version of its fields; it is taken before defaults are filled in.

    ``earlier``: lists of fields that were tracked before; ``earlier_hashes`` then holds the hash over each.
    """
    columns = observations.columns
    added = {
        "content_hash": hashing.content_hash(columns, tracked),
        "hash_version": F.lit(hashing.fields_version(tracked)),
    }
    past = {hashing.fields_version(fields): fields for fields in earlier}
    if past:
        pairs = [c for v, fields in past.items() for c in (F.lit(v), hashing.content_hash(columns, fields))]
        added["earlier_hashes"] = F.create_map(*pairs)
    return observations.withColumns(added)


def in_present_fields(old_hash: Column, old_version: Column, new: dict[str, Column]) -> Column:
    """A stored hash as the present one, if the record had it over the fields of that time.

    ``new`` holds ``content_hash, hash_version`` and maybe ``earlier_hashes`` of the record; a null
    version is that of `fixed.TRACKED_FIELDS`. A hash over fields not among the earlier
    lists stays as it is, so the record counts as updated.
    """
    if "earlier_hashes" not in new:
        return old_hash
    version = F.coalesce(old_version, F.lit(hashing.fields_version(fixed.TRACKED_FIELDS)))
    same = F.coalesce(F.try_element_at(new["earlier_hashes"], version) == old_hash, F.lit(False))
    return F.when((version != new["hash_version"]) & same, new["content_hash"]).otherwise(old_hash)


def _hashes(columns: list[str], at: str = "") -> dict[str, Column]:
    return {c: F.col(at + c) for c in ("content_hash", "hash_version", "earlier_hashes") if c in columns}


def with_defaults(observations: DataFrame) -> DataFrame:
    """Store form of an observation: decimals cast, falsy values replaced by defaults."""
    have = set(observations.columns)
    filled = {
        "title": F.lit(fixed.DEFAULT_TITLE),
        "currency": F.lit(fixed.DEFAULT_CURRENCY),
        "review_count": F.lit(0),
        "raw_data": F.lit("{}"),
    }
    out: list[Column | str] = [c for c in ("run_id", "run_ts", "earlier_hashes") if c in have]
    for name, kind in PRODUCTS.items():
        if name in KEY or name == "content_hash":
            out.append(name)
        elif name in ("first_seen_at", "last_seen_at", "last_scraped_at", "created_at",
                      "updated_at", "unavailable_since", "consecutive_missing_runs"):
            continue
        elif kind.startswith("decimal"):
            value = F.col(name).try_cast(kind) if name in have else absent(name)
            out.append(value.alias(name))
        elif kind.startswith("array"):
            value = F.col(name) if name in have else F.lit(None)
            empty = F.array().cast(kind)
            out.append(F.coalesce(value.cast(kind), empty).alias(name))
        elif name in filled:
            value = F.col(name) if name in have else F.lit(None)
            if kind == "string":
                value = text.blank_to_null(value.cast("string"))
            out.append(F.coalesce(value, filled[name]).cast(kind).alias(name))
        else:
            out.append(F.col(name) if name in have else absent(name))
    return observations.select(*out)


def incoming(observations: DataFrame, tracked: Iterable[str] = fixed.TRACKED_FIELDS,
             earlier: Sequence[Iterable[str]] = ()) -> DataFrame:
    """Observations of a batch, one row per product, hashed and in store form."""
    return with_defaults(hashed(last_in_run(observations), tracked, earlier))


def in_order(observations: DataFrame, tracked: Iterable[str] = fixed.TRACKED_FIELDS,
             earlier: Sequence[Iterable[str]] = ()) -> DataFrame:
    """Items of a batch, hashed, several of one product kept apart.

    ``previous`` is what the item before left of the product in this run, null for the
    first; ``last`` marks the one that stands for the run.
    """
    w = Window.partitionBy(*KEY, "run_id").orderBy("item_seq")
    left = F.struct(
        "content_hash", F.col("current_price").try_cast(PRODUCTS["current_price"]).alias("current_price"),
        "availability",
    )
    return hashed(observations, tracked, earlier).withColumns(
        {"previous": F.lag(left).over(w), "last": F.lead("run_id").over(w).isNull()}
    )


def change_status(old_hash: Column, new_hash: Column) -> Column:
    """new without a stored row, updated when the hash differs, else unchanged."""
    return (
        F.when(old_hash.isNull(), "new").when(old_hash != new_hash, "updated").otherwise("unchanged")
    )


def merge(state: DataFrame, observed: DataFrame, runs: DataFrame) -> DataFrame:
    """State after a batch, with what the logs and the ledger need beside it.

    ``observed`` is :func:`incoming`; ``runs`` holds at most one run per site with
    ``site_id, run_ts, limited, missing_threshold`` and, optionally, ``aged``: the run was
    folded before, so what it misses is counted but not aged again. One full outer join on
    the product key yields upserts (both sides or right), aging (left only, site had an
    unlimited run) and untouched rows (left only otherwise). Run facts come through a
    lookup on the site, after the join, so the product key is the only exchange.
    """
    old = state.withColumn("_stored", F.lit(True)).alias("old")
    new = observed.withColumn("_seen", F.lit(True)).alias("new")
    same = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in KEY]
    joined = old.join(new, same[0] & same[1], "full_outer")

    seen = F.col("new._seen").isNotNull()
    known = F.col("old._stored").isNotNull()
    packed = joined.select(
        *[F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in KEY],
        F.when(known, F.struct(*[f"old.{c}" for c in PRODUCTS if c not in KEY])).alias("o"),
        F.when(seen, F.struct(*[f"new.{c}" for c in observed.columns if c not in KEY])).alias("n"),
    )
    facts = runs.select(
        "site_id",
        F.col("run_ts").alias("_run_ts"),
        (~F.coalesce("limited", F.lit(False))).alias("_full"),
        (F.coalesce("aged", F.lit(False)) if "aged" in runs.columns else F.lit(False)).alias("_aged"),
        F.coalesce("missing_threshold", F.lit(fixed.DEFAULT_MISSING_THRESHOLD)).alias("_threshold"),
    )
    rows = lookup(packed, facts, ["site_id"], "left", spread=["canonical_url"])

    seen, known = F.col("n").isNotNull(), F.col("o").isNotNull()
    aged = F.coalesce("_aged", F.lit(False))
    earlier = aged & F.col("o.last_seen_at").eqNullSafe(F.col("_run_ts"))
    missed = ~seen & ~earlier & F.coalesce(F.col("_full"), F.lit(False))
    ages = missed & ~aged
    misses = F.col("o.consecutive_missing_runs") + 1
    gone = ages & (misses >= F.col("_threshold"))
    now = F.coalesce("n.run_ts", "_run_ts")

    old_hash = in_present_fields(
        F.col("o.content_hash"), F.col("o.hash_version"), _hashes(observed.columns, "n."))
    values: dict[str, Column] = {}
    for name in PRODUCTS:
        if name in KEY:
            values[name] = F.col(name)
        elif name in ("first_seen_at", "created_at"):
            values[name] = F.coalesce(f"o.{name}", now)
        elif name in ("last_seen_at", "last_scraped_at"):
            values[name] = F.when(seen, now).otherwise(F.col(f"o.{name}"))
        elif name == "updated_at":
            values[name] = F.when(seen | ages, now).otherwise(F.col("o.updated_at"))
        elif name == "consecutive_missing_runs":
            values[name] = F.when(seen, 0).when(ages, misses).otherwise(F.col(f"o.{name}"))
        elif name == "unavailable_since":
            values[name] = F.when(
                ~seen,
                F.when(gone, F.coalesce("o.unavailable_since", now)).otherwise(
                    F.col("o.unavailable_since")
                ),
            )
        elif name == "availability":
            values[name] = (
                F.when(seen, F.col("n.availability"))
                .when(gone, F.lit("unavailable"))
                .otherwise(F.col("o.availability"))
            )
        else:
            values[name] = F.when(seen, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
    return rows.select(
        *[values[name].cast(kind).alias(name) for name, kind in PRODUCTS.items()],
        F.col("n.run_id").alias("run_id"),
        F.when(seen, change_status(old_hash, F.col("n.content_hash"))).alias(
            "change_status"
        ),
        (seen & known).alias("was_stored"),
        F.col("o.content_hash").alias("old_hash"),
        F.col("o.hash_version").alias("old_version"),
        F.col("o.current_price").alias("old_price"),
        F.col("o.availability").alias("old_availability"),
        missed.alias("missed"),
    )


def state_of(merged: DataFrame) -> DataFrame:
    return merged.select(*PRODUCTS)


def outcomes_of(merged: DataFrame) -> DataFrame:
    """Change status of every product the batch saw."""
    return merged.where(F.col("change_status").isNotNull()).select(
        *KEY, "run_id", "change_status", "content_hash"
    )


def items_of(steps: DataFrame, merged: DataFrame) -> DataFrame:
    """Status of every item of a batch and what it changed, from :func:`in_order` and
    :func:`merge`: the first item of a product against the stored row, each later one
    against the item before. The logs read it as they read a merged state."""
    stored = merged.where(F.col("change_status").isNotNull()).select(
        *KEY, "run_id", "last_seen_at",
        F.struct("was_stored", "old_hash", "old_version", "old_price", "old_availability").alias("stored"),
    )
    later = F.col("previous").isNotNull()

    def before(name: str, old: Column | str) -> Column:
        old = F.col(f"stored.{old}") if isinstance(old, str) else old
        return F.when(later, F.col(f"previous.{name}")).otherwise(old)

    old_hash = in_present_fields(F.col("stored.old_hash"), F.col("stored.old_version"), _hashes(steps.columns))
    return steps.join(stored, [*KEY, "run_id"]).select(
        *KEY, "run_id", "url", "item_seq", "content_hash",
        change_status(before("content_hash", old_hash), F.col("content_hash")).alias("change_status"),
        (later | F.col("stored.was_stored")).alias("was_stored"),
        before("current_price", "old_price").alias("old_price"),
        F.col("current_price").try_cast(PRODUCTS["current_price"]).alias("current_price"),
        F.coalesce(text.blank_to_null(F.col("currency")), F.lit(fixed.DEFAULT_CURRENCY)).alias("currency"),
        before("availability", "old_availability").alias("old_availability"),
        "availability", "last_seen_at",
    )


def price_changes_of(merged: DataFrame) -> DataFrame:
    changed = F.col("was_stored") & ~F.col("old_price").eqNullSafe(F.col("current_price"))
    return merged.where(changed).select(
        *KEY, "run_id", "old_price", F.col("current_price").alias("new_price"), "currency",
        F.col("last_seen_at").alias("changed_at"),
    )


def availability_changes_of(merged: DataFrame) -> DataFrame:
    """Seen products whose status differs; aging itself writes no log row."""
    changed = F.col("was_stored") & ~F.col("old_availability").eqNullSafe(F.col("availability"))
    return merged.where(changed).select(
        *KEY, "run_id", F.col("old_availability").alias("old_status"),
        F.col("availability").alias("new_status"), F.col("last_seen_at").alias("changed_at"),
    )


def unavailable_of(merged: DataFrame) -> DataFrame:
    """Per site, how many missing products are unavailable now (a stock, not a flow)."""
    return (
        merged.where("missed")
        .groupBy("site_id")
        .agg(F.count_if(F.col("availability") == "unavailable").alias("unavailable"))
    )


def missing_products(state: DataFrame, present: DataFrame) -> DataFrame:
    """Stored products of the sites not present in the run; an empty run misses all."""
    return state.join(present, KEY, "left_anti")
