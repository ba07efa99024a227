"""Writes as DataFrames: upserts, inserts, updates, deletes and moves. Each returns the new table; writing it is the caller's step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import latest


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """existing with the rows of new put in by key; columns in keep stay as they were for rows that existed.

    order: which of several new rows with one key counts (the first); without it, the least by all columns.
    """
    fresh = first_of_each(new, keys, order)
    untouched = existing.join(fresh.select(*keys), keys, "left_anti")
    if keep:
        old = existing.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep], F.lit(True).alias("__was"))
        fresh = fresh.join(old, keys, "left").withColumns({c: F.when(F.col("__was"), F.col(f"__{c}")).otherwise(F.col(c)) for c in keep}).drop("__was", *[f"__{c}" for c in keep])
    return untouched.unionByName(fresh.select(*existing.columns))


def first_of_each(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The first row of each key by order; without it, the least by all columns as JSON, so that the same rows give the same result."""
    return latest(df, keys, order or [F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))])


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    return existing.unionByName(first_of_each(new, keys, order).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def move(source: DataFrame, target: DataFrame, condition: Column, key: str, origin: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(source without the rows that condition picks, target with them). A moved row keeps the origin that the target has for it, else gets label."""
    moving = source.where(condition).join(target.select(key, F.col(origin).alias("__origin")), key, "left")
    moving = moving.withColumn(origin, F.coalesce("__origin", F.lit(label))).drop("__origin")
    return delete_where(source, condition), upsert(target, moving.select(*target.columns), [key])


def cascade(child: DataFrame, parent: DataFrame, on: str, parent_key: str) -> DataFrame:
    """child without rows whose parent is gone."""
    return child.join(parent.select(F.col(parent_key).alias(on)), on, "left_semi")


def stable_id(prefix: str, *natural: Column | str) -> Column:
    """An id from a natural key, the same in every run: the whole digest over its parts, of which nulls are marked and lengths given."""
    parts = [F.col(x) if isinstance(x, str) else x for x in natural]
    told = [F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string"))) for x in parts]
    return F.concat(F.lit(f"{prefix}_"), F.sha2(F.concat(*told), 256))
