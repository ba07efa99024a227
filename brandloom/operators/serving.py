"""What the pages ask of stored tables: filters, photos, matches with their creators, reasons, caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_list(values: list[str], most: int = 5_000) -> list[str]:
    """A request's ids: trimmed, each once, empty ones dropped, `most` at most (the request's limit)."""
    return list(dict.fromkeys(v.strip() for v in values if v and v.strip()))[:most]


def in_ids(df: DataFrame, column: str, ids: list[str], inline: int = 200) -> DataFrame:
    """Rows whose column is among ids: as a list, or beyond `inline` of them as a semi join."""
    if len(ids) <= inline:
        return df.where(F.col(column).cast("string").isin(ids))
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], "__id string")
    return df.join(wanted, F.col(column).cast("string") == F.col("__id"), "left_semi")


def at_least(value: Column | str, least: float | None = None, default: float = 0.35) -> Column:
    """Whether a value, 0 if there is none, reaches a threshold, which is rounded to 2 places."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value, F.lit(0.0)) >= F.lit(round(default if least is None else least, 2))


def filtered(df: DataFrame, equal: dict[str, str | None] | None = None, ids: dict[str, list[str] | None] | None = None, least: dict[str, float | None] | None = None) -> DataFrame:
    """Rows that meet every condition that is given; a condition of None asks for nothing."""
    conditions = [F.col(c) == F.lit(v) for c, v in (equal or {}).items() if v is not None] + [at_least(c, v) for c, v in (least or {}).items() if v is not None]
    out = df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df
    for column, wanted in (ids or {}).items():
        if wanted is not None:
            out = in_ids(out, column, id_list(wanted))
    return out


def pending(df: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows not done yet; all of them if forced, and then `done` isn't read."""
    return df if force else df.join(done.select(key), key, "left_anti")


def with_photo(creators: DataFrame, profiles: DataFrame, key: str, metrics: str = "metrics", path: str = "$.import_meta.stan_header_image_url") -> DataFrame:
    """creators with photo: what their metrics (JSON) say at path, else the profile's image; empty counts as none."""
    image = profiles.select(key, F.col("image").alias("__image"))
    return creators.join(image, key, "left").withColumn("photo", F.coalesce(F.nullif(F.get_json_object(metrics, path), F.lit("")), "__image")).drop("__image")


def matches_page(matches: DataFrame, creators: DataFrame, brand: str | int, most: int = 12) -> DataFrame:
    """A brand's best matches with their creators' columns."""
    return matches.where(F.col("brand_id") == brand).join(creators, "creator_id").orderBy(F.desc("score"), "creator_id").limit(most)


def dashboard(matches: DataFrame, brands: DataFrame, creators: DataFrame, brand: str | int, most: int = 12) -> DataFrame:
    """status, score, brand_name and creator_name of a brand's best matches."""
    own = matches.where(F.col("brand_id") == brand).join(brands.select("brand_id", "brand_name"), "brand_id").join(creators.select("creator_id", "creator_name"), "creator_id")
    return own.orderBy(F.desc("score"), "creator_id").limit(most).select("status", "score", "brand_name", "creator_name", "creator_id")


def to_match(brands: DataFrame, matches: DataFrame) -> DataFrame:
    """Brands whose matches have to be worked out: none are kept, or a refresh is asked for (column refresh)."""
    kept = matches.select("brand_id").distinct().withColumn("__kept", F.lit(True))
    return brands.join(kept, "brand_id", "left").where(F.coalesce("refresh", F.lit(False)) | F.col("__kept").isNull()).drop("__kept")


def without_refreshed(matches: DataFrame, brands: DataFrame) -> DataFrame:
    """matches less those of brands that ask for a refresh."""
    return matches.join(brands.where("refresh").select("brand_id"), "brand_id", "left_anti")


def reasons_of(stored: Column | str) -> Column:
    """Struct of reasons and breakdown (JSON) from either shape: an array of reasons, or an object that has them."""
    x = F.trim(F.col(stored) if isinstance(stored, str) else stored)
    listed = F.coalesce(F.from_json(F.when(x.startswith("["), x), "array<string>"), F.from_json(F.get_json_object(F.when(x.startswith("{"), x), "$.reasons"), "array<string>"))
    return F.struct(F.coalesce(listed, F.array().cast("array<string>")).alias("reasons"), F.get_json_object(F.when(x.startswith("{"), x), "$.breakdown").alias("breakdown"))
