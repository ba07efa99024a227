"""Tables that change together: written beside what is there, and made visible by one rename.

A version is a folder of tables below a root. It is staged under a hidden name, and renamed once all its tables are written;
readers take the newest version that holds the table they ask for. So a reader meets all tables of a change or none, a run that
dies between two tables leaves the old ones, and a version may be computed from the one that it replaces. Of two writers that
prepare the same version the second is refused. File systems without an atomic rename of folders (object stores) need a
committer of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .shared import file_system, shuffles_go


class Conflict(RuntimeError):
    """Another writer has published the version first."""


def _names(spark: SparkSession, path: str) -> list[str]:
    system, place = file_system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def versions(spark: SparkSession, root: str, name: str | None = None) -> list[str]:
    """The versions below root, oldest first; with a name, those that hold this table."""
    found = [v for v in _names(spark, root) if v.startswith("v")]
    return found if name is None else [v for v in found if name in _names(spark, f"{root}/{v}")]


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], keep: int = 2) -> str:
    """Writes tables as the next version, and gives its name. Tables that are left out stay as they are; of each, `keep` versions stay."""
    there = versions(spark, root)
    version = f"v{int(there[-1][1:]) + 1 if there else 0:010d}"
    token = f"_{uuid.uuid4().hex}"
    staged = f"{root}/{token}"
    system, place = file_system(spark, staged)
    try:
        with shuffles_go(spark):
            for name, df in tables.items():
                df.write.parquet(f"{staged}/{name}")
        system.create(file_system(spark, f"{staged}/{token}")[1], True).close()
        target = file_system(spark, f"{root}/{version}")[1]
        if not system.exists(target):
            system.rename(place, target)
        if not system.exists(file_system(spark, f"{root}/{version}/{token}")[1]):
            raise Conflict(f"{version} of {root} is there already")
    finally:
        system.delete(place, True)
    for name in tables:
        for old in versions(spark, root, name)[:-keep]:
            system.delete(file_system(spark, f"{root}/{old}/{name}")[1], True)
    return version


def read(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The newest version of a table; None if there is none."""
    found = versions(spark, root, name)
    return spark.read.parquet(f"{root}/{found[-1]}/{name}") if found else None
