"""Named queries over the test tables and, where SQL can express them, the equivalent SQL."""

from __future__ import annotations


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def core() -> tuple[dict, dict]:
    """All queries of the core, and their SQL."""
    from tidewright.queries import assess, manage, migrate, more, problems

    found, sql = {}, {}
    for module in (problems, assess, migrate, manage, more):
        found |= module.QUERIES
        sql |= module.SQL
    return found, sql
