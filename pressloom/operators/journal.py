"""Upserts and keyed writes without a MERGE: joins over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """`old` and the rows of `new` with a key that it lacks; of several with one key the first by `order`."""
    columns = new.columns
    fresh = new.join(old.select(key), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("w")).select("w.*")
    return old.unionByName(fresh)


def upsert(journal: DataFrame, new: DataFrame) -> DataFrame:
    """The url journal after a run: last_seen and verdict replaced, attempts added, the first day kept, a vector kept unless a new one comes."""
    n = new.select(F.col("url").alias("n_url"), "day", "n", F.col("verdict").alias("n_verdict"), F.col("embedding").alias("n_embedding"))
    both = journal.join(n, F.col("url") == F.col("n_url"), "full_outer")
    hit = F.col("n_url").isNotNull()
    return both.select(
        F.coalesce("url", "n_url").alias("url"),
        F.coalesce("first_seen", "day").alias("first_seen"),
        F.when(hit, F.col("day")).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(hit, F.col("n_verdict")).otherwise(F.col("verdict")).alias("verdict"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("attempts"),
        F.coalesce("n_embedding", "embedding").alias("embedding"),
    )


def dictionary(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """column, column_k: dense numbers of the distinct values. For dimensions of bounded size: the numbering runs in one task."""
    order = F.desc(column) if descending else F.asc(column)
    return df.where(F.col(column).isNotNull()).select(column).distinct().withColumn(f"{column}_k", F.row_number().over(Window.orderBy(order)) - 1)


def migrated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`df` with the columns that an older table lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def orphans(mapped: DataFrame, overviews: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The urls of `mapped` (url, key) that are not `live`, and the keys of `overviews` that no remaining url maps to."""
    gone = mapped.join(live, "url", "left_anti").select("url")
    kept = mapped.join(live, "url", "left_semi")
    return gone, overviews.join(kept.select("key"), "key", "left_anti")
