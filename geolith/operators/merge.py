"""Amending a table by another: a relational merge with four methods and three ways with what is there already.

target and updates share a key. Update columns overlap with the target's, or are new.

method: update-set (one update a row, duplicates are an error), left-join (k matches replace the row by k), outer-join (and unmatched updates are
added), right-join (and rows without any update go). if_exists: set-null (overlapping columns lose their old values, matched or
not), preserve (old values stay where nothing matched), drop-column (as set-null, and the columns move to the end, as new ones).
Null keys never match: such updates are unmatched. Update rows that share an unknown key are all added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS, EXISTING = ("update-set", "left-join", "outer-join", "right-join"), ("set-null", "preserve", "drop-column")


def amend(target: DataFrame, updates: DataFrame, key: str, method: str = "update-set", if_exists: str = "set-null", mark: str | None = None) -> DataFrame:
    """mark: name of a column to add, true for rows that come from the target."""
    if method not in METHODS or if_exists not in EXISTING:
        raise ValueError(f"no such method or policy: {method}, {if_exists}")
    if method == "update-set":
        twice = duplicate_keys(updates, key).head(1)
        if twice:
            raise ValueError(f"Multiple matched rows: key {twice[0][key]!r}")
    new = [c for c in updates.columns if c != key]
    overlap = [c for c in new if c in target.columns]
    u = updates.select(F.col(key).alias("_key"), *(F.col(f"`{c}`").alias(f"_new_{c}") for c in new), F.lit(True).alias("_hit"))
    how = {"update-set": "left", "left-join": "left", "outer-join": "full_outer", "right-join": "right"}[method]
    both = target.withColumn("_old", F.lit(True)).join(u, F.col(key) == F.col("_key"), how)

    def value(c):
        if c == key:
            return F.coalesce(F.col(f"`{key}`"), F.col("_key")).alias(key)
        if c not in overlap:
            return F.col(f"`{c}`")
        fresh = F.when(F.col("_hit"), F.col(f"`_new_{c}`"))
        return (fresh.otherwise(F.col(f"`{c}`")) if if_exists == "preserve" else fresh).alias(c)

    olds = [c for c in target.columns if not (if_exists == "drop-column" and c in overlap)]
    added = [c for c in new if c not in olds]
    return both.select(*(value(c) for c in olds), *(F.when(F.col("_hit"), F.col(f"`_new_{c}`")).alias(c) for c in added), *([F.coalesce("_old", F.lit(False)).alias(mark)] if mark else []))


def duplicate_keys(updates: DataFrame, key: str) -> DataFrame:
    """Keys of more than one update, with their number; null keys are never marked."""
    return updates.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def by_key(key: str):
    """Window over the rows of a key."""
    return Window.partitionBy(key)
