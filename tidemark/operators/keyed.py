"""Keyed row selection by aggregation.

``min_by``/``max_by`` combine on the map side, so a key that holds a third of all rows still shuffles one row per
task. A whole row in the buffer keeps Spark from hashing it: each side sorts its rows by key first, which spills to
disk and needs no memory for a key's rows together. Pass narrow rows where the rest can be joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: Column, agg, extra: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and not c.startswith("__")]
    out = df.groupBy(*keys).agg(agg(F.struct(*rest), order).alias("__row"), *extra)
    extra_names = [c for c in out.columns if c not in keys and c != "__row"]
    return out.select(*keys, *[F.col("__row")[c].alias(c) for c in rest if c not in extra_names], *extra_names)


def _order(cols) -> Column:
    return F.struct(*[c if isinstance(c, Column) else F.col(c) for c in cols])


def latest_per_key(df: DataFrame, keys: list[str], order: list, extra: list[Column] | None = None) -> DataFrame:
    """The row with the greatest ``order`` per key."""
    return _pick(df, keys, _order(order), F.max_by, extra or [])


def first_per_key(df: DataFrame, keys: list[str], order: list, extra: list[Column] | None = None) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    return _pick(df, keys, _order(order), F.min_by, extra or [])


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], mode: str = "overwrite") -> DataFrame:
    """``ignore`` keeps existing rows; ``overwrite`` replaces them. Among batch rows of one key any order column must
    already have been resolved (see :func:`latest_per_key`)."""
    if mode == "ignore":
        return target.unionByName(batch.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    if mode == "overwrite":
        return target.join(batch.select(*keys), keys, "left_anti").unionByName(batch, allowMissingColumns=True)
    raise ValueError(f"mode must be ignore or overwrite, not {mode!r}")


def patch(df: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Update columns of ``df`` from non-null columns of ``edits`` (at most one edit row per key)."""
    changed = [c for c in edits.columns if c not in keys]
    e = edits.select(*keys, *[F.col(c).alias(f"__e_{c}") for c in changed])
    joined = df.join(e, keys, "left")
    new = {c: F.coalesce(F.col(f"__e_{c}"), F.col(c)) if c in df.columns else F.col(f"__e_{c}") for c in changed}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns],
                         *[new[c].alias(c) for c in changed if c not in df.columns])
