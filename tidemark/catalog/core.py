"""Registry of runnable queries with their checking SQL, and the mapping of given tables onto news and price inputs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import FIXTURES

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
               "conversations").split()
_REF = re.compile(r"\{(\w+)\}")


def base_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. Zone-less timestamps are read as UTC instants by schema, so filters on them still reach the scan."""
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if any(isinstance(f.dataType, T.TimestampNTZType) for f in schema):
        schema = T.StructType([T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType) for f in schema])
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    return spread(df) if name in ("documents", "pages") else df


def spread(df: DataFrame) -> DataFrame:
    """Give a plain scan at least one split per core: a small file is a single row group and would be one task.

    A large table has more splits than cores and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


@dataclass(frozen=True)
class Inputs:
    spark: SparkSession
    sf: str

    def __getitem__(self, name: str) -> DataFrame:
        """A given table or a fixture by name."""
        if name in BASE_TABLES:
            return base_table(self.spark, self.sf, name)
        return self.spark.sql(_REF.sub(lambda m: self._view(m[1]), FIXTURES[name]))

    def _view(self, name: str) -> str:
        view = f"{name}_{hashlib.md5(self.sf.encode()).hexdigest()[:8]}"
        self[name].createOrReplaceTempView(view)
        return view


RUN: dict[str, Callable[[Inputs], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in RUN:
            raise ValueError(f"query {name} registered twice")
        RUN[name] = fn
        if sql is not None:
            SQL[name] = expand(sql)
        return fn
    return register


def expand(sql: str) -> str:
    """Put the fixtures a statement names in front of it as CTEs."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _REF.findall(text):
            if name in FIXTURES and name not in order:
                need(FIXTURES[name])
                order.append(name)

    need(sql)
    plain = lambda t: _REF.sub(lambda m: m[1] if m[1] in FIXTURES or m[1] in BASE_TABLES else m[0], t)
    ctes = ", ".join(f"{n} AS ({plain(FIXTURES[n])})" for n in order)
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def ts_text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def day_text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def rounded(c: str | Column, n: int = 6) -> Column:
    return F.round(c, n)


def joined(c: str | Column, sep: str = ",") -> Column:
    return F.array_join(c, sep)


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


NOW_NEWS, NOW_CALLS = "2024-01-31 00:00:00", "2001-12-01 00:00:00"
