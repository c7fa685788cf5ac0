"""Jobs that push changed rows and keep their own high-water mark.

Each page of changes is a numbered folder. It is published, then its mark (time and id of its last row) is written; the mark's completion file is what
commits it. A run that dies earlier leaves an uncommitted page, which the next run writes and publishes anew from the last mark, so ``publish`` has to be an
upsert by key (at least once). A row whose change time lies before the mark when it arrives is not seen again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.articles import incremental_articles

Publish = Callable[[DataFrame], None]


def changed_after(rows: DataFrame, times: list[str], mark: Column, mark_id: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose newest of ``times`` (column ``wm``) lies after the mark, or at it with an id behind ``mark_id``.

    The plain comparisons come first: they reach the scan, so files and row groups without a change are skipped. Rows without any time never change.
    """
    wm = F.greatest(*times) if len(times) > 1 else F.col(times[0])
    out = rows.where(reduce(lambda a, b: a | b, [F.col(t) >= mark for t in times])).withColumn("wm", wm)
    after = F.col("wm") > mark
    out = out.where(after | ((F.col("wm") == mark) & (F.col("id") > mark_id)) if mark_id is not None else after)
    return out.orderBy("wm", "id").limit(limit) if limit else out


def committed(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the pages whose mark is complete, ascending."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/marks")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "page=*/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done)


def pushed(spark: SparkSession, base: str) -> DataFrame:
    """All rows of committed pages, with the page's number."""
    n = committed(spark, base)
    return spark.read.parquet(f"{base}/pages").where(F.col("page") <= (n[-1] if n else -1))


def push_page(spark: SparkSession, changes: Callable[[Column, Column | None], DataFrame], base: str, first: Column, publish: Publish | None = None) -> int:
    """Push what ``changes(mark, mark_id)`` finds after the stored mark (``first`` if there is none); returns the number of rows."""
    done = committed(spark, base)
    mark, mark_id, page = first, None, done[-1] + 1 if done else 0
    if done:
        last = spark.read.parquet(f"{base}/marks/page={done[-1]}").first()
        mark, mark_id = F.timestamp_micros(F.lit(last["at"])), F.lit(last["id"])
    own = f"{base}/pages/page={page}"
    changes(mark, mark_id).write.mode("overwrite").parquet(own)
    rows = spark.read.parquet(own)
    end = rows.agg(F.count("*").alias("n"), F.max(F.struct(F.unix_micros("wm").alias("at"), "id")).alias("end"))
    found = end.first()["n"]
    if found:
        if publish is not None:
            publish(rows)
        end.select("end.*").coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/page={page}")
    return found


def _push_all(spark, changes, base, first, limit, publish) -> int:
    """Pages until nothing is left; a page shorter than ``limit`` is the last."""
    total, full = 0, True
    while full:
        n = push_page(spark, changes, base, first, publish)
        total, full = total + n, bool(limit) and n == limit
    return total


def push_articles(articles: DataFrame, base: str, now: Column, first: Column, limit: int | None = None, publish: Publish | None = None) -> int:
    """Push worthy articles processed or fetched since the last run."""
    return _push_all(articles.sparkSession, lambda mark, mark_id: incremental_articles(articles, mark, now, limit, mark_id), base, first, limit, publish)


def push_digests_calls(digests: DataFrame, calls: DataFrame, base: str, first: Column, limit: int | None = None, publish: Publish | None = None) -> tuple[int, int]:
    """Push digests created, and calls created or checked, since the last run. Each table has its own mark, so neither runs past the other's rows."""
    spark = digests.sparkSession
    return (_push_all(spark, lambda mark, mark_id: changed_after(digests, ["created_at"], mark, mark_id, limit), f"{base}/digests", first, limit, publish),
            _push_all(spark, lambda mark, mark_id: changed_after(calls, ["created_at", "outcome_checked_at"], mark, mark_id, limit), f"{base}/calls", first, limit, publish))
