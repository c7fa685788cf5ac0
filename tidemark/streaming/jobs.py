"""The periodic jobs as Structured Streaming queries.

Each function turns a stream (or a folder of landed files) into another stream; :func:`drain` runs one to the end of the
available data. State is bounded by watermarks, and sinks are files or ``foreachBatch`` merges, so a lost executor only
repeats a micro-batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import lookups as K
from ..operators.articles import notify_candidates
from ..operators.keyed import latest_per_key
from ..operators.scoring import rule_classify
from ..session import shared_dir


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def stream_articles(articles: DataFrame, late: str = "7 days", ts: str = "published_at") -> DataFrame:
    """New articles once per url; the url memory is as long as the watermark delay."""
    return articles.withWatermark(ts, late).dropDuplicatesWithinWatermark(["url"])


def stream_enrich(articles: DataFrame, **rules) -> DataFrame:
    """Rule labels on arrival: stateless, so any micro-batch can be retried."""
    return rule_classify(articles, **rules)


def stream_sentiment_index(items: DataFrame, models=("lex", "finbert", "ens", "old"), late: str = "2 hours", half_life_h: float = 12.0,
                           window_h: int = 48, lead_h: int = 24) -> DataFrame:
    """Append-mode (ts, symbol, model, idx, n_lead, wsum) per closed hour.

    Two chained windows: items first fold into their own hour, then closed hours slide over ``window_h`` hours. An item
    enters the state once instead of once per overlapping window. Windows are half open, so an item exactly on the hour
    belongs to the next hour only (the batch index keeps both ends).
    """
    long = items.withWatermark("ts", late).select("symbol", "ts", "novelty", (
        F.col("src_w") * F.col("event_w") * F.col("rel") * F.col("novelty") * (1.0 + F.least(F.col("confirm"), F.lit(4)) * 0.1)).alias("w"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in models])).alias("x"))
    long = long.where(F.col("x.score").isNotNull())
    age = 1.0 - (F.unix_micros("ts") % F.lit(3_600_000_000)) / F.lit(3_600_000_000)  # hours to the end of the item's own hour
    w = F.col("w") * F.pow(F.lit(0.5), age / half_life_h)
    hourly = long.withColumns({"__num": w * F.col("x.score"), "__den": w}).groupBy(F.window("ts", "1 hour").alias("hour"), "symbol", "x.model").agg(
        F.sum("__num").alias("num"), F.sum("__den").alias("den"), F.count_if(F.col("novelty") == 1.0).alias("lead"))
    spread = hourly.withColumn("hour_end", F.unix_seconds("hour.end")).withColumn("span", F.window(F.window_time("hour"), f"{window_h} hours", "1 hour"))
    gap = (F.unix_seconds("span.end") - F.col("hour_end")) / 3600.0
    decay = F.pow(F.lit(0.5), gap / half_life_h)
    spread = spread.withColumns({"__num": F.col("num") * decay, "__den": F.col("den") * decay, "__lead": F.when(gap < lead_h, F.col("lead")).otherwise(0)})
    out = spread.groupBy("span", "symbol", "model").agg(F.sum("__num").alias("num"), F.sum("__den").alias("wsum"), F.sum("__lead").alias("n_lead"))
    return out.select(F.col("span.end").alias("ts"), "symbol", "model", (F.col("num") / F.col("wsum")).alias("idx"), F.col("n_lead").cast("int").alias("n_lead"), "wsum")


def stream_zscore_alerts(snaps: DataFrame, z: float = 2.0, min_stories: int = 4, cooldown_h: int = 6, allowed=None, model: str = "ens", late: str = "1 day") -> DataFrame:
    """Alerts with a per-symbol cooldown kept as state: the time of the last fired alert.

    Only triggers reach Python, at most one per symbol and snapshot. Within a micro-batch they are taken in time order. A symbol's state goes once the
    watermark has passed the end of its cooldown, when it can hold back nothing any more; snapshots later than ``late`` are dropped.
    """
    allowed = K.ALERT_SYMBOLS if allowed is None else allowed
    hot = snaps.withWatermark("ts", late).where((F.col("model") == model) & (F.abs("z") >= z) & (F.col("n_lead") >= min_stories))
    if allowed:
        hot = hot.where(F.col("symbol").isin(list(allowed)))
    cool = cooldown_h * 3_600_000_000

    def fire(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        trig = pd.concat(list(frames)).sort_values("t", kind="stable")
        fired = []
        for t, zv in zip(trig["t"], trig["z"]):
            if last is None or t - last >= cool:
                last = int(t)
                fired.append((key[0], last, float(zv)))
        end = -(-(last + cool) // 1000)  # milliseconds, rounded up
        if end > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        if fired:
            yield pd.DataFrame(fired, columns=["symbol", "t", "z"])

    out = hot.select("symbol", "ts", F.unix_micros("ts").alias("t"), "z").groupBy("symbol").applyInPandasWithState(
        fire, "symbol string, t long, z double", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.timestamp_micros("t").alias("ts"), "symbol", F.lit("sentiment").alias("kind"), "z")


def live_counts(articles: DataFrame, every: str = "1 hour", late: str = "2 hours", ts: str = "published_at") -> DataFrame:
    """Rolling arrival counts, for update mode."""
    return articles.withWatermark(ts, late).groupBy(F.window(ts, every)).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def path_exists(spark, path: str) -> bool:
    """Whether a folder is there, asked of the file system that holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stream_notifications(articles: DataFrame, notified_path: str, checkpoint: str, threshold: int = 70, holdings=None, publish: Callable[[DataFrame], None] | None = None):
    """Start a query that notifies each qualifying article once: batch minus the notified table, then append to it.

    The table has a folder per run (named after the checkpoint) and batch. A retried batch finds its own folder and rewrites it; batches of every other
    run and number count as notified, so neither a retry nor a new checkpoint over the same table notifies twice.
    """
    spark = articles.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def step(batch: DataFrame, batch_id: int) -> None:
        if path_exists(spark, notified_path):
            seen = spark.read.parquet(notified_path).where((F.col("run").cast("string") != run) | (F.col("batch") != batch_id))
        else:
            seen = spark.createDataFrame([], f"id {batch.schema['id'].dataType.simpleString()}")
        rows = latest_per_key(notify_candidates(batch, seen, threshold, holdings).select("id", "title", "published_at", "held"), ["id"], ["published_at"])
        own = f"{notified_path}/run={run}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(own)
        if publish is not None:
            publish(spark.read.parquet(own))

    return articles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available data into files of the shared folder and return them as a table.

    In update mode every change is kept under its batch number in the column ``__batch``.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/__batch={batch_id}")

    w.foreachBatch(keep).start().awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/*")


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key from an update-mode table."""
    return latest_per_key(updates.withColumnRenamed("__batch", "batch"), keys, ["batch"]).drop("batch")
