"""Bars as a stream: late, repeated and partial bars, and episodes that are told once, when nothing can change them.

The state is the bars of every symbol so far, dealt to BUCKETS folders by a hash of the symbol.  A batch reads, merges
and detects the symbols that it brings, and replaces the folders that these lie in, each whole or not at all; everything
else stays untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.events import detect
from ..settings import SETTINGS, Settings
from ..sources.bars import BAR_SCHEMA, PRICES, drop_incomplete
from ..sources.files import exists, swap

BUCKETS = 256


def bar_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(BAR_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def weekly(stream: DataFrame, late: str = "10 days") -> DataFrame:
    """symbol, week, high, low, volume by tumbling weeks; bars later than late are left out."""
    t = stream.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    g = t.groupBy("symbol", F.window("at", "7 days", startTime="4 days").alias("w")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
    return g.select("symbol", F.to_date("w.start").alias("week"), "high", "low", "volume")


def refused(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """New bars that would rewrite a price by more than tolerance."""
    far = F.lit(False)
    for c in PRICES:
        far = far | (F.col(f"o.{c}") != 0) & (F.abs(F.col(f"n.{c}") / F.col(f"o.{c}") - 1) > tolerance)
    return new.alias("n").join(old.alias("o"), ["symbol", "date"]).filter(far).select("symbol", "date")


def merge_bars(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """old with new's bars; a symbol and date that both have keeps the new one unless it is refused.

    Of several in new the one of largest volume counts, and of these the first by its other values.
    """
    last = Window.partitionBy("symbol", "date").orderBy(F.desc("age"), F.desc("volume"), *PRICES, "adj_close", "source")
    fine = new.join(refused(old, new, tolerance), ["symbol", "date"], "left_anti")
    both = old.withColumn("age", F.lit(0)).unionByName(fine.withColumn("age", F.lit(1)))
    return both.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r", "age")


def newly_closed(bars: DataFrame, told: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Closed episodes that aren't among told (symbol, episode_id)."""
    return detect(bars, settings).filter("status = 'closed'").join(told.select("symbol", "episode_id"), ["symbol", "episode_id"], "left_anti")


class EpisodeWriter:
    """foreachBatch: merges a batch into the bars and appends what it closes; a batch that comes again changes nothing.

    now, if given, tells the UTC time at which a batch is read: bars of a session that isn't over are left out then.
    """

    def __init__(self, state: str, out: str, settings: Settings = SETTINGS, now: Callable[[], str] | None = None, buckets: int = BUCKETS):
        self.state, self.out, self.settings, self.now, self.buckets = state.rstrip("/"), out, settings, now, buckets

    def bars(self, spark: SparkSession, buckets: list[int]) -> DataFrame:
        """The bars kept in some of the folders."""
        paths = [p for p in (f"{self.state}/bars/bucket={k}" for k in buckets) if exists(spark, p)]
        return spark.read.schema(BAR_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], BAR_SCHEMA)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*BAR_SCHEMA.names)
        if self.now is not None:
            new = drop_incomplete(new, self.now(), self.settings.session_complete_after)
        bucket = F.pmod(F.xxhash64("symbol"), F.lit(self.buckets)).alias("bucket")
        touched = sorted(r.bucket for r in new.select(bucket).distinct().collect())  # BUCKETS at most
        staged = f"{self.state}/staged-{batch_id}"
        merged = merge_bars(self.bars(spark, touched), new, self.settings.rewrite_tolerance)
        merged.withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(self.buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
        for k in touched:
            if exists(spark, f"{staged}/bucket={k}"):
                swap(spark, f"{staged}/bucket={k}", f"{self.state}/bars/bucket={k}")
        # a batch's episodes have their own folder, so a batch run again writes over what it wrote
        mine = f"{self.out}/batch={batch_id}"
        told = spark.createDataFrame([], "symbol string, episode_id string, batch long")
        if exists(spark, self.out):
            told = spark.read.schema("symbol string, episode_id string, batch long").parquet(self.out).filter(F.col("batch") < batch_id)
        seen = self.bars(spark, touched).join(new.select("symbol").distinct(), "symbol", "left_semi").select(*BAR_SCHEMA.names)
        newly_closed(seen, told, self.settings).write.mode("overwrite").parquet(mine)


def run_available(spark: SparkSession, source: str, state: str, out: str, checkpoint: str, settings: Settings = SETTINGS, now: Callable[[], str] | None = None) -> DataFrame:
    """Process what the source holds and return every episode told."""
    q = bar_stream(spark, source).writeStream.foreachBatch(EpisodeWriter(state, out, settings, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch")
