"""Views that follow the tail of a series: coarser bars and a volume profile of bars that are still revised.

Bars come in micro-batches; a bar may come again with a higher version, or be taken back (`deleted`). A micro-batch is
written to a log by stretch of time, and only what it touches is done again: the buckets that its bars are of are
aggregated anew from the log's stretches they lie in, and the profile gets signed differences, the new volumes of these
bars less what they had before. What was before is what batches of lower numbers say, so a retry does the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.resample import bucket, resample
from tickloom.operators.orderflow import tick_of

BAR = ["symbol", "time", "open", "high", "low", "close", "volume"]
PRICES = "time long, open double, high double, low double, close double, volume double"
#: Given to readers, so that none opens a file to find them.
SCHEMAS = {
    "log": f"symbol string, {PRICES}, version long, deleted boolean, bucket long, batch int, stretch long",
    "bars": f"symbol string, bucket long, {PRICES}, batch int",
    "levels": "symbol string, tick long, volume double, bars long, batch int",
}


class LiveViews:
    """Coarser bars of `seconds` and the volume by price level of `size`, kept in a folder that all executors share.

    `run` is a foreachBatch function over symbol, time, prices, volume, version, deleted. Of rows with one symbol and time
    the highest version counts, of equal ones that of the later batch. Null symbols are a symbol like others; bars without
    a close or a volume have no part in the profile. `stretch` buckets of a series lie in one folder of the log.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: int, size: float, origin: int = 0, stretch: int = 64):
        self.spark, self.folder, self.seconds, self.size, self.origin, self.stretch = spark, folder, seconds, size, origin, stretch

    def _read(self, name: str, number: int | None = None) -> DataFrame | None:
        """The rows of a table from batches before `number`, or all; None where there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        known = sorted(int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(path)) if files.exists(path) else []
        wanted = [f"{self.folder}/{name}/batch={k}" for k in known if number is None or k < number]
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.folder}/{name}").parquet(*wanted) if wanted else None

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket(self.seconds, self.origin)).withColumn("stretch", F.floor(F.col("bucket") / self.stretch).cast("long"))

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        cols = [c for c in rows.columns if c not in ("symbol", "time")]
        return rows.groupBy("symbol", "time").agg(F.max_by(F.struct(*cols), F.struct("version", "batch")).alias("row")).select("symbol", "time", "row.*")

    @staticmethod
    def _within(rows: DataFrame, most: int = 1000) -> F.Column:
        """That a row is of the rows' stretches, which are folders of the log: one by one up to `most`, beyond by their range."""
        few = [r[0] for r in rows.select("stretch").distinct().limit(most + 1).collect()]
        if len(few) <= most:
            return F.col("stretch").isin(few)
        return F.col("stretch").between(*rows.agg(F.min("stretch"), F.max("stretch")).first())

    def _levels(self, rows: DataFrame, sign: int) -> DataFrame:
        known = rows.where("NOT deleted AND close IS NOT NULL AND volume IS NOT NULL")
        return known.select("symbol", tick_of("close", self.size).alias("tick"), (sign * F.col("volume")).alias("volume"), F.lit(sign).alias("bars"))

    def run(self, batch: DataFrame, number: int) -> None:
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        typed = [F.col("symbol").cast("string"), F.col("time").cast("long"), *(F.col(c).cast("double") for c in BAR[2:]), F.col("version").cast("long")]
        fresh = self._newest(self._placed(batch.select(*typed, deleted.alias("deleted"), F.lit(number).alias("batch")))).persist()
        held = self._read("log", number)
        touched = fresh.select(F.col("symbol").alias("_s"), F.col("bucket").alias("_b")).distinct()
        same = F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))
        if held is None:
            after, before = fresh, None
        else:
            old = self._newest(held.where(self._within(fresh)).join(touched, same, "left_semi").select(*fresh.columns))
            after = self._newest(old.unionByName(fresh))
            keys = fresh.select(F.col("symbol").alias("_s"), F.col("time").alias("_t"))
            before = old.join(keys, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("time") == F.col("_t")), "left_semi")
        bars = resample(after.where("NOT deleted"), self.seconds, self.origin).withColumn("_bucket", bucket(self.seconds, self.origin))
        # a bucket whose last bar was taken back has no bar, and is written as empty
        shown = touched.join(bars, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
        shown.select(F.col("_s").alias("symbol"), F.col("_b").alias("bucket"), *BAR[1:]).write.mode("overwrite").parquet(f"{self.folder}/bars/batch={number}")
        keys = fresh.select(F.col("symbol").alias("_s"), F.col("time").alias("_t"))
        now = after.join(keys, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("time") == F.col("_t")), "left_semi")
        changes = self._levels(now, 1) if before is None else self._levels(now, 1).unionByName(self._levels(before, -1))
        changes.groupBy("symbol", "tick").agg(F.sum("volume").alias("volume"), F.sum("bars").alias("bars")).write.mode("overwrite").parquet(f"{self.folder}/levels/batch={number}")
        fresh.drop("batch").write.mode("overwrite").partitionBy("stretch").parquet(f"{self.folder}/log/batch={number}")
        fresh.unpersist()

    def bars(self) -> DataFrame:
        """The coarser bars as they are now."""
        rows = self._read("bars")
        last = rows.groupBy("symbol", "bucket").agg(F.max_by(F.struct(*BAR[1:]), "batch").alias("row")).select("symbol", "row.*")
        return last.where("time IS NOT NULL").select(*BAR)

    def profile(self) -> DataFrame:
        """symbol, tick, volume, bars: the volume of the bars that close at each level, and how many they are."""
        return self._read("levels").groupBy("symbol", "tick").agg(F.sum("volume").alias("volume"), F.sum("bars").alias("bars")).where("bars > 0")
