"""Streams over append-only logs: one copy of each message, the latest state per key, tasks that are still open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import messages, select


def read_log(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once_within(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Call deliveries without repetitions that arrive within the given time of each other; the state is bounded by the watermark.

    Deliveries without request_hash or created_at are messages of their own. What comes later than the watermark allows is for the batch operator.
    """
    keys = messages.call_message_keys()
    keyed = stream.withColumns({f"k{i}": c for i, c in enumerate(keys.values())})
    own = F.concat(F.lit("#"), F.col("delivery_id").cast("string"))
    complete = F.col("k0").isNotNull() & F.col("k1").isNotNull() & F.col("k2").isNotNull()
    keyed = keyed.withColumn("message", F.when(complete, F.sha2(F.concat_ws("\u0001", "k0", "k1", F.col("k2").cast("long").cast("string"), F.date_format("k2", "SSSSSS")), 256)).otherwise(own))
    return keyed.withWatermark("delivered_at", late).dropDuplicatesWithinWatermark(["message"]).drop("k0", "k1", "k2", "message")


def windowed_counts(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Deliveries and failures per provider and hour of delivery."""
    failed = F.col("status").isin("API_ERROR", "WORKER_ERROR")
    return stream.withWatermark("delivered_at", late).groupBy(F.window("delivered_at", size), "provider").agg(F.count(F.lit(1)).alias("deliveries"), F.count_if(failed).alias("failed"))


def keep_latest(stream: DataFrame, key: str, order: list[str], target: str, checkpoint: str):
    """Maintains a table with the latest row of each key. Each micro-batch is reduced first, then merged into the next version of the table.

    A batch writes version n + 1 whole before it is named current, so a batch that is run again gives the same table.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = select.last_wins(batch, [key], order)
        last = f"{target}/v{n - 1}"
        path = spark._jvm.org.apache.hadoop.fs.Path(last)
        if n and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = select.last_wins(spark.read.parquet(last).unionByName(fresh), [key], order)
        fresh.write.mode("overwrite").parquet(f"{target}/v{n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def work_off(tasks: DataFrame, log: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], out: str, waves: int, target: int) -> int:
    """Runs work on tasks not yet in the log, in waves, until target results are there; each wave's results are appended to out. Returns the number of waves.

    A wave is a plan over all open tasks of its hash class; which are open is an anti join, so a broken run goes on where it stopped.
    """
    spark = tasks.sparkSession
    done = log.select(key)
    for wave in range(waves):
        todo = tasks.where(F.pmod(F.xxhash64(key), F.lit(waves)) == wave).join(done, key, "left_anti")
        work(todo).write.mode("append").parquet(out)
        if spark.read.parquet(out).count() >= target:
            return wave + 1
    return waves
