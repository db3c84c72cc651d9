"""Aggregates over scores: rates, grouping sets, micro and macro averages, deltas, cluster bootstrap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(flag: Column, empty: float | None = None) -> Column:
    """The part of rows that hold; NULL flags do not count. Without rows: NULL, or the number given."""
    r = F.avg(flag.cast("int"))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def blocks(df: DataFrame, dims: list[str], measures: list[Column]) -> DataFrame:
    """Measures overall and by each dimension alone, in one pass over the data (grouping sets)."""
    sets = [[], *([d] for d in dims)]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(*measures)


def macro(df: DataFrame, by: list[str], cluster: str, value: Column) -> DataFrame:
    """Mean of cluster means beside the mean of rows, per group."""
    each = df.groupBy(*by, cluster).agg(F.avg(value).alias("__m"), F.sum(value).alias("__s"), F.count(value).alias("__n"))
    return each.groupBy(*by).agg(F.avg("__m").alias("macro"), (F.sum("__s") / F.sum("__n")).alias("micro"), F.count(F.lit(1)).alias("clusters"), F.sum("__n").alias("rows"))


def paired_delta(df: DataFrame, unit: str, run: str, value: Column, baseline: str) -> DataFrame:
    """Per run against the baseline, over units both have: mean difference, units better and worse."""
    each = df.groupBy(run, unit).agg(F.avg(value).alias("__v"))
    base = each.where(F.col(run) == baseline).select(unit, F.col("__v").alias("__b"))
    both = each.where(F.col(run) != baseline).join(base, unit)
    return both.groupBy(run).agg(F.avg(F.col("__v") - F.col("__b")).alias("delta"), F.count_if(F.col("__v") > F.col("__b")).alias("better"), F.count_if(F.col("__v") < F.col("__b")).alias("worse"), F.count(F.lit(1)).alias("units"))


def hash_int(modulo: Column, *parts: Column) -> Column:
    """A reproducible number from 0 to modulo - 1: 15 hexadecimal digits of a SHA-256, the same in every engine."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("long"), modulo)


def cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, value: Column, iterations: int, seed: str, buckets: int = 4096) -> DataFrame:
    """Percentile interval (2.5, 50, 97.5) of a mean, resampling whole clusters with a hash as random source.

    Clusters are first summed to (numerator, denominator) and spread over a fixed number of buckets by hash; buckets are what is resampled, so that the
    work is iterations x buckets however many clusters there are. With fewer clusters than buckets, buckets of several clusters are rare.
    """
    each = df.groupBy(*by, cluster).agg(F.sum(value).alias("__num"), F.count(value).alias("__den"))
    units = each.withColumn("bucket", hash_int(F.lit(buckets), F.lit(seed), F.col(cluster))).groupBy(*by, "bucket").agg(F.sum("__num").alias("num"), F.sum("__den").alias("den"))
    spark = df.sparkSession
    listed = units.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bucket", "num", "den"))).alias("u"))  # at most `buckets` entries
    draws = listed.crossJoin(F.broadcast(spark.range(iterations).withColumnRenamed("id", "it")))
    keys = F.concat_ws("/", *[F.col(b).cast("string") for b in by])
    drawn = F.transform(F.sequence(F.lit(1), F.size("u")), lambda i: F.get(F.col("u"), hash_int(F.size("u").cast("long"), F.lit(seed), keys, F.col("it").cast("string"), i.cast("string")).cast("int")))
    sums = draws.repartition("it").withColumn("d", drawn).select(*by, "it", (F.aggregate("d", F.lit(0.0), lambda s, x: s + x["num"]) / F.aggregate("d", F.lit(0.0), lambda s, x: s + x["den"])).alias("stat"))
    ordered = sums.groupBy(*by).agg(F.array_sort(F.collect_list("stat")).alias("s"))
    at = lambda p: F.get("s", F.least(F.size("s") - 1, F.floor(F.size("s") * p).cast("int")))
    return ordered.select(*by, at(0.025).alias("low"), at(0.5).alias("mid"), at(0.975).alias("high"))


def whole_cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, value: Column, iterations: int, seed: str, block: int = 500) -> DataFrame:
    """Percentile interval (2.5, 50, 97.5) of a mean, resampling true clusters, as many as there are, with replacement.

    Clusters of equal (numerator, denominator) are interchangeable: how often a resample takes each such class is one multinomial draw, which has
    exactly the distribution of drawing cluster by cluster. So the work is iterations x classes. Blocks of iterations have their own seed and run in parallel.
    """
    each = df.groupBy(*by, cluster).agg(F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("num"), F.count(value).cast("double").alias("den"))
    classes = each.groupBy(*by, "num", "den").agg(F.count(F.lit(1)).alias("k"))
    listed = classes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("num", "den", "k"))).alias("u"))
    listed = listed.select(*by, F.to_json(F.struct(*by)).alias("__key"), *[F.col(f"u.{c}").alias(c) for c in ("num", "den", "k")])
    starts = df.sparkSession.range(0, iterations, block).withColumnRenamed("id", "it")
    blocks_ = listed.crossJoin(F.broadcast(starts)).repartition("it", "__key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            stats = []
            for key, it, num, den, k in zip(f["__key"], f["it"], f["num"], f["den"], f["k"]):
                rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{key}:{it}".encode()).digest()[:16], "big"))
                n, left, out = int(k.sum()), min(block, iterations - it), []
                while left:
                    draws = rng.multinomial(n, k / n, min(left, max(1, 1_000_000 // len(k))))
                    left -= len(draws)
                    out.append((draws @ num) / np.where((d := draws @ den) > 0, d, np.nan))
                x = np.concatenate(out)
                stats.append(x[~np.isnan(x)])
            yield f[by].assign(stat=stats)

    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    sums = blocks_.mapInPandas(run, f"{kinds}, stat array<double>")
    ordered = sums.groupBy(*by).agg(F.array_sort(F.flatten(F.collect_list("stat"))).alias("s"))
    at = lambda p: F.get("s", F.least(F.size("s") - 1, F.floor(F.size("s") * p).cast("int")))
    return ordered.select(*by, at(0.025).alias("low"), at(0.5).alias("mid"), at(0.975).alias("high"))
