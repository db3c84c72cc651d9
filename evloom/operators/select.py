"""Selections that do not depend on partitioning or row order: hash top-k, first and last wins, caps, cyclic neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def stable_rank(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by a colon: the order of a reproducible sample."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle, so a hot group sends k rows per task."""
    return ranked(df, by, order, "__rn").where(F.col("__rn") <= k).drop("__rn")


def hash_sample(df: DataFrame, by: list[str], id_col: str, k: int, seed: str) -> DataFrame:
    """k rows per group by hash of seed and id: a larger k keeps the smaller sample as its beginning."""
    return top_k(df, by, [stable_rank(F.lit(seed), F.col(id_col)), F.col(id_col)], k)


def beyond_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The rows a top-k leaves over. Whether a row is among them needs its group's order only up to k: the k-th key is found first."""
    last = top_k(df.select(*by, F.struct(*order).alias("__o")), by, [F.col("__o")], k).groupBy(*by).agg(F.max("__o").alias("__last"), F.count(F.lit(1)).alias("__n"))
    same = df.withColumn("__o", F.struct(*order)).join(last.where(F.col("__n") >= k), by)
    return same.where(F.col("__o") > F.col("__last")).drop("__o", "__last", "__n")


def _one_of(df: DataFrame, key: list[str], order: list[str], of) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    row = of(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*key).agg(row).select(*[c if c in key else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the smallest order; one aggregation, combined before the shuffle. All columns of df go through it: select those needed first."""
    return _one_of(df, key, order, F.min_by)


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order, as first_wins."""
    return _one_of(df, key, order, F.max_by)


def times(df: DataFrame, few: DataFrame, column: str) -> DataFrame:
    """Each row of df with every value of a column of a small table, as often as it is written there; NULL is no value.

    The values are aggregated to one row, so that the join has one row on that side whatever the table holds; a table too large for one row (2 GB) fails.
    """
    all_ = few.agg(F.array_sort(F.collect_list(column)).alias("__all"))
    return df.crossJoin(all_).select(*df.columns, F.explode("__all").alias(column))


def duplicated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that come more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def inconsistent(df: DataFrame, key: list[str], signature: Column) -> DataFrame:
    """Keys whose rows differ in signature; partial aggregates of two numbers stand for the set."""
    h = F.xxhash64(signature)
    return df.groupBy(*key).agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select(*key)


def done_ids(log: DataFrame, key: str, order: list[str], good: Column) -> DataFrame:
    """Keys whose latest entry is good: first the latest, then the filter."""
    return last_wins(log, [key], order).where(good).select(key)


def pending(tasks: DataFrame, log: DataFrame, key: str, order: list[str], good: Column) -> DataFrame:
    """Tasks not yet done according to the log."""
    return tasks.join(done_ids(log, key, order, good), key, "left_anti")


def next_in_cycle(df: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """id_col (distinct within a group) and the next id of its group in order, the last followed by the first.

    A group may hold any part of all rows: ids are cut into ranges, neighbours are found within a range, and the last of a range is followed by the first
    of the group's next range, out of a table of one row per group and range. NULL groups are groups; a NULL id comes first.
    """
    cut = cut_lineage(df.select(*by, id_col).repartitionByRange(*by, id_col).withColumn("__range", F.spark_partition_id()))
    firsts = cut.groupBy(*by, "__range").agg(F.min(F.struct(id_col)).alias("__first"))
    ring = Window.partitionBy(*by)
    after = F.coalesce(F.lead("__first").over(ring.orderBy("__range")), F.min("__first").over(ring))
    firsts = firsts.select(*[F.col(b).alias(f"__{i}") for i, b in enumerate(by)], F.col("__range").alias("__r"), after.alias("__after"))
    same = [F.col(b).eqNullSafe(F.col(f"__{i}")) for i, b in enumerate(by)]
    within = F.lead(F.struct(id_col)).over(Window.partitionBy(*by, "__range").orderBy(id_col))
    both = cut.withColumn("__next", within).join(firsts, [*same, F.col("__range") == F.col("__r")])
    return both.select(*by, id_col, F.coalesce("__next", "__after")[id_col].alias("next_id"))
