"""Training views of families and predictions: dialogues, preference pairs, balanced splits by search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def roles(trajectory: Column) -> Column:
    return F.array_join(F.transform(trajectory, lambda t: F.coalesce(T.role(t["role"]), F.lit("?"))), ">")


def is_three_turns(trajectory: Column) -> Column:
    return F.coalesce(roles(trajectory) == "assistant>user>assistant", F.lit(False))


def messages(query: Column, trajectory: Column) -> Column:
    """Prompt and turns as role and content."""
    turns = F.transform(trajectory, lambda t: F.struct(T.role(t["role"]).alias("role"), T.text(t["content"]).alias("content")))
    return F.concat(F.array(F.struct(F.lit("user").alias("role"), T.text(query).alias("content"))), turns)


def first_turn(all_messages: Column) -> Column:
    return F.slice(all_messages, 1, 2)


def preference_pairs(predictions: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, skipped): first turns that answered where the family asks to request something, each against the family's own first turn.

    families: one row per family. Skipped are responses that were not parsed, and pairs of equal contents.
    """
    want = families.select("family_id", "query", "state", T.text(F.get("trajectory", F.lit(0))["content"]).alias("chosen"), F.get("trajectory", F.lit(0))["action"].alias("want"))
    asked = predictions.where("phase = 'initial'").select("response_id", "family_id", "parsed").join(want, "family_id").where("chosen <> ''")
    answer = T.text(F.col("parsed.answer"))
    judged = asked.withColumn("skip", F.when(F.col("parsed").isNull(), "UNPARSEABLE").when(answer == F.col("chosen"), "IDENTICAL")).withColumn("category", F.when((F.col("parsed.action") == "ANSWER") & (F.col("want") != "ANSWER"), "UNDER_REQUEST"))
    pairs = judged.where("skip is null and category is not null").select("response_id", "family_id", "category", "query", "chosen", answer.alias("rejected"))
    return pairs, judged.where("skip is not null").select("response_id", "family_id", "skip")


def balanced_split(rows: DataFrame, group: str, stratum: Column, shares: dict[str, float], trials: int, seed: str) -> DataFrame:
    """(group, split) of the trial that comes closest to the shares in every stratum; each trial deals groups by hash, in one plan without a loop.

    Groups and strata meet in pre-aggregated counts; a trial's sums are one aggregation over groups x trials.
    """
    spark = rows.sparkSession
    bounds, total = [], 0.0
    for name, share in shares.items():
        bounds.append((name, total, total + share))
        total += share
    counts = rows.withColumn("stratum", stratum).groupBy(group, "stratum").agg(F.count(F.lit(1)).alias("n"))
    dealt = counts.crossJoin(F.broadcast(spark.range(trials).withColumnRenamed("id", "trial")))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("trial").cast("string"), F.col(group)), 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    split = F.lit(bounds[-1][0])
    for name, _, high in reversed(bounds[:-1]):
        split = F.when(u < high, name).otherwise(split)
    sums = dealt.withColumn("split", split).groupBy("trial", "stratum").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("split") == n, F.col("n")).otherwise(0)).alias(f"s{i}") for i, (n, _, _) in enumerate(bounds)])
    error = sum(F.pow((F.col(f"s{i}") - F.col("all") * (hi - lo)) / F.greatest(F.col("all") * (hi - lo), F.lit(1.0)), F.lit(2.0)) for i, (_, lo, hi) in enumerate(bounds))
    best = sums.groupBy("trial").agg(F.sum(error).alias("score")).select(F.min(F.struct(F.round("score", 9).alias("score"), "trial")).alias("b")).select(F.col("b.trial").alias("trial"))
    groups = rows.select(group).distinct().crossJoin(F.broadcast(best))
    return groups.withColumn("split", split).select(group, "split")


def mixed(h: np.ndarray, trial: int) -> np.ndarray:
    """Numbers from 0 to 1 out of 64-bit hashes and the number of a trial (the finaliser of splitmix64)."""
    z = h + np.uint64((trial + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def searched_split(rows: DataFrame, group: str, stratum: Column, shares: dict[str, float], trials: int, seed: str) -> DataFrame:
    """As balanced_split, for thousands of trials: a group is hashed once by SHA-256, each trial mixes the hash anew, and a task adds up its groups for all trials before the shuffle."""
    spark = rows.sparkSession
    names, bounds = list(shares), np.cumsum(list(shares.values()))[:-1]
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(group).cast("string")), 256), 1, 15), 16, 10).cast("long")
    counts = rows.withColumn("stratum", stratum).groupBy(group, "stratum").agg(F.count(F.lit(1)).alias("n")).select("stratum", h.alias("h"), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: dict[str | None, int] = {}
        total = np.zeros((trials, 0, len(names)))
        for b in batches:
            at = np.array([where.setdefault(s, len(where)) for s in b.column(0).to_pylist()], np.int64)
            hashes, n = b.column(1).to_numpy().astype(np.uint64), b.column(2).to_numpy()
            total = np.concatenate([total, np.zeros((trials, len(where) - total.shape[1], len(names)))], 1)
            for t in range(trials):
                to = np.searchsorted(bounds, mixed(hashes, t), "right")
                total[t] += np.bincount(at * len(names) + to, n, total[t].size).reshape(total[t].shape)
        for s, k in where.items():
            yield pa.RecordBatch.from_pydict({"trial": pa.array(np.arange(trials)), "stratum": pa.array([s] * trials, pa.string()), **{f"s{i}": total[:, k, i].astype(np.int64) for i in range(len(names))}})

    tasks = 2 * spark.sparkContext.defaultParallelism
    parts = counts.repartition(tasks, "h").mapInArrow(run, "trial long, stratum string, " + ", ".join(f"s{i} long" for i in range(len(names))))
    sums = parts.groupBy("trial", "stratum").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(names))])
    all_ = sum(F.col(f"s{i}") for i in range(len(names)))
    error = sum(F.pow((F.col(f"s{i}") - all_ * share) / F.greatest(all_ * share, F.lit(1.0)), F.lit(2.0)) for i, share in enumerate(shares.values()))
    best = sums.groupBy("trial").agg(F.sum(error).alias("score")).select(F.min(F.struct(F.round("score", 9).alias("score"), "trial")).alias("b")).select(F.col("b.trial").alias("trial"))
    groups = rows.select(group).distinct().select(group, h.alias("h")).crossJoin(F.broadcast(best))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                to = np.searchsorted(bounds, mixed(f["h"].to_numpy().astype(np.uint64), int(f["trial"].iloc[0])), "right")
                yield pd.DataFrame({group: f[group], "split": pd.Series([names[i] for i in to], index=f.index, dtype=object)})

    return groups.mapInPandas(deal, f"`{group}` {rows.schema[group].dataType.simpleString()}, split string")


def leaks(assigned: DataFrame, group: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return assigned.groupBy(group).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def adjacent_turns(families: DataFrame) -> DataFrame:
    """ord, turn and role of each turn with the role before it."""
    turns = families.select("ord", F.posexplode("trajectory").alias("k", "t"))
    return turns.select("ord", "k", T.role(F.col("t.role")).alias("role"), F.lag(T.role(F.col("t.role"))).over(Window.partitionBy("ord").orderBy("k")).alias("before"))
