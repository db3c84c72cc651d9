"""Mixing sources to target weights (problem 9).

Sizes are tokens of a public tokenizer. Equal texts are one candidate, of the source where it was first seen, so that
no text is used more often than allowed. The total is the largest at which every source can reach its share without
using a text more than max_repeats times (or a smaller total that is asked for).

A source then has a rate: copies per text on average. Its whole part is allocated for certain to every text; the rest by
Pareto order sampling with unequal probabilities: a text's inclusion odds grow with how often it occurs (a
logarithm of the number of its documents), texts are ranked by random odds divided by inclusion odds, and the first ranks up
to the target size are taken. Random odds come from a hash of text and seed: the same mix at every run and any partitioning.

The rank at which a source's target is reached is found without sorting it in one task: sizes are summed by bins of the rank (a table of
fixed size), then by bins of the bin where the target lies, until few ranks are left, at most six times.

NULL, empty and blank texts, and sources without target, take no part; a source whose texts are all empty reaches nothing and is reported
with zero, and bounds nothing. Targets are a row per source, read on the driver whole; what the plan says of a source is joined to its texts as a table. max_repeats NULL or below 1 counts as 1; shares are scaled to sum to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import TOKENIZER, count_tokens

BINS = 4096
CLASSES = 40


def candidates(docs: DataFrame, targets: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """text key, doc_id, source, tokens, class (of how many documents hold it) of each distinct text that takes part."""
    rows = docs.where(F.col("text").rlike(r"(?U)\S")).join(targets.select("source").where("source is not null").distinct(), "source", "left_semi")
    sized = count_tokens(rows.select("doc_id", "source", "text"), "doc_id", name=name)
    keyed = sized.select(F.sha2("text", 256).alias("key"), "doc_id", "source", "tokens")
    one = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("first"), F.count(F.lit(1)).alias("n"))
    return one.select("key", "first.doc_id", "first.source", "first.tokens", F.least(F.floor(F.log2("n")), F.lit(CLASSES)).cast("int").alias("class"))


def _water(groups: list[tuple[int, float]], wanted: float) -> dict[int, float]:
    """Inclusion probability per class, in proportion to 1 + class and at most 1, so that the expected size is wanted."""
    low, high = 0.0, 1.0
    size = lambda k: sum(min(1.0, k * (1 + c)) * t for c, t in groups)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if size(mid) < wanted else (low, mid)
    return {c: min(1.0, high * (1 + c)) for c, _ in groups}


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of key and seed, equal in all engines: 52 bits of SHA-256."""
    return (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def plan(pool: DataFrame, targets: list[dict], total: float | None = None) -> list[dict]:
    """Per source: target size, whole copies, and the inclusion probability of each class for one copy more."""
    sums: dict[str, list[tuple[int, float]]] = {}
    for r in pool.groupBy("source", "class").agg(F.sum("tokens").alias("tokens")).orderBy("source", "class").collect():  # at most sources x CLASSES
        sums.setdefault(r["source"], []).append((r["class"], float(r["tokens"])))
    scale = sum(t["target_share"] or 0 for t in targets) or 1
    out = []
    for t in targets:
        groups = sums.get(t["source"], [])
        out.append({"source": t["source"], "share": (t["target_share"] or 0) / scale, "most": max(1, t["max_repeats"] or 1), "size": sum(x for _, x in groups), "groups": groups})
    limits = [s["most"] * s["size"] / s["share"] for s in out if s["share"] > 0 and s["size"] > 0]
    largest = min(limits, default=0.0)
    total = largest if total is None else min(total, largest)
    for s in out:
        s["target"] = s["share"] * total
        rate = s["target"] / s["size"] if s["size"] else 0.0
        s["whole"] = min(s["most"], int(rate + 1e-12))
        rest = max(0.0, s["target"] - s["whole"] * s["size"]) if s["whole"] < s["most"] else 0.0
        s["rest"] = rest
        s["odds"] = _water(s["groups"], rest) if rest else {}
    return out


def ranked(pool: DataFrame, plans: list[dict], seed: int) -> DataFrame:
    """pool with whole (certain copies) and rank in [0, 1): random odds over inclusion odds, turned monotonously into [0, 1). The plan is a table, joined by source and class."""
    table = [(s["source"], c, s["whole"], s["odds"].get(c)) for s in plans for c, _ in s["groups"]]  # at most sources x CLASSES
    chances = pool.sparkSession.createDataFrame(table, "source string, class int, whole int, chance double")
    u = uniform(F.col("key"), seed)
    q = F.when(F.col("chance") >= 1, 0.0).when(F.col("chance") > 0, (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance"))))
    return pool.join(chances, ["source", "class"]).withColumn("q", q).withColumn("rank", F.col("q") / (1 + F.col("q")))


def thresholds(ranks: DataFrame, plans: list[dict], rounds: int = 6) -> dict[str, float]:
    """Per source the rank below which texts are taken."""
    open_ = {s["source"]: (0.0, 1.0, s["rest"]) for s in plans if s["rest"] > 0}
    done: dict[str, float] = {}
    for _ in range(rounds):
        if not open_:
            break
        ranges = ranks.sparkSession.createDataFrame([(source, a, b - a) for source, (a, b, _) in open_.items()], "source string, low double, width double")
        binned = ranks.join(ranges, "source").withColumn("bin", F.floor((F.col("rank") - F.col("low")) / F.col("width") * BINS)).where((F.col("bin") >= 0) & (F.col("bin") < BINS))
        table: dict[str, list[tuple[int, int, int]]] = {}
        for r in binned.groupBy("source", "bin").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect():  # at most sources x BINS
            table.setdefault(r["source"], []).append((r["bin"], r["tokens"], r["n"]))
        for source, (a, b, need) in list(open_.items()):
            step, at = (b - a) / BINS, 0.0
            for k, size, n in sorted(table.get(source, [])):
                if at + size >= need:
                    if n == 1 or step < 1e-15:
                        # the last text goes in if that brings the size nearer to the target
                        done[source] = a + (k + (1 if at + size - need <= need - at else 0)) * step
                        del open_[source]
                    else:
                        open_[source] = (a + k * step, a + (k + 1) * step, need - at)
                    break
                at += size
            else:
                done[source] = b
                del open_[source]
    return done | {source: a for source, (a, _, _) in open_.items()}


def mix(docs: DataFrame, targets: DataFrame, name: str = TOKENIZER, seed: int = 7, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, copies) of every text used, and the report per source."""
    spark = docs.sparkSession
    wanted = [r.asDict() for r in targets.where("source is not null").select("source", "target_share", "max_repeats").collect()]
    pool = cut_lineage(candidates(docs, targets, name))
    plans = plan(pool, wanted, total)
    ranks = cut_lineage(ranked(pool, plans, seed).select("doc_id", "source", "tokens", "whole", "chance", "rank"))
    limits = spark.createDataFrame(list(thresholds(ranks, plans).items()), "source string, limit double")
    taken = (F.col("rank") < F.coalesce("limit", F.lit(0.0))) & (F.col("chance") > 0)
    used = ranks.join(limits, "source", "left").withColumn("copies", F.col("whole") + F.coalesce(taken.cast("int"), F.lit(0))).where("copies > 0").select("doc_id", "source", "tokens", "copies")
    sums = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    asked = spark.createDataFrame([(s["source"], s["share"], float(s["target"])) for s in plans], "source string, target_share double, target_tokens double")
    all_ = sums.agg(F.sum("used_tokens").alias("all_tokens"))
    report = asked.join(sums, "source", "left").crossJoin(F.broadcast(all_)).select(
        "source", "target_share", "target_tokens", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("texts", F.lit(0)).alias("texts"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
    return used, report
