"""Splits that keep related records together (problem 4).

Components: families and their keys (source_sample_id, seed_entity, author within a dataset) form a bipartite graph; every
family points to the smallest family of each of its keys, a star per key however many families it has. Stars are
contracted by alternating large-star and small-star steps (Kiveris et al., 2014), each two aggregations that combine on the map side,
until nothing changes; every round is written to the shared folder, so that lost executors cost a round at most.

Assignment: components start in the split their hash falls in. Component swap search then moves whole components between
splits, or exchanges two, while that lowers the deviation of sizes and labels (dataset and state) from the shares; worse
steps are taken with falling probability (annealing). It runs in parallel on blocks of components with several chains each, and the
best state of all chains, the start included, is kept. Components larger than a block's fair size are assigned first, the largest
first, to the split that lacks most; their number is bounded by the inverse of that size.

NULL and blank keys tie nothing, nor does an author that names nobody; keys are compared without white space around them. A family
exported several times is one family (with all ties of its exports), and NULL family_id is left out. An empty table gives empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.messages import trimmed
from ..session import cut_lineage

#: Authors that name nobody, in lower case, without signs at the ends.
NOBODY = ("", "anonymous", "anon", "unknown", "none", "null", "n/a", "na", "nan", "nobody", "no author", "not available", "unnamed", "various", "staff", "admin", "system", "test", "tbd", "todo", "unbekannt", "inconnu", "desconocido", "?")
BLOCK = 4000
BIG = 1 / 200
CHAINS = 4
#: Proposals per component of a block and chain.
STEPS = 8


def names_nobody(author: Column) -> Column:
    return F.lower(F.regexp_replace(author, r"(?U)^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")).isin(*NOBODY)


def ties(families: DataFrame) -> DataFrame:
    """family_id, key: one row per family and thing it is tied by, of a distinct set."""
    author = F.when(~names_nobody(F.col("author")), F.concat(F.lit("a:"), F.coalesce("dataset", F.lit("")), F.lit(":"), trimmed("author")))
    keys = F.array_compact(F.array(F.concat(F.lit("s:"), trimmed("source_sample_id")), F.concat(F.lit("e:"), trimmed("seed_entity")), author))
    return families.where("family_id is not null").select("family_id", F.explode(keys).alias("key")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b longs): root is the smallest node of its component; nodes alone are left out."""
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:  # ends: every round brings nodes nearer to their roots, and an unchanged one is the last; their number grows with the logarithm of the size
        # large star: a node's larger neighbours point to the smallest of all its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(small, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's smaller neighbours, and itself, point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pointed = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = cut_lineage(pointed)
        # unchanged sums of both ends and counts mean unchanged edges, as edges only ever point to smaller nodes
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        state = now


def groups(families: DataFrame) -> DataFrame:
    """(family_id, group_id): every family in a group of two and more, with the smallest family_id of its group."""
    tied = ties(families)
    # numbers for names: written once, so that they stay the same
    nodes = cut_lineage(tied.select("family_id").distinct().withColumn("n", F.monotonically_increasing_id()))
    numbered = cut_lineage(tied.join(nodes, "family_id").select("key", "n"))
    star = numbered.groupBy("key").agg(F.min("n").alias("m"), F.count(F.lit(1)).alias("size")).where("size > 1")
    edges = numbered.join(star, "key").select(F.col("n").alias("a"), F.col("m").alias("b"))
    root = components(edges)
    named = nodes.join(root, nodes.n == root.node, "left").select("family_id", F.coalesce("root", "n").alias("root"))
    least = named.groupBy("root").agg(F.min("family_id").alias("group_id"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return named.join(least, "root").select("family_id", "group_id")


def _deviation(sizes: np.ndarray, target: np.ndarray) -> float:
    """Sum over splits and labels of the squared relative deviation; label 0 is the size."""
    return float((((sizes - target) / np.maximum(target, 1)) ** 2).sum())


def anneal(counts: np.ndarray, start: np.ndarray, target: np.ndarray, seed: int, steps: int | None = None) -> tuple[np.ndarray, float]:
    """The best assignment found of components (rows of counts: size, then labels) to splits (rows of target), and its deviation.

    steps: proposals, by default STEPS for each component; the heat falls by the same factor over all of them, however many there are.
    """
    steps = max(1000, STEPS * len(counts)) if steps is None else steps
    fall = 0.0025 ** (1 / steps)
    rng = np.random.default_rng(seed)
    now, n, k = start.copy(), len(counts), len(target)
    sums = np.zeros_like(target)
    np.add.at(sums, now, counts)
    cost = _deviation(sums, target)
    best, least = now.copy(), cost
    if n == 0 or k < 2:
        return best, least
    heat = max(cost, 1e-9) * 0.01
    at, to, other, luck = rng.integers(0, n, steps), rng.integers(1, k, steps), rng.integers(0, n, steps), rng.random(steps)
    for i in range(steps):
        x, y = at[i], other[i]
        if i % 2 and now[x] != now[y]:
            shift = counts[x] - counts[y]
            p, q = now[x], now[y]
        else:
            shift, p, q, y = counts[x], now[x], (now[x] + to[i]) % k, -1
        sums[p] -= shift
        sums[q] += shift
        new = _deviation(sums, target)
        if new <= cost or luck[i] < np.exp(-(new - cost) / (heat * fall**i + 1e-12)):
            cost, now[x] = new, q
            if y >= 0:
                now[y] = p
            if cost < least:
                best, least = now.copy(), cost
        else:
            sums[p] += shift
            sums[q] -= shift
    return best, least


def assign(families: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(family_id, split): whole groups in one split, near the shares of targets (split, share; a row per split, read on the driver whole).

    Labels are balanced block by block, all of them: a block counts the labels of its own components.
    """
    spark = families.sparkSession
    shares = sorted((r["split"], r["share"]) for r in targets.where("split is not null and share > 0").select("split", "share").collect())
    names, part = [s for s, _ in shares], np.array([x for _, x in shares], float)
    part = part / part.sum()
    one = families.where("family_id is not null").groupBy("family_id").agg(F.min(F.concat_ws("/", F.coalesce("dataset", F.lit("")), F.coalesce("initial_state.state", F.lit("")))).alias("label"))
    of = one.join(groups(families), "family_id", "left").withColumn("group_id", F.coalesce("group_id", "family_id"))
    of = cut_lineage(of)
    total = of.count()
    if not total:
        return spark.createDataFrame([], "family_id string, split string")
    each_label = of.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    comps = cut_lineage(each_label.groupBy("group_id").agg(F.sum("n").alias("size"), F.collect_list(F.struct("label", "n")).alias("labels")))
    big = comps.where(F.col("size") > BIG * total).select("group_id", "size").orderBy(F.desc("size"), "group_id").collect()  # at most 1 / BIG rows
    filled, placed = np.zeros(len(names)), []
    for r in big:
        k = int(np.argmax(part - (filled + r["size"]) / total)) if len(names) > 1 else 0
        filled[k] += r["size"]
        placed.append((r["group_id"], names[k]))
    wanted = np.maximum(part * total - filled, 0)
    wanted = wanted / wanted.sum() if wanted.sum() > 0 else part
    count = comps.where(F.col("size") <= BIG * total).count()
    blocks = max(1, round(count / BLOCK))
    small = comps.where(F.col("size") <= BIG * total).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "group_id"), F.lit(blocks)))
    each = small.select("*", F.explode(F.array(*[F.lit(c) for c in range(CHAINS)])).alias("chain"))
    schema = "block long, chain int, cost double, groups array<string>, splits array<int>"

    def search(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("group_id")
        known: dict[str, int] = {}
        cells = [(i, known.setdefault(x["label"], len(known)), x["n"]) for i, row in enumerate(f["labels"]) for x in row]
        counts = np.zeros((len(f), 1 + len(known)))
        counts[:, 0] = f["size"]
        for i, k, n in cells:
            counts[i, 1 + k] = n
        target = np.outer(wanted, counts.sum(0))
        hashed = np.array([int(h) for h in pd.util.hash_array(f["group_id"].to_numpy(object), hash_key="evloom-splits-01") >> np.uint64(11)]) / float(1 << 53)
        start = np.minimum(np.searchsorted(np.cumsum(wanted), hashed, "right"), len(names) - 1)
        best, cost = anneal(counts, start, target, seed * 1000 + int(key[1]))
        return pd.DataFrame({"block": [key[0]], "chain": [int(key[1])], "cost": [cost], "groups": [f["group_id"].tolist()], "splits": [best.tolist()]})

    tried = each.groupBy("block", "chain").applyInPandas(search, schema)
    best = tried.groupBy("block").agg(F.min_by(F.struct("groups", "splits"), F.struct("cost", "chain")).alias("b"))
    chosen = best.select(F.explode(F.arrays_zip("b.groups", "b.splits")).alias("x")).select(F.col("x.groups").alias("group_id"), F.element_at(F.array(*[F.lit(n) for n in names]), F.col("x.splits") + 1).alias("split"))
    if placed:
        chosen = chosen.unionByName(spark.createDataFrame(placed, "group_id string, split string"))
    return of.join(chosen, "group_id").select("family_id", "split")

