"""Records shared between splits, exactly or almost (problem 3), by a weighted cosine join.

Terms are words; a term's weight is its inverse document frequency within the kind of text (query, evidence), counted
over all distinct texts in 2^20 hash buckets, so that the weights broadcast have a fixed size. Vectors have length one.

Candidates: the terms of a text are ordered by falling weight (a global order). A text posts only the terms before the
residual norm of the rest falls below the threshold: a pair above the threshold shares its first common term within both
prefixes. Each list carries the largest weight and residual norm of either side: a posting stays only if with those of the other side its bound
w_a max w + residual_a max residual reaches the threshold, so lists of one side, and postings no partner can lift, are dropped before any pair is formed.
A pair on a list survives if w_a w_b + residual_a residual_b reaches the threshold. Survivors, usually few,
get exact dot products, and an alignment of their sentences that tells a light edit (case, spacing, punctuation,
slips, synonyms, notes, sentences moved or dropped) from a text about other names, numbers, dates or relations.

Copies: equal texts (the same words in order) are one text with a membership of families; they meet by an equi join.
Lists run over distinct texts only. Pairs within a list are between splits, never within one; hot lists are frequent terms,
of low weight, and so seldom part of a prefix; AQE splits those that are.

NULL and empty texts, and texts without any word, are in no pair; families without split are in none; a family that is
exported several times counts once; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.select import first_wins
from ..session import cut_lineage
from .codepoints import pieces
from .unify import unify_array
from .words import mixed, text_keys, words

BUCKETS = 1 << 20
THRESHOLD = 0.66
KINDS = ("query", "evidence")
#: Notes and prefixes that carry nothing of a text.
NOTES = r"\[[^\]]{0,30}\]|\((?:see|citation|sic|note)[^)]{0,30}\)|^\W*(?:question|q|please answer|prompt|answer)\s*:"

_NOTES = re.compile(NOTES, re.IGNORECASE)
#: Names of months.
MONTHS = frozenset("january february march april may june july august september october november december".split())


def sides(families: DataFrame) -> DataFrame:
    """Families with their side: train or held (dev, test); others are in no pair."""
    return families.where(F.col("split").isin("train", "dev", "test")).withColumn("train", F.col("split") == "train")


def membership(families: DataFrame) -> DataFrame:
    """family_id, train, kind, tid, text of each query and full_state evidence text with a word in it."""
    texts = F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), F.col("query").alias("text"))),
        F.coalesce(F.transform("full_state.evidence", lambda e: F.struct(F.lit(1).alias("kind"), e["text"].alias("text"))), F.array().cast("array<struct<kind:int,text:string>>")),
    )
    rows = sides(families).select("family_id", "train", F.explode(texts).alias("t")).select("family_id", "train", "t.kind", "t.text").where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 3):
            text, _ = unify_array(b.column(3))
            text = pa.array([_NOTES.sub(" ", t) for t in text.to_pylist()], pa.string())
            hashes, offsets = words(text, unified=True)
            full = pa.array(np.diff(offsets) > 0)
            out = pa.RecordBatch.from_arrays([*b.columns[:3], text_keys(hashes, offsets), text], names=["family_id", "train", "kind", "tid", "text"])
            yield out.filter(full)

    return rows.mapInArrow(run, "family_id string, train boolean, kind int, tid binary, text string")


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(44)).astype(np.int64)


def _distinct_terms(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) pairs without repetition."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, row))
    row, term = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    return row[new], term[new]


def frequencies(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(texts per kind, texts per kind and bucket of terms), counted over all distinct texts; the size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * BUCKETS, np.int64)
        total = np.zeros(2, np.int64)
        for b in pieces(batches, 1):
            kind = np.asarray(b.column(0))
            hashes, offsets = words(b.column(1), unified=True)
            row, term = _distinct_terms(hashes, offsets)
            counts += np.bincount(_bucket(term) + kind[row].astype(np.int64) * BUCKETS, minlength=2 * BUCKETS)
            total += np.bincount(kind, minlength=2)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([counts[at], total]))], names=["bucket", "n"])

    got = texts.select("kind", "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = np.asarray(got.column("bucket")), np.asarray(got.column("n"))
    counts = np.zeros(2 * BUCKETS, np.int64)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    total = np.array([n[bucket == -1 - k].sum() for k in (0, 1)])
    return total, counts


def weights(total: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.log1p(np.repeat(np.maximum(total, 1), BUCKETS) / np.maximum(counts, 1)).astype(np.float32)


def postings(texts: DataFrame, weight, threshold: float) -> DataFrame:
    """kind, term, tid, w, rest, train, held: the prefix of each text's vector, heaviest terms first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weight.value
        for b in pieces(batches, 2):
            kind = np.asarray(b.column(0)).astype(np.int64)
            hashes, offsets = words(b.column(2), unified=True)
            row, term = _distinct_terms(hashes, offsets)
            w = table[_bucket(term) + kind[row] * BUCKETS].astype(np.float64)
            order = np.lexsort((term, -w, row))
            row, term, w = row[order], term[order], w[order]
            square = np.cumsum(w * w)
            ends = np.searchsorted(row, np.arange(len(offsets) - 1), "right")
            starts = np.searchsorted(row, np.arange(len(offsets) - 1), "left")
            base = np.concatenate([[0.0], square])
            norm2 = (base[ends] - base[starts])[row]
            before = np.maximum(base[ends][row] - base[:-1], 0) / norm2  # squared norm from this term on
            rest = np.sqrt(np.maximum(base[ends][row] - square, 0) / norm2)
            sel = before >= threshold * threshold - 1e-9
            at = pa.array(row[sel])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(term[sel].view(np.int64)), b.column(1).take(at), pa.array((w / np.sqrt(norm2))[sel].astype(np.float32)), pa.array(rest[sel].astype(np.float32)), b.column(3).take(at), b.column(4).take(at)],
                names=["kind", "term", "tid", "w", "rest", "train", "held"],
            )

    return texts.select("kind", "tid", "text", "train", "held").mapInArrow(run, "kind int, term long, tid binary, w float, rest float, train boolean, held boolean")


def _plain(text: str) -> str:
    return _NOTES.sub(" ", text.lower())


def _tokens(text: str) -> list[str]:
    return re.findall(r"\w+", re.sub(r"(?<=\d),(?=\d)", "", text))


def _close(a: str, b: str, limit: int) -> bool:
    """Edit distance with transpositions of at most limit; only the diagonals that can stay within it are filled, so that length does not matter."""
    if a == b or abs(len(a) - len(b)) > limit:
        return a == b
    far = limit + 1
    older: dict[int, int] = {}
    old = {j: j for j in range(min(limit, len(b)) + 1)}
    for i in range(1, len(a) + 1):
        new: dict[int, int] = {0: i} if i <= limit else {}
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            d = min(old.get(j, far) + 1, new.get(j - 1, far) + 1, old.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, older.get(j - 2, far) + 1)
            new[j] = d
        if min(new.values()) > limit:
            return False
        older, old = old, new
    return old.get(len(b), far) <= limit


def _same_statement(x: list[str], y: list[str], share, loose: bool) -> bool:
    """Whether two aligned sentences differ by slips, synonyms and little words only."""
    changed = swapped = 0
    for tag, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        a, b = x[i:j], y[k:m]
        if any(c.isdigit() for w in (*a, *b) for c in w):
            return False
        if tag != "replace":
            # a word too many or too few: little words may go, names may not
            if any(share(w) < 0.004 and len(w) > 3 for w in (*a, *b)) or len(a) + len(b) > 4:
                return False
            continue
        if "".join(a) == "".join(b):
            continue
        if len(a) != len(b):
            # words next to an inserted or dropped one: each of the fewer takes its closest, else one that may stand for it
            a, b = (a, b) if len(a) < len(b) else (b, a)
            left = list(b)
            for w in sorted(a, key=lambda w: not any(_close(w, v, 2) for v in b)):
                near = [v for v in left if _close(w, v, 2)] or sorted((v for v in left if not (share(v) >= 0.02 and share(w) >= 0.02) and max(share(v), share(w)) >= 0.004), key=lambda v: abs(len(v) - len(w)))
                if not near:
                    return False
                changed += near[0] != w
                left.remove(near[0])
            if any(share(w) < 0.004 and len(w) > 3 for w in left):
                return False
            continue
        for v, w in zip(a, b):
            changed += 1
            if v in MONTHS and w in MONTHS:
                return False
            if share(v) >= 0.02 and share(w) >= 0.02 and max(len(v), len(w)) > 5:
                # both belong to the corpus' own vocabulary: another relation, month or thing, unless it is one word of a long statement
                swapped += 1
                if swapped > 1 or len(x) < 20 and not loose:
                    return False
                continue
            if _close(v, w, 2 if min(len(v), len(w)) > 5 else 1):
                continue
            if max(share(v), share(w)) < 0.004:
                return False  # another name
    return changed <= max(2, len(x) // 4)


def light_edit(a: str, b: str, share) -> bool:
    """Whether one text is a light edit of the other; share: the part of all texts that hold a word."""
    a, b = _plain(a), _plain(b)
    if Counter(_tokens(a)) == Counter(_tokens(b)):
        return True
    cut = lambda t: [s for s in map(_tokens, re.split(r"(?<=[.!?。！？])[\"'”’)]*\s*(?=\S)", t)) if s]
    x, y = cut(a), cut(b)
    both = Counter(map(tuple, x)) & Counter(map(tuple, y))
    left = list((Counter(map(tuple, x)) - both).elements())
    right = list((Counter(map(tuple, y)) - both).elements())
    alone = 0
    kept = sum(both.values())
    # too many sentences stay alone even if all that are left find a counterpart
    lost = lambda: 2 * alone + len_right - len(left) > max(2, kept + len(left) - alone)
    len_right = len(right)
    if lost():
        return False
    for s in left:
        best, k = 0.0, -1
        for j, r in enumerate(right):
            m = SequenceMatcher(None, s, r, autojunk=False)
            if m.real_quick_ratio() > best and m.quick_ratio() > max(best, 0.5):
                best, k = max((best, k), (m.ratio(), j))
        if best < 0.55:
            alone += 1
            if lost():
                return False
            continue
        if not _same_statement(list(s), list(right[k]), share, len(x) > 2):
            return False
        right.pop(k)
    kept += len(left) - alone
    return kept >= 1 and alone + len(right) <= max(2, kept)


def candidates(post: DataFrame, threshold: float) -> DataFrame:
    """(kind, train_tid, held_tid, ...) of pairs of postings on the same list whose bound reaches the threshold."""
    least = threshold - 1e-4
    top = lambda side, c: F.max(F.when(F.col(side), F.col(c))).alias(f"{side}_{c}")
    lists = post.groupBy("kind", "term").agg(top("train", "w"), top("train", "rest"), top("held", "w"), top("held", "rest")).where("train_w is not null and held_w is not null")
    kept = post.join(lists, ["kind", "term"])
    reach = lambda other: F.col("w") * F.col(f"{other}_w") + F.col("rest") * F.col(f"{other}_rest") >= least
    a = kept.where(F.col("train") & reach("held")).select("kind", "term", F.col("tid").alias("train_tid"), F.col("w").alias("wa"), F.col("rest").alias("ra"))
    b = kept.where(F.col("held") & reach("train")).select("kind", "term", F.col("tid").alias("held_tid"), F.col("w").alias("wb"), F.col("rest").alias("rb"))
    return a.join(b, ["kind", "term"]).where((F.col("train_tid") != F.col("held_tid")) & (F.col("wa") * F.col("wb") + F.col("ra") * F.col("rb") >= least))


def similar_texts(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, train_tid, held_tid, cosine) of pairs of different texts between the sides that are light edits."""
    spark = texts.sparkSession
    total, counts = frequencies(texts)
    weight = spark.sparkContext.broadcast(weights(total, counts))
    shares = spark.sparkContext.broadcast((counts / np.repeat(np.maximum(total, 1), BUCKETS)).astype(np.float32))
    post = cut_lineage(postings(texts, weight, threshold))
    found = candidates(post, threshold)
    found = found.select("kind", "train_tid", "held_tid").distinct()
    t = texts.select("kind", "tid", "text")
    found = found.join(t.withColumnsRenamed({"tid": "train_tid", "text": "train_text"}), ["kind", "train_tid"])
    found = found.join(t.withColumnsRenamed({"tid": "held_tid", "text": "held_text"}), ["kind", "held_tid"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, s = weight.value, shares.value

        def known(kind: int):
            cache: dict[str, float] = {}

            def share(word: str) -> float:
                if word not in cache:
                    hashes, _ = words(pa.array([word]), unified=True)
                    cache[word] = float(s[_bucket(hashes) + kind * BUCKETS].max()) if len(hashes) else 1.0
                return cache[word]

            return share

        share = {k: known(k) for k in (0, 1)}
        for f in frames:
            cosine = np.zeros(len(f))
            (ha, oa), (hb, ob) = words(pa.array(f.train_text, pa.string()), unified=True), words(pa.array(f.held_text, pa.string()), unified=True)
            for i, kind in enumerate(f.kind):
                x, y = np.unique(ha[oa[i] : oa[i + 1]]), np.unique(hb[ob[i] : ob[i + 1]])
                of = lambda h: float((w[_bucket(h) + kind * BUCKETS].astype(np.float64) ** 2).sum())  # noqa: B023, E731
                cosine[i] = of(np.intersect1d(x, y, assume_unique=True)) / np.sqrt(of(x) * of(y))
            ok = np.array([c >= threshold and light_edit(a, b, share[k]) for c, a, b, k in zip(cosine, f.train_text, f.held_text, f.kind)], bool)
            out = f.loc[ok, ["kind", "train_tid", "held_tid"]]
            yield out.assign(cosine=cosine[ok])

    return found.mapInPandas(run, "kind int, train_tid binary, held_tid binary, cosine double")


def linked_texts(families: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links): family_id, train, kind, tid of every family's texts; kind, train_tid, held_tid of text classes that are the same or light edits between the sides."""
    member = cut_lineage(membership(families))
    texts = member.groupBy("kind", "tid").agg(F.first("text").alias("text"), F.max("train").alias("train"), F.max(~F.col("train")).alias("held"))
    texts = cut_lineage(texts)
    near = similar_texts(texts, threshold).select("kind", "train_tid", "held_tid")
    same = texts.where("train and held").select("kind", F.col("tid").alias("train_tid"), F.col("tid").alias("held_tid"))
    return member.select("family_id", "train", "kind", "tid").distinct(), near.unionByName(same)


def _reason(kind: str = "kind") -> Column:
    return F.when(F.col(kind) == 0, "query").otherwise("evidence")


def sources(families: DataFrame) -> DataFrame:
    return sides(families).where("source_sample_id is not null").select("family_id", "train", "source_sample_id").distinct()


def overlapping_families(families: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(train_family, held_family, reason) of all pairs between train and dev or test; reason: source, query, evidence."""
    m, links = linked_texts(families, threshold)
    left = m.where("train").select("kind", F.col("tid").alias("train_tid"), F.col("family_id").alias("train_family"))
    right = m.where("not train").select("kind", F.col("tid").alias("held_tid"), F.col("family_id").alias("held_family"))
    by_text = links.join(left, ["kind", "train_tid"]).join(right, ["kind", "held_tid"]).select("train_family", "held_family", _reason().alias("reason"))
    s = sources(families)
    by_source = s.where("train").select("source_sample_id", F.col("family_id").alias("train_family")).join(s.where("not train").select("source_sample_id", F.col("family_id").alias("held_family")), "source_sample_id")
    return by_text.unionByName(by_source.select("train_family", "held_family", F.lit("source").alias("reason"))).where("train_family <> held_family").distinct()


def overlap_report(families: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """split, dataset, reason, families (held-out ones with an overlap), links (of a held family by one of its texts, or by its source, to a train family).

    Counted from classes: how many train families hold a text or source is summed up first and then met once per held family, so that a text that
    100,000 train families share is one row. Split and dataset of a family are those of its first export.
    """
    m, links = linked_texts(families, threshold)
    held = lambda n: F.count(F.lit(1)).alias(n)
    in_train = m.where("train").groupBy("kind", F.col("tid").alias("train_tid")).agg(held("n"))
    partners = links.join(in_train, ["kind", "train_tid"]).groupBy("kind", F.col("held_tid").alias("tid")).agg(F.sum("n").alias("n"))
    by_text = m.where("not train").join(partners, ["kind", "tid"]).select("family_id", _reason().alias("reason"), "n")
    s = sources(families)
    by_source = s.where("not train").join(s.where("train").groupBy("source_sample_id").agg(held("n")), "source_sample_id").select("family_id", F.lit("source").alias("reason"), "n")
    of = first_wins(sides(families).where("not train").select("family_id", "ord", "split", "dataset"), ["family_id"], ["ord"])
    each = by_text.unionByName(by_source).groupBy("family_id", "reason").agg(F.sum("n").alias("n"))
    return each.join(of, "family_id").groupBy("split", "dataset", "reason").agg(F.count(F.lit(1)).alias("families"), F.sum("n").alias("links"))


def found_pairs(families: DataFrame) -> DataFrame:
    """Distinct pairs (family_a, family_b), the smaller id first."""
    return overlapping_families(families).select(F.least("train_family", "held_family").alias("family_a"), F.greatest("train_family", "held_family").alias("family_b")).distinct()
