"""Cross-split overlaps, groups and assignment, token ids, mixing: against brute force and on edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evloom.llm import grouped, mixing, overlaps, tokens, words
from evloom.session import table

FAMILY = """ord long, family_id string, source_sample_id string, dataset string, split string, author string, seed_entity string, query string,
full_state struct<state string, evidence array<struct<document_id string, title string, text string>>>, initial_state struct<state string>, tid string, train int, kind int, text string, group_id string"""


def fam(i, split=None, source=None, query=None, texts=(), author=None, entity=None, dataset="d"):
    return (1, i, source, dataset, split, author, entity, query, ("FULL", [("x", None, t) for t in texts]) if texts is not None else None, None, "t", 1, 2, "x", "g")


def frame(spark, rows):
    return spark.createDataFrame(rows, FAMILY)


def test_overlaps_against_all_pairs(spark):
    """Candidates by pruned lists equal all pairs above the threshold, by plain cosine of the same weights."""
    families = table(spark, "/root/testdata/sf0.001", "families")
    member = overlaps.membership(families)
    texts = member.groupBy("kind", "tid").agg(F.first("text").alias("text"), F.max("train").alias("train"), F.max(~F.col("train")).alias("held")).cache()
    total, counts = overlaps.frequencies(texts)
    w = overlaps.weights(total, counts)
    import pyarrow as pa

    vectors = []
    for r in texts.collect():
        h, _ = words.words(pa.array([r.text]))
        v = {int(x): float(w[overlaps._bucket(h)[i] + r.kind * overlaps.BUCKETS]) for i, x in enumerate(h)}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((r.kind, bytes(r.tid), r.train, r.held, {k: x / n for k, x in v.items()}, r.text))
    share = lambda _: 0.0
    threshold = 0.5
    want = set()
    for a in vectors:
        for b in vectors:
            if a[0] == b[0] and a[1] != b[1] and a[2] and b[3]:
                dot = sum(x * b[4].get(k, 0.0) for k, x in a[4].items())
                if dot >= threshold + 1e-6:
                    want.add((a[1], b[1]))
    weight = spark.sparkContext.broadcast(w)
    post = overlaps.postings(texts, weight, threshold).cache()
    got = {(bytes(r.train_tid), bytes(r.held_tid)) for r in overlaps.candidates(post, threshold).select("train_tid", "held_tid").distinct().collect()}
    assert want <= got and share("x") == 0


def test_similar_texts_against_all_pairs(spark):
    """similar_texts itself, on the smallest tables: every pair of texts whose plain cosine reaches the threshold and that is a light edit."""
    families = table(spark, "/root/testdata/sf0.001", "families")
    texts = overlaps.membership(families).groupBy("kind", "tid").agg(F.first("text").alias("text"), F.max("train").alias("train"), F.max(~F.col("train")).alias("held")).cache()
    total, counts = overlaps.frequencies(texts)
    w = overlaps.weights(total, counts)
    import numpy as np
    import pyarrow as pa

    rows = []
    for r in texts.collect():
        h, _ = words.words(pa.array([r.text]), unified=True)
        h = np.unique(h)
        b = overlaps._bucket(h) + r.kind * overlaps.BUCKETS
        rows.append((r.kind, bytes(r.tid), r.train, r.held, r.text, dict(zip(h.tolist(), (w[b] / np.linalg.norm(w[b])).tolist()))))
    shares = counts / np.repeat(np.maximum(total, 1), overlaps.BUCKETS)

    def share(kind):
        return lambda word: max((float(shares[overlaps._bucket(np.array([x], np.uint64))[0] + kind * overlaps.BUCKETS]) for x in words.words(pa.array([word]), unified=True)[0]), default=1.0)

    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1] and a[2] and b[3] and sum(x * b[5].get(k, 0.0) for k, x in a[5].items()) >= overlaps.THRESHOLD + 1e-4 and overlaps.light_edit(a[4], b[4], share(a[0])):
                want.add((a[0], a[1], b[1]))
    got = {(r.kind, bytes(r.train_tid), bytes(r.held_tid)) for r in overlaps.similar_texts(texts).collect()}
    assert want and len(want & got) >= 0.99 * len(want)


def test_hot_text_is_reported_from_classes(spark):
    """A query that 100,000 train families share: ten held families give ten rows to the report's sums, not a million pairs."""
    hot = "What was the founder of Old Tavi Museum?"
    state = "named_struct('state', 'FULL', 'evidence', CAST(NULL AS array<struct<document_id string, title string, text string>>)) AS full_state"
    many = spark.range(100_010).selectExpr("id AS ord", "concat('f', id) AS family_id", "concat('s', id) AS source_sample_id", "'d' AS dataset", "CASE WHEN id < 10 THEN 'dev' ELSE 'train' END AS split", f"'{hot}' AS query", state)
    assert [tuple(r) for r in overlaps.overlap_report(many).select("split", "dataset", "reason", "families", "links").collect()] == [("dev", "d", "query", 10, 1_000_000)]


def test_close_has_no_length_limit():
    a = "x" * 500 + "abc" + "y" * 500
    assert overlaps._close(a, a.replace("abc", "acb"), 1) and not overlaps._close(a, a.replace("abc", "zzz"), 2) and overlaps._close("mill", "mil", 1) and not overlaps._close("mill", "mlil", 0) and overlaps._close("", "ab", 2)


def test_overlap_cases(spark):
    long = "Zoru Mavela is a listed planetarium in the district of Hepo Lunar, opened in 1874. The earliest ticket, numbered 812, is kept by Ruvo Telim. After the flood of 1901 the patron moved the archive to Selu Gand."
    moved = "ZORU MAVELA is a listed planetarium in the district of Hepo Lunar, opened in 1874. After the flood of 1901 the patron moved the archve to Selu Gand. The earliest ticket, numbered 812, is kept by Ruvo Telim. [2]"
    other = long.replace("1874", "1875")
    rows = [
        fam("t1", "train", "s1", "What was the founder of Old Tavi Museum?", [long]), fam("t1", "train", "s1", "What was the founder of Old Tavi Museum?", [long]), fam("d1", "dev", "s2", "please answer: what was the founder of old tavi museum", []),
        fam("d2", "test", "s3", "Who built Nara Hall?", [moved]), fam("d3", "test", "s1", "Where is it?", None), fam("d4", "dev", "s4", "What was the founder of Old Suri Museum?", [other]), fam("n1", None, "s1", "What was the founder of Old Tavi Museum?", [long]),
        fam("e1", "dev", None, None, []), fam("e2", "train", None, "", ["", "—"]), fam(None, "train", None, None, None),
    ]
    filler = [fam(f"f{i}", "train", f"x{i}", f"What was the {r} of {n} when {m} left the mill?", [f"{n} was built by {m} in {1700 + i} and it was sold to the council after a survey of the {r}."]) for i, (r, n, m) in enumerate((random.Random(i).choice(["founder", "composer", "director"]), f"Na{i}mo", f"Bo{i}ri") for i in range(60))]
    got = {tuple(r) for r in overlaps.found_pairs(frame(spark, rows + filler)).collect()}
    assert got == {("d1", "t1"), ("d2", "t1"), ("d3", "t1")}
    assert overlaps.found_pairs(frame(spark, rows).limit(0)).count() == 0


def test_groups_against_union_find(spark):
    r = random.Random(1)
    rows = [fam(f"f{r.randrange(300):03}", None, f"s{r.randrange(200)}" if r.random() < 0.8 else None, author=r.choice([None, "", " Anonymous", "-", f"a{r.randrange(80)}"]), entity=f"e{r.randrange(300)}" if r.random() < 0.5 else None, dataset=r.choice("xy")) for _ in range(400)]
    rows += [fam(f"c{i:02}", None, f"chain{i}", entity=f"chain{i // 2}") for i in range(30)] + [fam(f"c{i:02}", None, f"chain{i - 1}") for i in range(1, 30)] + [fam("alone", None, "only", author="unknown"), fam(None, None, "s1"), fam("blank", None, " ", entity="")]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for row in rows:
        i, s, d, a, e = row[1], row[2], row[3], row[5], row[6]
        if i is None:
            continue
        find(i)
        for k in ([("s", s)] if s and s.strip() else []) + ([("e", e)] if e else []) + ([("a", d, a)] if a and a.startswith("a") else []):
            parent[find(i)] = find(k)
    members = defaultdict(set)
    for row in rows:
        if row[1] is not None:
            members[find(row[1])].add(row[1])
    want = {(x, min(m)) for m in members.values() if len(m) > 1 for x in m}
    assert {tuple(x) for x in grouped.groups(frame(spark, rows)).collect()} == want
    assert grouped.groups(frame(spark, rows).limit(0)).count() == 0


def test_assignment(spark):
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1), (None, 0.5), ("off", 0.0)], "split string, share double")
    rows = [fam(f"f{i:04}", None, f"s{i // 2}") for i in range(600)] + [fam(f"g{i:03}", None, "giant") for i in range(200)] + [fam(None, None, "s1"), fam("f0000", None, "s0")]
    got = grouped.assign(frame(spark, rows), targets).collect()
    assert len(got) == 800 and len({r.family_id for r in got}) == 800
    where = {r.family_id: r.split for r in got}
    assert all(where[f"f{i:04}"] == where[f"f{i + 1:04}"] for i in range(0, 600, 2)) and len({where[f"g{i:03}"] for i in range(200)}) == 1
    n = Counter(where.values())
    assert abs(n["train"] - 640) < 12 and abs(n["dev"] - 80) < 8 and abs(n["test"] - 80) < 8
    assert {r.family_id: r.split for r in grouped.assign(frame(spark, rows), targets).collect()} == where
    assert grouped.assign(frame(spark, []), targets).count() == 0


def test_anneal_beats_start():
    import numpy as np

    rng = np.random.default_rng(2)
    counts = np.stack([rng.integers(1, 9, 300), rng.integers(0, 5, 300)], 1).astype(float)
    target = np.outer([0.8, 0.1, 0.1], counts.sum(0))
    start = rng.integers(0, 3, 300)
    best, cost = grouped.anneal(counts, start, target, 1)
    assert cost < 0.01 and best.shape == start.shape
    assert grouped.anneal(counts[:0], start[:0], target, 1)[0].shape == (0,)


def test_ids_equal_and_round_trip(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = ["", None, "   ", "<|endoftext|> x", "é​\U0001f642 " * 30, "a" * 9000, " " * 5000, "don't  stop\n\n\tnow " * 200, "\U0001f642" * 400 + "x y z " * 300]
    texts += ["".join(r.choice("ab é\U0001f642.'1 \n。字") for _ in range(r.randrange(3000))) for _ in range(60)]
    df = spark.createDataFrame([(i // 2, t, "row", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, k int")
    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    want = sorted((i // 2, plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts))
    assert all(len(t or "") < 1 << 16 for t in texts)
    for chunk, overlap in ((1 << 16, 1 << 11), (300, 60), (50, 8)):
        got = sorted((x.doc_id, x.ids) for x in tokens.encode(df, chunk=chunk, overlap=overlap).collect())
        assert got == want
    for t in texts:
        if t:
            assert tokens.decode(plain.encode(t, add_special_tokens=False).ids) == t
    assert tokens.encode(df.limit(0)).count() == 0


def test_long_texts_of_any_script_are_cut(spark):
    """Chinese, Russian and Thai without blanks between sign and Latin letter come in many pieces; a run of one letter stays whole; ids are those of the whole text."""
    texts = ["档案中保存着信件和地图。" * 300, "Архив хранится в музее;в нём письма." * 100, "กขค" * 900, "a" * 4000 + " b" * 500, "🙂—„“" * 700 + "é", "x\n\n  \t y" * 400]
    enc = tokens.encoding(tokens.TOKENIZER)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode(df, chunk=500, overlap=40).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    for t in texts[:2]:
        head, tail = tokens.boundaries(t[500:1040], False, False, 500, 40)
        assert {x - 500 for x in tail} & set(tokens.boundaries(t[1000:1540], False, False, 500, 40)[0])


DOC = "doc_id long, text string, source string, tokens string, key int"


def test_mix(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["river", "stone", "mill", "archive"]) for _ in range(r.randrange(4, 60))) + f" {i}", r.choice("aaaaaabc"), "t", 1) for i in range(3000)]
    rows += [(9000 + i, "the same text again and again", "b", "t", 1) for i in range(40)] + [(9100, "the same text again and again", "a", "t", 1), (9101, None, "a", None, None), (9102, " ", "b", None, None), (9103, "of no target", "z", None, None), (9104, "x", None, None, None)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), (None, 0.1, 1), ("empty", 0.0, None)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(spark.createDataFrame(rows, DOC), targets)
    rep = {x.source: x for x in report.collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(rep[s].actual_share - share) < 0.002
    assert rep["a"].most_copies <= 1 and rep["b"].most_copies <= 3 and rep["c"].most_copies <= 2 and rep["empty"].used_tokens == 0
    got = {x.doc_id: x.copies for x in used.collect()}
    assert sum(i in got for i in (*range(9000, 9040), 9100)) <= 1 and not {9101, 9102, 9103, 9104} & set(got)
    assert {x.doc_id: x.copies for x in mixing.mix(spark.createDataFrame(rows, DOC).repartition(7), targets)[0].collect()} == got
    assert mixing.mix(spark.createDataFrame([], DOC), targets)[0].count() == 0


def test_water_reaches_size():
    groups = [(0, 100.0), (1, 50.0), (5, 10.0)]
    p = mixing._water(groups, 80.0)
    assert abs(sum(p[c] * t for c, t in groups) - 80) < 1e-6 and p[5] == min(1, p[0] * 6)


@pytest.mark.parametrize(("a", "b", "same"), [
    ("The mill was sold in 1874 to Zoru.", "The mill was sold in 1874 to Zoru", True), ("The mill was sold in 1874 to Zoru.", "The mill was sold in 1875 to Zoru.", False), ("The mill was sold to Zoru.", "The mlil was sold to Zoru.", True),
    ("The mill was sold to Zorumav.", "The mill was sold to Beltane.", False), ("Question: The mill.", "the mill (see notes)", True), ("It opened in June of that year there.", "It opened in July of that year there.", False),
])
def test_light_edit(a, b, same):
    common = {"the", "mill", "was", "sold", "in", "to", "it", "opened", "of", "that", "year", "there", "june", "july"}
    assert overlaps.light_edit(a, b, lambda w: 0.5 if w in common else 0.0001) is same
    assert re.match("", a)


def test_light_edit_of_every_sentence():
    """A slip in each of five sentences leaves no sentence identical, and is still a light edit."""
    common = set("the mill was sold in to archive moved from ticket kept by council after flood opened near river station".split())
    a = "The mill was sold to the council. The archive was moved from the station. The ticket was kept by the council. The station opened near the river. The mill opened after the flood."
    b = "The mlil was sold to the council. The archve was moved from the station. The tickt was kept by the council. The staton opened near the river. The mill opend after the flood."
    share = lambda w: 0.5 if w in common else 0.0001
    assert overlaps.light_edit(a, b, share)
    assert not overlaps.light_edit(a.replace("river", "Belkatuno"), b.replace("river", "Zorumavi"), share)
    assert not overlaps.light_edit(a, " ".join(f"Nothing of number {i} is told here." for i in range(30)), share)


def test_long_sentences_align_whole():
    """Words of a very long sentence that come often are no junk."""
    r = random.Random(3)
    s = [r.choice(["mill", "river", "stone", "archive"]) + r.choice(["", "s"]) for _ in range(1100)]
    assert overlaps.light_edit(" ".join(s), " ".join([*s[:500], "stnoe", *s[501:]]) + " x", lambda w: 0.5 if w != "x" else 0.0001)


def test_all_labels_are_balanced(spark):
    """Seventy labels of ten components each: the rarest are spread as well as the first."""
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split string, share double")
    rows = [fam(f"f{i:04}", None, f"s{i}", dataset=f"d{i % 70:02}") for i in range(700)]
    got = {r.family_id: r.split for r in grouped.assign(frame(spark, rows), targets).collect()}
    n = Counter((i % 70, got[f"f{i:04}"]) for i in range(700))
    assert len(got) == 700 and sum(3 <= n[k, "train"] <= 7 for k in range(70)) >= 66
