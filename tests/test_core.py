"""Core operators on small fixtures: facts, edge cases, brute force."""

import collections
import hashlib
import itertools
import json
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evloom.functions import text as T
from evloom.operators import corpora, messages, nested, rules, score, select, stats, views
from evloom.operators import evidence as E
from evloom.plans import catalogue, record_queries
from evloom.sources import files
from evloom.streaming import log


def one(spark, column, **values):
    kinds = {str: "string", list: "array<string>", int: "int", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


# deliveries ---------------------------------------------------------------------------------------------------------

DELIVERY = "delivery_id long, sample_id string, request_hash string, created_at string, delivered_at timestamp, kept string, deliveries int, __id int"


def deliveries(spark):
    at = lambda m: datetime(2026, 1, 1, 0, m)
    rows = [
        (1, "a", "AB", "2026-01-05T00:03:00.625+00:00", at(5)), (2, " a\t", "ab", "2026-01-04T19:03:00.625000-05:00", at(3)), (3, "a", "ab", "2026-01-05 00:03:00.625+00:00", at(3)), (4, "a", "ab", "2026-01-05T00:03:00.626Z", at(1)),
        (5, "a", None, "2026-01-05T00:03:00.625Z", at(1)), (6, "a", "ab", None, at(1)), (7, "a", "ab", "yesterday", at(1)), (8, "a", "ab", "yesterday", at(1)), (9, None, "ab", "2026-01-05T00:03:00.625Z", None), (10, "a", " ", "2026-01-05T00:03:00.625Z", at(1)),
        (11, "b", "ab", "2026-01-05T00:03:00.625Z", None), (12, "b", "ab", "2026-01-05T00:03:00.625Z", at(1)),
    ]
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], DELIVERY)


def test_repeated_deliveries(spark):
    df = deliveries(spark)
    keys = messages.call_message_keys()
    assert {r.delivery_id for r in messages.repeated_deliveries(df, keys, ["delivered_at"], "delivery_id").collect()} == {1, 3, 12}
    kept = messages.exactly_once(df, keys, ["delivered_at"], "delivery_id")
    assert sorted(r.delivery_id for r in kept.collect()) == [2, 4, 5, 6, 7, 8, 9, 10, 11] and set(kept.columns) == set(df.columns)
    assert messages.repeated_deliveries(df.limit(0), keys, ["delivered_at"], "delivery_id").count() == 0


def test_hot_message(spark):
    df = spark.range(20000).select(F.col("id").alias("delivery_id"), F.lit("s").alias("sample_id"), F.lit("h").alias("request_hash"), F.lit("2026-01-05T00:03:00Z").alias("created_at"), (F.lit(1_700_000_000) - F.col("id")).cast("timestamp").alias("delivered_at"))
    got = messages.repeated_deliveries(df, messages.call_message_keys(), ["delivered_at"], "delivery_id")
    assert got.count() == 19999 and got.where("delivery_id = 19999").count() == 0


# nested records -----------------------------------------------------------------------------------------------------


def plain_nodes(record):
    """The rows of the six entities by plain recursion."""
    out = []
    lists = lambda x: x if isinstance(x, list) else [x] if isinstance(x, dict) else []
    get = lambda x, *path: get(x.get(path[0]), *path[1:]) if path and isinstance(x, dict) else (None if path else x)
    for i, a in enumerate(lists(get(record, "constructor", "editor", "attempts")), 1):
        if isinstance(a, dict):
            out.append(("attempt", str(i)))
            for j, e in enumerate(lists(a.get("errors")), 1):
                if isinstance(e, dict):
                    out.append(("error", f"{i}.{j}"))
                    out += [("span", f"{i}.{j}.{k}") for k, s in enumerate(lists(e.get("spans")), 1) if isinstance(s, dict)]
    state = get(record, "initial_state")
    if isinstance(state, str):
        try:
            state = json.loads(state)
        except ValueError:
            state = None
    for name in ("evidence", "minimal_edit"):
        out += [(name, str(i)) for i, x in enumerate(lists(get(state, name)), 1) if isinstance(x, dict)]
    body = get(record, "constructor", "request_body")
    if isinstance(body, dict):
        out.append(("request_body", "1"))
        if isinstance(body.get("response_format"), dict):
            out.append(("response_format", "1"))
    return out


def test_nodes_against_recursion(spark):
    r = random.Random(7)
    span = lambda: r.choice([None, {"start": r.randrange(3), "end": 4}, 5])
    many = lambda f: r.choice([None, [], f(), [f() for _ in range(r.randrange(4))], [None, f()]])
    error = lambda: r.choice([None, {"code": "A", "spans": many(span)}, {"code": "B"}])
    attempt = lambda: r.choice([None, {"attempt": 1, "errors": many(error)}, {"attempt": 2}])
    state = lambda: {"state": "M", "evidence": many(lambda: {"document_id": "d"}), "minimal_edit": many(lambda: {"document_id": "d"})}
    records = []
    for _ in range(300):
        s = state()
        records.append({"constructor": r.choice([None, {"editor": r.choice([None, {"attempts": many(attempt)}]), "request_body": r.choice([None, {"stop": ["x"]}, {"response_format": {"type": "t"}}, 3])}]), "initial_state": r.choice([s, json.dumps(s), "{broken", None])})
    payloads = [json.dumps(x) for x in records] + [None, "", " ", "not json", "[1]", "3", '{"a":' * 3000 + "1" + "}" * 3000, json.dumps({"initial_state": {"evidence": [{"text": "x" * 300_000}]}})]
    records += [None] * 7 + [{"initial_state": {"evidence": [{}]}}]
    df = spark.createDataFrame([(i, p, "e", 1) for i, p in enumerate(payloads)], "record_id long, payload string, entity string, node int")
    occ = nested.occurrences(df, "record_id", "payload").cache()
    got = sorted((x.record_id, x.entity, x.node) for x in occ.where(F.col("entity").isin(*nested.ENTITIES)).collect())
    assert got == sorted((i, *n) for i, x in enumerate(records) if x for n in plain_nodes(x))
    things = nested.objects(occ)
    assert things.agg(F.sum("occurrences")).first()[0] == occ.count() and things.count() < occ.count()
    ids = {x.object_id for x in things.collect()}
    assert all(x.parent_id in ids and x.object_id in ids for x in nested.bridge(occ, "record_id").collect())
    assert nested.occurrences(df.limit(0), "record_id", "payload").count() == 0


def test_merkle_identity():
    a, b = nested.merkle({"x": {"p": 1, "q": [{"z": 1}]}}), nested.merkle({"x": {"q": [{"z": 1}], "p": 1}})
    assert [r["object_id"] for r in a] == [r["object_id"] for r in b]
    assert a[-1]["object_id"] != nested.merkle({"x": {"p": 1, "q": [{"z": 2}]}})[-1]["object_id"]


# text ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("f", "text", "want"), [
    (T.normal_answer, "The New-York.", "new york"), (T.normal_answer, "15,848", "15848"), (T.normal_answer, "33%", "33"), (T.normal_answer, None, ""), (T.normal, "A_b  C—d", "a_b c d"), (T.normal_plain, "A_b  C—d", "a b c d"),
    (T.answer_type, "42", "number"), (T.answer_type, "March 10, 1949", "date_or_year"), (T.answer_type, "Benedict Arnold", "short_entity"), (T.answer_type, "one two three four five six seven", "short_text"),
    (T.predicted_answer, "Answer: Paris\n", "Paris"), (T.predicted_answer, '{"answer":"Warsaw"}', "Warsaw"), (T.predicted_answer, '```json\n{"answer": "Rome"}\n```', "Rome"), (T.predicted_answer, None, ""),
    (T.action, "request_conflict_resolution", "REQUEST_CONFIRMATION"), (T.action, "sing", None), (T.role, "human", "user"), (T.repeats_sentence, "He sold it later. He sold it later.", True), (T.repeats_sentence, "Yes. Yes.", False),
    (T.sentences, "It was. (He left.) 3 more", ["It was.", "(He left.) 3 more"]), (T.references, "what of #2 and #1, #2", [1, 2]), (T.title_of, "Title: A b\n\nc", "A b"), (T.body_of, "Title: A b\n\nc", "c"), (T.body_of, "x", "x"),
    (T.unfence, "```\nx\n```", "x"), (T.json_object, 'so: {"a": 1} ok', '{"a": 1}'), (T.json_object, "none", None), (T.abstains, "There is INSUFFICIENT data", True), (T.too_long, "x" * 81, True), (T.too_long, "a " * 12, False),
])
def test_text(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


def test_phrases(spark):
    has = lambda h, n: one(spark, T.contains_phrase(T.normal_answer("h"), T.normal_answer("n")), h=h, n=n)
    assert has("Was New York involved?", "The New-York") and not has("Yorkshire is a county", "York") and not has("x", "") and not has("", "")
    assert one(spark, T.distinct_by(F.col("v")), v=["A b", "a  B", "", "c"]) == ["A b", "c"]
    gap = lambda h, n: one(spark, T.gapped_mention(F.col("h"), F.col("n")), h=h, n=n)
    assert gap("larry richard drake", "larry drake") and not gap("larry a b c drake", "larry drake") and not gap("larry", "larry")


def test_nfkc(spark):
    assert one(spark, T.normal("t"), t="Ｓtraße ﬁn ½") == "strasse fin 1 2" and one(spark, T.normal_plain("t"), t="ﬁN ΣΑΣ") == "fin σασ"


def test_phrase_hits_against_all_pairs(spark):
    r = random.Random(8)
    word = lambda: r.choice("abcdefg")
    docs = [(i, " ".join(word() for _ in range(r.randrange(12)))) for i in range(60)]
    phrases = [(" ".join(word() for _ in range(r.randrange(1, 5))),) for _ in range(40)] + [("b",), ("b",)]
    got = {tuple(x) for x in record_queries.phrase_hits(spark.createDataFrame(docs, "doc_id long, normal string"), spark.createDataFrame(phrases, "phrase string")).collect()}
    assert got == {(i, p) for i, d in docs for (p,) in phrases if f" {p} " in f" {d} "}


def test_words_of_documents_are_never_broadcast(spark, sf):
    docs = [(i, " ".join(f"w{(i * j) % 97}" for j in range(50))) for i in range(50)]
    df = record_queries.phrase_hits(spark.createDataFrame(docs, "doc_id long, normal string"), spark.createDataFrame([("w0 w1 w2",), ("w1",)], "phrase string"))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    for plan in (df, record_queries.decontaminate(spark, sf)):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_clean_documents_without_planned_broadcast(spark, sf):
    df = record_queries.decontaminated(spark, sf)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    hit = {r.doc_id for r in record_queries.decontaminate(spark, sf).collect()}
    assert sorted(r.doc_id for r in df.collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect() if r.doc_id not in hit)


def test_hit_documents_are_not_broadcast_when_their_size_is_known(spark, sf):
    df = record_queries.decontaminated(spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan.partition("== Initial Plan ==")[0]


# selections ---------------------------------------------------------------------------------------------------------


def test_selections(spark):
    df = spark.createDataFrame([(f"i{k:03}", "ab"[k % 2], k) for k in range(100)], "id string, g string, n int")
    ten, twenty = ({r.id for r in select.hash_sample(df, ["g"], "id", k, "7").collect()} for k in (5, 10))
    assert len(ten) == 10 and ten < twenty
    order = [select.stable_rank(F.lit("7"), "id").alias("h"), F.col("id").alias("i")]
    assert {r.id for r in select.beyond_k(df, ["g"], order, 10).collect()} == {f"i{k:03}" for k in range(100)} - twenty
    log_ = spark.createDataFrame([(1, "a", "error"), (2, "b", "ok"), (3, "a", "ok"), (4, "b", "error"), (5, None, "ok")], "ord int, id string, status string")
    assert {(r.id, r.ord) for r in select.last_wins(log_, ["id"], ["ord"]).collect()} == {("a", 3), ("b", 4), (None, 5)}
    assert {(r.id, r.ord) for r in select.first_wins(log_, ["id"], ["ord"]).collect()} == {("a", 1), ("b", 2), (None, 5)}
    assert {r.id for r in select.done_ids(log_, "id", ["ord"], F.col("status") == "ok").collect()} == {"a", None}
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {r.id for r in select.pending(tasks, log_, "id", ["ord"], F.col("status") == "ok").collect()} == {"b", "c"}
    assert [tuple(r) for r in select.next_in_cycle(tasks.withColumn("g", F.lit(1)), ["g"], "id").orderBy("id").select("id", "next_id").collect()] == [("a", "b"), ("b", "c"), ("c", "a")]
    assert {r.id for r in select.inconsistent(log_, ["id"], F.col("status")).collect()} == {"a", "b"}


def test_rules(spark):
    df = spark.createDataFrame([(1, None), (-1, 2), (3, 3)], "a int, b int")
    named = {"NEG": F.col("a") < 0, "NO_B": F.col("b").isNull(), "EQ": F.col("a") == F.col("b")}
    assert [r.x for r in df.select(rules.reasons(named).alias("x")).collect()] == [["NO_B"], ["NEG"], ["EQ"]]
    assert [r.x for r in df.select(rules.first_reason(named).alias("x")).collect()] == ["NO_B", "NEG", "EQ"]
    good, bad = rules.route(df, rules.reasons({"NEG": F.col("a") < 0}))
    assert good.count() == 2 and bad.count() == 1 and rules.reason_counts(bad, []).first().n == 1
    flags = spark.createDataFrame([(True, None), (True, True), (False, False)], "p boolean, q boolean")
    assert [r.x for r in flags.select(rules.all_true([F.col("p"), F.col("q")]).alias("x")).collect()] == [False, True, False]
    assert [r.x for r in flags.select(rules.none_true([F.col("p"), F.col("q")]).alias("x")).collect()] == [False, False, True]


# scores -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("p", "answers", "exact", "alias", "f1"), [("Fernie Alpine Resort.", ["Fernie Alpine Resort"], True, True, 1.0), ("Mike Stoller", ["Jerry Leiber and Mike Stoller", "Mike Stoller"], False, True, 1.0), ("", ["the"], True, False, 1.0), ("x y", ["x z z"], False, False, 0.4), (None, [], None, False, 0.0)])
def test_scores(spark, p, answers, exact, alias, f1):
    assert one(spark, score.exact_match(F.col("p"), F.get("a", F.lit(0))), p=p, a=answers) == exact or exact is None
    assert one(spark, score.alias_match(F.col("p"), F.col("a")), p=p, a=answers) is alias
    assert abs(one(spark, score.best_f1(F.col("p"), F.col("a")), p=p, a=answers) - f1) < 1e-9


def test_stats(spark):
    df = spark.createDataFrame([("x", "s1", 1), ("x", "s1", 0), ("x", "s2", 1), ("y", "s1", 0), ("y", "s2", 1), ("y", "s3", None)], "run string, s string, v int")
    x = {r.run: r for r in stats.macro(df, ["run"], "s", F.col("v")).collect()}
    assert x["x"].macro == 0.75 and abs(x["x"].micro - 2 / 3) < 1e-9
    d = stats.paired_delta(df, "s", "run", F.col("v"), "x").first()
    assert (d.delta, d.better, d.worse, d.units) == (-0.25, 0, 1, 2)
    assert {(r.run, r.n) for r in stats.blocks(df, ["run", "s"], [F.count(F.lit(1)).alias("n")]).collect()} >= {(None, 6), ("x", 3), ("y", 3)}
    b = {r.run: r for r in stats.cluster_bootstrap(df.where("v is not null"), ["run"], "s", F.col("v"), 40, "z").collect()}
    assert 0 <= b["x"].low <= b["x"].mid <= b["x"].high <= 1
    assert df.limit(0).agg(stats.rate(F.col("v") == 1).alias("a"), stats.rate(F.col("v") == 1, 0.0).alias("b")).first() == (None, 0.0)


# evidence -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("answer", "question", "want"), [("42 percent", "How much?", "49 percent"), ("273,282", "How many?", "273,289"), ("Scottish", "What nationality was the writer?", "Lumerian"), ("Ada Moss", "Who built it?", "Maren Valeris"), ("3.5", "x", "10.5"), (None, "x", None), ("March 10, 1949", "x", "August 18, 1966")])
def test_counterfactual(spark, answer, question, want):
    got = one(spark, E.counterfactual_answer(F.col("a"), F.lit("s1"), F.col("q")), a=answer, q=question)
    assert got == want


def test_counterfactual_words(spark):
    got = one(spark, E.counterfactual_answer(F.col("a"), F.lit("s1"), F.col("q")), a="professional association football", q="Which sport?")
    assert len(set(got.split())) == 3 and set(got.split()) <= set(E.PSEUDO)
    years = one(spark, E.counterfactual_answer(F.col("a"), F.lit("s1"), F.col("q")), a="1977 and 1985", q="x")
    assert "1977" not in years and "1985" not in years
    assert one(spark, E.replace_answers(F.col("t"), F.col("a"), F.lit("N$1")), t="Al met al and Alan; a.b (Al)", a=["Al", "a.b", ""]) == "N$1 met N$1 and Alan; N$1 (N$1)"
    assert one(spark, E.shifted_last_number(F.col("t")), t="5 in 1999, 1999") == "5 in 2002, 1999" and one(spark, E.shifted_last_number(F.col("t")), t="none") is None


def test_edits(spark):
    df = spark.createDataFrame([([("d1", "t", "It is. More."), ("d2", "u", "x")], ("d1", "More.", "", ""), ("d1", "", "", " More."))], "docs array<struct<document_id string, title string, text string>>, m struct<document_id string, original_span string, replacement_span string, appended_text string>, c struct<document_id string, original_span string, replacement_span string, appended_text string>")
    r = df.select(E.undo_addition(F.col("docs"), F.col("c")).alias("a"), E.undo_replacement(F.col("docs"), F.col("m")).alias("b"), E.changed_documents(F.col("docs"), F.reverse("docs")).alias("ch"), E.without_answers(F.col("docs"), F.array(F.lit("More"))).alias("s")).first()
    assert r.a[0].text == "It is." and r.b[0].text == "It is. More. More." and len(r.ch) == 2 and r.s[0].text == "" and r.s[1].text == "x"


# corpora ------------------------------------------------------------------------------------------------------------

HOTPOT = "id string, question string, answer string, type string, context struct<title array<string>, sentences array<array<string>>>, supporting_facts struct<title array<string>, sent_id array<int>>"


def test_hotpot(spark):
    docs = (["Old Mill", "Rika Moss", "Other"], [["The Old Mill was built by Rika Moss."], ["Rika Moss was born in Tavi."], ["Nothing."]])
    ok = ("1", "Where was the builder of the Old Mill born?", "Tavi", "bridge", docs, (["Old Mill", "Rika Moss"], [0, 0]))
    rows = [ok, ("2", ok[1], "Tavi", "bridge", docs, (["Old Mill", "Rika Moss"], [0, -1])), ("3", " ", None, "bridge", docs, (["Old Mill", "Gone"], [0, 9])), ("4", ok[1], "Tavi", "bridge", None, None), ("5", ok[1], "Tavi", "b", (docs[0][:1], docs[1]), ok[5])]
    got = {r.sample_id: r for r in corpora.hotpot_samples(spark.createDataFrame(rows, HOTPOT)).collect()}
    assert got["hotpotqa_1"].reasons == [] and [(u.document_id, u.hop) for u in got["hotpotqa_1"].support_units] == [("doc_0", 1), ("doc_1", 2)]
    assert "BROKEN_POINTER" in got["hotpotqa_2"].reasons and {"EMPTY_QUESTION", "MISSING_ANSWER", "BROKEN_POINTER"} <= set(got["hotpotqa_3"].reasons)
    assert got["hotpotqa_4"].reasons == ["PARSE_ERROR"] and got["hotpotqa_5"].reasons == ["PARSE_ERROR"]


def test_musique_and_proxy(spark):
    kind = "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx int, title string, paragraph_text string, is_supporting boolean>>, question_decomposition array<struct<question string, answer string, paragraph_support_idx int>>"
    paragraphs = [(3, "A", "Rika built it.", True), (5, "B", "Rika was born in Tavi.", True), (6, "C", "No.", False)]
    rows = [("1", "Where was its builder born?", "Tavi", ["TAVI", None], paragraphs, [("Who built it?", "Rika", 3), ("Where was #1 born?", "Tavi", 5)]), ("2", "Where?", "Tavi", None, paragraphs, [("Who?", "Rika", 3), ("Where?", "Tavi", 6)]), ("3", None, None, None, None, None)]
    got = {r.sample_id: r for r in corpora.musique_samples(spark.createDataFrame(rows, kind)).collect()}
    assert got["musique_1"].reasons == [] and got["musique_1"].answers == ["Tavi"] and [u.document_id for u in got["musique_1"].support_units] == ["para_3", "para_5"]
    assert {"BROKEN_POINTER", "INCOMPLETE_CHAIN"} <= set(got["musique_2"].reasons) and "MISSING_ANSWER" in got["musique_3"].reasons
    proxy = spark.createDataFrame([("1", "Where was he born?", "Title: Rika\n\nHe built it. He was born in Tavi.", ["Tavi"]), ("2", "How many?", "It had 12.", ["12"]), ("3", None, None, None)], "source_id string, original_query string, original_context string, original_answers array<string>")
    p = {r.sample_id: r for r in corpora.proxy_samples(proxy).collect()}
    assert p["nq_proxy_1"].reasons == [] and [u.sentence_id for u in p["nq_proxy_1"].support_units] == [1] and p["nq_proxy_1"].context[0].title == "Rika"
    assert p["nq_proxy_2"].reasons == ["BARE_NUMBER"] and "MISSING_ANSWER" in p["nq_proxy_3"].reasons


# views, files, streams ----------------------------------------------------------------------------------------------


def test_views(spark):
    df = spark.createDataFrame([("q", [(1, "model", "A", "x"), (2, "human", None, None), (3, "assistant", "B", "z")]), ("q", None), ("q", [(1, "cat", "A", "x")])], "query string, trajectory array<struct<turn int, role string, action string, content string>>")
    assert [r.x for r in df.select(views.is_three_turns(F.col("trajectory")).alias("x")).collect()] == [True, False, False]
    groups = spark.createDataFrame([(f"g{i}", "ab"[i % 2]) for i in range(200)], "g string, s string")
    split = views.balanced_split(groups, "g", F.col("s"), {"train": 0.8, "dev": 0.1, "test": 0.1}, 30, "x")
    n = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert split.count() == 200 and abs(n["train"] - 160) < 12 and views.leaks(split.withColumnRenamed("g", "group"), "group").count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, None)], "id int, t string, l array<string>")
    files.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(files.read_jsonl(spark, f"{tmp_path}/j", df.schema).collect()) == sorted(df.collect())
    with pytest.raises(Exception):  # noqa: B017
        files.write_jsonl(df, f"{tmp_path}/j")
    files.append_log(df, f"{tmp_path}/j")
    assert files.read_jsonl(spark, f"{tmp_path}/j", df.schema).count() == 4
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"id": 1}\n\nnot json\n{"id": 2}\n')
    good, bad = files.split_corrupt(files.read_jsonl(spark, f"{tmp_path}/bad", "id int", strict=False).cache())
    assert good.count() == 2 and bad.first()._corrupt == "not json"
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, f"{tmp_path}/bad", "id int").collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.jsonl", '{"id": 1}\n\n{"id": 2}\n')
    assert files.read_jsonl_zip(spark, f"{tmp_path}/z.zip", "m.jsonl", "id int").count() == 2
    assert files.read_optional(spark, f"{tmp_path}/none", "id int").count() == 0
    files.write_review_csv(df, f"{tmp_path}/c", ["label"])
    assert next((tmp_path / "c").glob("part*")).read_text(encoding="utf-8").startswith("﻿id,t,l,label")
    assert files.checksums(spark, f"{tmp_path}/bad").count() == 1 and files.oversized(spark, f"{tmp_path}/bad", most=5).first().reason == "TOO_LARGE"
    assert one(spark, files.markdown_section(F.lit("T"), {"a": F.lit(1), "b": F.lit(None)})) == "## T\n\n- a: 1\n- b: —"


def test_streams(spark, tmp_path):
    df = deliveries(spark).drop("kept", "deliveries", "__id").where("delivered_at is not null").withColumns({"status": F.lit("SUCCESS"), "provider": F.lit("p")})
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = log.once_within(log.read_log(spark, f"{tmp_path}/in", df.schema))
    q = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(90)
    assert spark.table("once").count() == 8
    q = log.keep_latest(log.read_log(spark, f"{tmp_path}/in", df.schema), "sample_id", ["delivered_at", "delivery_id"], f"{tmp_path}/latest", f"{tmp_path}/c2")
    q.awaitTermination(90)
    assert spark.read.parquet(f"{tmp_path}/latest/v0").count() == df.select("sample_id").distinct().count()
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(20)], "id string")
    waves = log.work_off(tasks, tasks.where("id = 't0'"), "id", lambda x: x.withColumn("r", F.lit(1)), f"{tmp_path}/out", 4, 19)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 19 and waves <= 4


def test_catalogue_runs_on_the_smallest_tables(spark, sf):
    for name, q in catalogue.queries().items():
        df = q(spark, sf)
        assert df.columns and df.count() >= 0, name


def test_core_does_not_need_llm():
    from pathlib import Path

    for p in Path(__file__).parent.parent.joinpath("evloom").rglob("*.py"):
        if "/llm/" not in str(p):
            assert "llm" not in p.read_text().replace("evloom.llm is optional", ""), p


# whole jobs ---------------------------------------------------------------------------------------------------------


def test_whole_cluster_bootstrap_against_all_resamples(spark):
    """The interval of 10,000 iterations beside the exact distribution: every resample of six clusters."""
    clusters = {"a": [1, 1, 1], "b": [0], "c": [0, 1], "d": [1], "e": [0, 0, 0, 0], "f": [1]}
    df = spark.createDataFrame([("x", c, v) for c, vs in clusters.items() for v in vs], "run string, s string, v int")
    exact = sorted(sum(sum(vs) for vs in r) / sum(map(len, r)) for r in itertools.product(clusters.values(), repeat=6))
    got = stats.whole_cluster_bootstrap(df, ["run"], "s", F.col("v"), 10_000, "z")
    for p, x in zip((0.025, 0.5, 0.975), got.first()[1:]):
        assert exact[int((p - 0.01) * len(exact))] <= x <= exact[min(len(exact) - 1, int((p + 0.01) * len(exact)))]
    assert got.collect() == stats.whole_cluster_bootstrap(df.repartition(3), ["run"], "s", F.col("v"), 10_000, "z").collect()


def test_searched_split_against_plain_loop(spark):
    rows = [(f"g{i}", "ab"[i * i % 3 % 2]) for i in range(150) for _ in range(1 + i % 3)]
    got = {r.g: r.split for r in views.searched_split(spark.createDataFrame(rows, "g string, s string"), "g", F.col("s"), {"train": 0.8, "dev": 0.1, "test": 0.1}, 300, "x").collect()}
    h = {g: int(hashlib.sha256(f"x:{g}".encode()).hexdigest()[:15], 16) for g, _ in rows}

    def dealt(trial):
        out = {}
        for g, x in h.items():
            z = (x + (trial + 1) * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            u = ((z ^ z >> 31) >> 11) / 2**53
            out[g] = "train" if u < 0.8 else "dev" if u < 0.9 else "test"
        return out

    def error(trial):
        to, n = dealt(trial), collections.Counter(s for _, s in rows)
        seen = collections.Counter((s, to[g]) for g, s in rows)
        return round(sum(((seen[s, k] - n[s] * share) / max(1, n[s] * share)) ** 2 for s in n for k, share in (("train", 0.8), ("dev", 0.1), ("test", 0.1))), 9)

    assert got == dealt(min(range(300), key=lambda t: (error(t), t)))


def test_whole_counts_are_registered(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(stats, "whole_cluster_bootstrap", lambda *a: seen.append(a[4]))
    monkeypatch.setattr(views, "searched_split", lambda *a: seen.append(a[4]))
    for name in ("cluster_bootstrap_10000", "balanced_split_5000"):
        catalogue.queries()[name](spark, sf)
    assert seen == [10_000, 5000]


def test_request_objects_give_the_bodies_back(spark):
    """The three tables rebuild the request body of every delivery."""
    kind = """delivery_id long, request_body struct<temperature double, top_p double, max_tokens int, seed int, stop array<string>, chat_template_kwargs struct<enable_thinking boolean, thinking_budget int>,
        response_format struct<type string, json_schema struct<name string, strict boolean, required array<string>>>>"""
    body = lambda stop, strict, required: (0.5, None, 9, 1, stop, (True, None), ("json", ("s", strict, required)))
    rows = [body(["a|b", None], True, ["x"]), body(["a", "b"], True, ["x"]), body(["a|b"], True, ["x"]), body([], True, None), body(None, True, []), body(None, False, []), body(None, False, []), None]
    bodies, lists, bridge = (x.collect() for x in nested.request_objects(spark.createDataFrame(list(enumerate(rows)), kind)))
    of, by = dict(map(tuple, bridge)), {r.body_id: r for r in bodies}
    assert set(of) == set(range(7)) and len(by) == 6 and by[of[5]].deliveries == 2
    elements = collections.defaultdict(list)
    for r in sorted(lists, key=lambda r: r.ordinal):
        elements[r.body_id, r.list].append(r.element)
    for i, row in enumerate(rows[:7]):
        b, at = by[of[i]], lambda n: None if b[f"{n}_length"] is None else elements[b.body_id, n]  # noqa: B023
        assert (b.temperature, b.top_p, b.max_tokens, b.seed, at("stop"), (b.enable_thinking, b.thinking_budget), (b.format_type, (b.schema_name, b.strict, at("required")))) == row


def test_exactly_once_also_under_one_id(spark):
    """A delivery that is repeated under its own id, whole or with another column changed, leaves one row; maps are carried."""
    kind = "delivery_id long, k string, at int, note string, m map<string,string>"
    rows = [(1, "a", 5, "x", {"p": "q"}), (1, "a", 5, "x", {"p": "q"}), (1, "a", 5, "b", None), (2, "a", 9, "y", None), (3, None, 1, "z", None), (3, None, 1, "z", None)]
    for columns in (["delivery_id", "k", "at", "note", "m"], ["delivery_id", "k", "at", "note"]):
        got = messages.exactly_once(spark.createDataFrame(rows, kind).select(*columns), {"k": F.col("k")}, ["at"], "delivery_id").collect()
        assert sorted((r.delivery_id, r.note) for r in got) == [(1, "b"), (3, "z"), (3, "z")]


def test_cycle_over_many_ranges(spark):
    df = spark.range(3000).selectExpr("lpad(id, 5, '0') AS id", "CASE WHEN id < 2900 THEN 'hot' END AS g")
    got = {(r.g, r.id): r.next_id for r in select.next_in_cycle(df, ["g"], "id").collect()}
    assert len(got) == 3000 and got["hot", "02899"] == "00000" and got[None, "02999"] == "02900" and all(got["hot", f"{i:05}"] == f"{i + 1:05}" for i in range(2899))


def test_every_model_takes_part(spark):
    models = spark.createDataFrame([(f"m{i}",) for i in range(150)] + [(None,)], "model_alias string")
    assert select.times(spark.createDataFrame([("s",)], "sample_id string"), models, "model_alias").count() == 150


@pytest.mark.parametrize(("name", "used"), [("stable_topk", {"dataset"}), ("family_samples", {"source_sample_id"}), ("token_f1", {"answer", "answer_aliases"}), ("donor_next", {"dataset", "initial_state"})])
def test_scans_read_what_is_used(spark, sf, name, used):
    from evloom.plans.record_queries import families

    df = families(spark, sf, *used) if name == "donor_next" else catalogue.queries()[name](spark, sf)
    scans = [x.split("ReadSchema: ")[1] for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "families.parquet" in x and "ReadSchema: " in x]
    assert scans and not any(c in x for x in scans for c in ("trajectory", "full_state", "exported_at", "author"))


def test_canonical_requests(spark):
    df = spark.sql("""SELECT named_struct('b', 1, 'a', named_struct('y', CAST(NULL AS string), 'x', array('p"q', NULL))) AS r""")
    assert df.select(T.canonical_json(F.col("r"), df.schema["r"].dataType).alias("j")).first().j == '{"a":{"x":["p\\"q",null],"y":null},"b":1}'


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from evloom import session

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077")))


def test_rejected_records(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "{"), (4, "[1]"), (5, '{"a": 1}'), (6, "[" * 200_000 + "]" * 200_000)], "record_id long, payload string")
    assert {(r.record_id, r.reason) for r in nested.rejected(df, "record_id", "payload").collect()} == {(1, "EMPTY"), (2, "EMPTY"), (3, "NOT_JSON"), (4, "NO_OBJECT"), (6, "TOO_DEEP")}
