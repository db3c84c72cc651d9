"""Truncated texts, defective responses, one form, garbled text: against plain versions and on edge cases."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from evloom.llm import garbled, queries, responses, truncation, unify, words

CALLS = "delivery_id long, dataset string, provider string, attempts array<struct<attempt int, raw_response string, api_error string>>, text string, keys int, copy string, word string"


def calls(spark, rows):
    return spark.createDataFrame([(i, "d", None, a, "x", 1, "y", "z") for i, a in enumerate(rows)], CALLS)


@pytest.mark.parametrize(
    ("text", "how"),
    [
        ('{"a": "b"}', "closed"), ('{"a": "b', "open"), ('{"a": [1, 2', "open"), ('```json\n{"a": 1}\n```', "closed"), ('{"a" true, "b": "c"}', "closed"), ('"a": true, "b": "c"}', "closed"),
        ('{"a": "say "no" b"}', "closed"), ("A long sentence was here. Another one beg", "prose"), ("Paris", "loose"), ("Answer: St. Gallen\n", "loose"), ("It is done. [truncated]", "open"),
        ("It is do…", "open"), ("The opening year of", "prose"), ("1968.", "closed"), ('{"a": "b <cut>', "open"), ('{"a": "b\\', "open"),
    ],
)
def test_ending(text, how):
    assert truncation.ending(text, "raw_response") == how


def test_truncated_edges(spark):
    whole = "The harbour office keeps a ledger of every ship that came in during the winter of the great storm, and nobody has read it since then until Maria Gonzaga Montalto."
    rows = [None, [], [None], [(1, None, None)], [(1, "", " ")], [(1, whole, None)], [(None, whole[:-8], None)], [(1, "x" * 200_000, None)], [(1, '{"a": "' + "y " * 50_000, None)]]
    got = {(r.delivery_id, r.field) for r in truncation.truncated(calls(spark, rows)).collect()}
    assert got == {(6, "raw_response"), (8, "raw_response")}
    assert truncation.truncated(calls(spark, []).limit(0)).count() == 0
    report = {r.field: (r.texts, r.cut) for r in truncation.truncation_report(calls(spark, rows)).collect()}
    assert report["raw_response"] == (4, 2)


def test_copy_decides(spark):
    """A loose text is cut if a near-copy goes on; the alignment says so."""
    base = "answer: " + " ".join(f"w{i}" for i in range(40))
    got = truncation.truncated(calls(spark, [[(1, base + " and so on.", None)], [(1, base, None)], [(1, "other words " * 9, None)]])).collect()
    assert [(r.delivery_id, r.evidence) for r in got] == [(1, "copy")]


def test_every_copy_of_a_bucket_is_tried(spark):
    """The near-copy that tells is neither the longest text of the suspect's buckets nor one with a stop."""
    base = "answer: " + " ".join(f"w{i}" for i in range(40))
    longer = [base + "".join(f" v{j}x{i}" for i in range(30)) + "." for j in range(6)]  # 36 of 66 shingles: in many of its buckets, below 0.8
    got = truncation.truncated(calls(spark, [[(1, t, None)] for t in [base, base, base + " and so on", *longer]])).collect()
    assert sorted((r.delivery_id, r.evidence) for r in got) == [(0, "copy"), (1, "copy")]


def test_closing_words(spark):
    """Closing words decide where no stop does, by how often they end sentences elsewhere."""
    told = [[(1, f"The club of N{i} moved to the mill near Paris. The club was in Paris.", None)] for i in range(12)]
    asked = ["It was built in 1900. It lies in Paris", "In 1999 the club moved to the", "It was built in 1900. It lies near the", "It was built in 1900. It lies in Zoruv", "Paris"]
    got = {r.delivery_id - 12: r.evidence for r in truncation.truncated(calls(spark, told + [[(1, t, None)] for t in asked])).collect()}
    assert got == {1: "closing", 2: "closing", 3: "closing"}


def test_error_kinds(spark):
    stop = [[(1, None, f"StreamError: gate closed the stream. Giving up after {i} tries.")] for i in range(9)]
    cut = [[(1, None, "StreamError: gate closed the str")], [(1, None, "TimeoutError: request timed out after 4 s")]]
    got = {r.delivery_id for r in truncation.truncated(calls(spark, stop + cut)).collect()}
    assert got == {9}


def test_defects(spark):
    q = "What was the founder of Old Tavi Museum when Rika Moss left the mill?"
    stopped = [("ANSWER", f"The records name N{i} as the founder of it.", None) for i in range(12)]
    cases = [
        (("ANSWER", "", ""), None, "empty"), (("ANSWER", "n/a", ""), None, "empty"), (("ANSWER", "​", ""), None, "empty"), (("ANSWER", None, "x"), None, "empty"), (("ANSWER", "N/A Street 14", ""), None, None),
        (("ANSWER", "Sorry! I can’t help with that request (policy).", ""), None, "refusal"), (("ANSWER", "Sorry, Wrong Lantern", ""), None, None),
        (("ANSWER", "The council refused to confirm it at first, but the founder was Rika.", ""), None, None),
        (("REQUEST_INFORMATION", "", "what was the founder of old tavi museum when rika moss left the mil"), None, "copies_question"),
        (("ANSWER", "Según los documentos, la respuesta sobre el fundador de Tavi es Rika.", ""), None, "other_language"), (("ANSWER", "Die Nacht der Fähren", ""), None, None),
        (("ANSWER", "The records name Rika as the fou", ""), None, "truncated"), (("ANSWER", "Rika Moss", ""), None, None), (None, "{}", "empty"), (None, '{"action":"ANSWER","answer":"Ri', "truncated"),
        (None, None, None), (None, "__API_ERROR__:x", None), (("DANCE", None, "ok"), None, None), (None, "x" * 100_000, None),
    ]
    rows = [(100 + i, q, "r", p + ("r",), "extra") for i, p in enumerate(stopped)]
    rows += [(i, q, raw if p is None else "r", p and p + ("r",), "extra") for i, (p, raw, _) in enumerate(cases)]
    rows += [(50, None, None, None, None), (51, None, "r", ("ANSWER", "", "", "r"), None), (51, None, "r", ("ANSWER", "", "", "r"), None)]
    df = spark.createDataFrame(rows, "response_id long, query string, raw_response string, parsed struct<action string, answer string, clarification string, reason string>, defect string")
    fields = spark.createDataFrame([("ANSWER", "answer"), ("REQUEST_INFORMATION", "clarification"), (None, None)], "action string, content_field string")
    got = [(r.response_id, r.defect) for r in responses.defects(df, fields).collect()]
    assert sorted(x for x in got if x[0] < 50) == sorted((i, d) for i, (_, _, d) in enumerate(cases) if d)
    assert got.count((51, "empty")) == 2
    assert responses.defects(df.limit(0), fields).count() == 0


def test_rare_openings_count_at_every_size(spark):
    """Three responses tell how an opening ends, also among very many others."""
    stopped = ["Jak wynika ze spisu, to N."] * 3
    rows = [(i, "q", "r", ("ANSWER", t, None, "r")) for i, t in enumerate([*stopped, "Jak wynika ze spi"])]
    other = spark.range(10, 60_010).selectExpr("id AS response_id", "'q' AS query", "'r' AS raw_response", "named_struct('action', 'ANSWER', 'answer', 'Zoru', 'clarification', CAST(NULL AS string), 'reason', 'r') AS parsed")
    df = spark.createDataFrame(rows, "response_id long, query string, raw_response string, parsed struct<action string, answer string, clarification string, reason string>").unionByName(other)
    fields = spark.createDataFrame([("ANSWER", "answer")], "action string, content_field string")
    assert [tuple(r) for r in responses.defects(df, fields).collect()] == [(3, "truncated")]


def test_copies_takes_the_whole_response():
    q = "Of A and B, which is the older paper mill, and what was its opening year?"
    assert not responses.copies(q, "Of A and B, which is the older paper mill, and what was its opening year? The older paper mill is B and its opening year was 1950")
    assert not responses.copies(q, q + " The older paper mill is B and its opening year was 1950, and what was A")
    assert responses.copies(q, q + " " + q.replace("older", "oldr").replace("its ", "") + " " + q) and responses.copies(q, "Question: " + q.replace("paper", "papr")) and responses.copies(q, q)


def test_unify_is_nfc_of_marks():
    r = random.Random(3)
    texts = ["".join(r.choice("aeoucnAEÄöd가ᄀq") + "".join(r.choice("̧̣̱̀́̂̃̈̌ᅡᆨ") for _ in range(r.choice([0, 1, 1, 2, 3]))) for _ in range(4)) for _ in range(3000)]
    done, _ = unify.unify_array(pa.array(texts))
    assert done.to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ｐａｒｉｓ", "Paris"), ("Bagaﬁ", "Bagafi"), ("a b", "a b"), ("Vuki​visk", "Vukivisk"), ("Rе‍nо", "Reno"), ("half‑finished", "half-finished"), ("Kelvin", "Kelvin"), ("Mánore", "Mánore"),
        ("Большой маяк 7", None), ("卡维洛（塔里穆），旧址", None), ("“x” — ’y’ m² ½ …", None), ("\U0001f642\U0001f469‍\U0001f52c", None), ("Žalodan", None), ("", None), (None, None), ("Νοο", None), ("old Νοο mill", "old Noo mill"), ("５ km", "5 km"),
    ],
)
def test_unify_cases(text, want):
    done, changed = unify.unify_array(pa.array(["plain", text, None], pa.string()))
    assert done.to_pylist() == ["plain", want if want is not None else text, None]
    assert list(changed) == [False, want is not None, False]


def test_affected_fields_edges(spark):
    kind = "family_id string, answer string, answer_aliases array<string>, full_state struct<state string, evidence array<struct<document_id string, title string, text string>>>, text string, unified int, changed int"
    rows = [("a", "Ｐ", None, None, "t", 1, 1), ("a", "Ｐ", [None, "x"], ("FULL", None), "t", 1, 1), ("b", None, ["ok", "a​b"], ("FULL", [("d", "Ｔ", "fine"), None, ("e", None, "ﬁ" + "z" * 100_000)]), None, None, None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    assert {tuple(r) for r in unify.affected_fields(df).collect()} == {("a", "answer"), ("b", "answer_aliases"), ("b", "evidence")}
    assert unify.affected_fields(df.limit(0)).count() == 0
    assert set(unify.unify_column(df.select("family_id", "text", "unified", "changed"), "text").columns) == {"family_id", "text", "unified", "changed"}


def test_words_against_plain():
    r = random.Random(5)
    texts = [" ".join(r.choice(["Ærø", "x1", "47,566", "don’t", "café", "当地", "—", "A", "b."]) for _ in range(r.randrange(9))) for _ in range(400)] + ["", None]
    hashes, offsets = words.words(pa.array(texts))
    import re

    def plain(t):
        t = re.sub(r"(?<=\d),(?=\d)", "", t or "").lower()
        return [w for x in re.findall(r"\w+", t) for w in (list(x) if x[0] >= "㐀" else [x])]

    want = [w for t in texts for w in plain(t)]
    assert list(offsets) == [0, *__import__("itertools").accumulate(len(plain(t)) for t in texts)]
    known = {}
    for h, w in zip(hashes.tolist(), want):
        assert known.setdefault(h, w) == w
    assert len(known) == len(set(want))


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", ["Über die Gründung ist wenig überliefert, façade “so” — naïve.", "Каждый год школьники ставят пьесы.", "当地学生每年都会演出这部戏。", "Założyciel młodzież łącznie żółć"])
@pytest.mark.parametrize("times", [1, 2])
def test_utf8_garbled_and_back(encoding, text, times):
    seen = text
    for _ in range(times):
        seen = garbled._read(seen.encode(), encoding)
    done, how = garbled.restore("Plain start. " + seen + " Plain end.")
    assert how
    assert done == "Plain start. " + text + " Plain end."


def test_single_byte_mixups():
    ru, zh, pl = "Кто заплатил за колокол, до сих пор неизвестно.", "档案中保存着信件和地图", "Każdej jesieni młodzież wystawia krótszą wersję"
    for text, seen in ((ru, ru.encode("cp1251").decode("cp1252")), (zh, zh.encode("gb2312").decode("latin-1")), (pl, pl.encode("cp1250").decode("cp1252")), (ru, ru.encode("koi8_r").decode("cp1251"))):
        done, how = garbled.restore(seen)
        assert how and done == text


def test_utf8_as_gbk():
    text = "档案中保存着信件、两张地图。 Kánikán大桥于1986年建成"
    assert garbled.restore("K谩nik谩n was") == ("Kánikán was", ["gbk"])
    done, how = garbled.restore("x " + "档案中保存着信件和地图".encode().decode("gbk", "replace"))
    assert how == ["lost", "gbk"] and "中保存" in done
    whole = next(t for t in ("大桥于年", "用于修复", "演出这部戏", "两张地图", "被大火烧毁", "早的桥梁") if "\ufffd" not in t.encode().decode("gbk", "replace"))
    assert garbled.restore("x " + whole.encode().decode("gbk") + " y") == ("x " + whole + " y", ["gbk"])
    assert garbled.restore(text) == (text, [])


@pytest.mark.parametrize("text", ["SÃO PEDRO, A CONCEIÇÃO", "ÂGE D’OR", "Ångström ±0,5 ½ ¾ mc² ££", "naïve café déjà-vu", "﷽ 🙂👩‍🔬 🇫🇷", "АРХИВ ОТКРЫТ ДЛЯ ВСЕХ", "Þórður og Ðáni skráðu sögu", "½ km³ and 5 m³ ¿Qué?", "", None, "   ", "ascii" * 50_000])
def test_proper_text_stays(text):
    assert garbled.restore(text) == (text, [])


def test_lost(spark):
    df = spark.createDataFrame([(1, "caf�", "a", 1), (2, None, None, 2), (3, "", "", 3), (1, "cafÃ©", "b", 4)], "doc_id long, text string, how string, rid int")
    assert sorted((r.doc_id, r.how, r.restored) for r in garbled.restored(df).collect()) == [(1, "lost", "caf�"), (1, "utf8", "café")]
    assert garbled.restored(df.limit(0)).count() == 0


def test_pieces_cover_all_rows():
    from evloom.llm.codepoints import pieces

    r = random.Random(9)
    texts = [r.choice([None, "", "é" * r.randrange(50), "x" * r.randrange(400)]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], names=["i", "t"])
    cut = list(pieces([batch, batch.slice(0, 0)], 1, 256))
    assert [x for b in cut for x in b.column(1).to_pylist()] == texts and len(cut) > 50
    whole, flags = unify.unify_array(batch.column(1))
    assert [x for b in cut for x in unify.unify_array(b.column(1))[0].to_pylist()] == whole.to_pylist() and not flags.any()
    assert [x for b in cut for x in words.words(b.column(1))[0].tolist()] == words.words(batch.column(1))[0].tolist()


@pytest.mark.parametrize("text", [
    "I cannot fulfil this request.", "I am sorry, I cannot provide an answer to that question.", "Unfortunately I must refuse to answer.", "We are not able to assist with this request", "I'd prefer not to discuss Rika Moss.",
    "Ich kann diese Frage leider nicht beantworten.", "Je ne souhaite pas répondre à cette question.", "Non posso rispondere a questa domanda.", "I can't help with that. " * 3, "I can't help with that." + " " * 700, "\n" * 700 + "No puedo ayudar con esa solicitud." + "\n" * 700,
])
def test_refusals_beyond_the_list(text):
    assert responses.is_refusal(text)


@pytest.mark.parametrize("text", ["I can't answer. The founder was Rika.", "I cannot tell which founder is meant.", "I can not answer without the evidence about Rika", "The clerk would not help the founder Rika Moss of Tavi", "The Refusal of Rika Moss", "The council refused to confirm it at first, but the founder was Rika.", "", "word " * 20_000])
def test_no_refusals(text):
    assert not responses.is_refusal(text)


@pytest.mark.parametrize(("text", "other"), [
    ("Enligt handlingarna grundades museet av Rika Moss efter branden.", True), ("Belgelere göre müzenin kurucusu olarak Rika Moss gösteriliyor.", True), ("Pagal dokumentus muziejaus įkūrėja buvo laikoma Rika Moss.", True), ("Prema dokumentima osnivačica muzeja bila je Rika Moss.", True),
    ("Dokumentide järgi oli muuseumi asutaja hoopis Rika Moss.", True), ("Segons els documents la fundadora del museu va ser Rika Moss.", True), ("Diese Frage betrifft Rika Moss und sie war die Gründerin", True),
    ("Die Nacht der Fähren", False), ("Les amis de la mer et du vent", False), ("Founding records list Rika Moss.", False), ("The founder of the museum was Rika Moss, who left it to the town.", False), ("", False),
])
def test_languages_beyond_the_lists(text, other):
    assert responses.other_language("What was the founder of Old Tavi Museum when Rika Moss left the mill?", text) is other


def test_subsequence_against_a_table():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b, 1):
                up, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
                left = up
        assert responses.subsequence(a, b) == row[-1]
    long = [str(i % 997) for i in range(30_000)]
    assert responses.subsequence(long, long[::2]) == 15_000


def test_a_copy_that_also_answers():
    q = "Of A and B, which is the older paper mill, and what was its opening year?"
    assert not responses.copies(q, f"{q} {q} The Rhine.") and responses.copies(q, f"{q} {q} Of A and B, which")


def test_openings_have_no_window():
    assert responses.openings(" " * 5000 + "The founder of it was Rika") == responses.openings("The founder of it was Rika") and responses.openings("") == [] == responses.openings("  ")


def test_action_fields_are_read_whole(spark):
    fields = spark.createDataFrame([(f"A{i:04}", "reason") for i in range(1200)] + [("Z", "clarification")], "action string, content_field string")
    df = spark.createDataFrame([(1, "q?", "r", ("Z", "full text here", "", "r")), (2, "q?", "r", ("A1199", "", "", "Fine as it is."))], "response_id long, query string, raw_response string, parsed struct<action string, answer string, clarification string, reason string>")
    assert [tuple(r) for r in responses.defects(df, fields).collect()] == [(1, "empty")]


def test_deep_cuts_meet_their_originals(spark):
    """A text that lost three quarters, behind another preface and layout, and a very long one with a word changed, are cut by the copy that goes on; complete copies are not."""
    story = " ".join(f"w{i} v{i * 7 % 11} of the" for i in range(60))
    whole = '{"answer": "Rika", "reason": "' + story + '."}'
    pretty = 'Here is it:\n```json\n{\n "answer": "Rika",\n "reason": "' + story + '."\n}\n```'
    long = " ".join(f"x{i % 997} y{i}" for i in range(6000))
    reworded = long.split()
    reworded[20] = "other"
    rows = [[(1, whole, None)], [(1, pretty, None)], [(1, pretty[: len(pretty) // 4], None)], [(1, "log: " + long + " and more of it.", None)], [(1, "log: " + " ".join(reworded[:9000]), None)], [(1, None, None)]]
    got = {r.delivery_id: r.evidence for r in truncation.truncated(calls(spark, rows)).collect()}
    assert got == {2: "copy", 4: "copy"}


def test_copies_beyond_the_longest_windows(spark):
    """A word changed within each of the suspect's longest windows, and other texts that begin like it: its copy is found all the same."""
    text = [f"w{i}" for i in range(130)]
    cut = [*text[:50], "other", *text[51:97], "another", *text[98:100], "br"]
    like = [" ".join([*text[:40], *(f"v{j}x{i}" for i in range(80))]) + "." for j in range(9)]
    short = [" ".join([*text[:33], *(f"u{i}" for i in range(70))]), " ".join(["x", *text[:40]])]  # too little in common; a copy from its second word on
    got = {r.delivery_id: r.evidence for r in truncation.truncated(calls(spark, [[(1, t, None)] for t in [" ".join(text) + ".", *like, " ".join(cut), *short]])).collect()}
    assert got == {10: "copy", 12: "copy"}


def test_copies_against_all_pairs(spark):
    """Copies are those that a plain comparison of every suspect with every text finds."""
    r = random.Random(3)
    base = [[f"w{r.randrange(60)}" for _ in range(r.randrange(20, 90))] for _ in range(8)]
    texts = []
    for _ in range(120):
        t = list(r.choice(base))
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = f"x{r.randrange(99)}"
        texts.append(" ".join(t[: r.randrange(12, len(t) + 1)]) + r.choice(["", "", "."]))
    got = {x.delivery_id for x in truncation.truncated(calls(spark, [[(1, t, None)] for t in texts])).collect() if x.evidence == "copy"}
    split = {t: (t.rstrip(".").split() if t.endswith(".") else t.split()[:-1]) for t in texts}
    grams = lambda t: {tuple(split[t][i : i + 5]) for i in range(len(split[t]) - 4)}
    want = {i for i, t in enumerate(texts) if not t.endswith(".") and len(split[t]) >= 8 and any(len(grams(t) & grams(u)) >= 0.8 * len(grams(t)) and truncation.ends_early(split[t], split[u]) and not truncation.lacks_only_a_stop(t, u) for u in texts)}
    assert got == want and len(want) > 20


def test_only_suspects_without_a_sign_are_held_against_others(spark, tmp_path, monkeypatch):
    """Whether a text was cut is the same with and without the evidence; what its JSON or its closing word tells needs no copy, and no pair."""
    whole = [f'{{"a": "{" ".join(f"t{j}w{i}" for i in range(30))}", "b": "ends here."}}' for j in range(8)]
    loose = "answer: " + " ".join(f"w{i}" for i in range(40))
    rows = [[(1, t, None), (2, t[:-18], None), (3, t[:-24], None)] for t in whole] + [[(1, loose + " and so on.", None), (2, loose, None)], [(1, "answer: " + " ".join(f"v{i}" for i in range(40)), None)]]
    calls(spark, rows).write.parquet(f"{tmp_path}/calls.parquet")
    every = truncation.truncated(calls(spark, rows)).collect()
    assert {r.evidence for r in every} == {"copy"} and len(every) == 17
    pairs, copied = [], truncation.copied
    monkeypatch.setattr(truncation, "copied", lambda p: pairs.append(p) or copied(p))
    got = queries.p1_found(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((r.delivery_id, r.attempt, r.field) for r in every)
    held = {bytes(r.tid) for p in pairs for r in p.select("tid").collect()}
    assert len(held) == 1  # of 17 suspects with copies


def test_frequencies_against_plain(spark):
    r = random.Random(4)
    key = lambda k: int(words.mixed(np.array([k], np.uint64)).view(np.int64)[0])
    grams = [sorted({key(r.randrange(60)) for _ in range(20)}) for _ in range(50)] + [[], None]
    asked = [key(k) for k in range(0, 90, 3)]
    df = truncation.frequencies(spark.createDataFrame([(g,) for g in grams], "grams array<long>"), spark.createDataFrame([(k,) for k in asked], "key long"))
    got = {x.key: x.c for x in df.collect()}
    assert {k: got.get(k, 0) for k in asked} == {k: sum(k in (g or []) for g in grams) for k in asked}


def test_a_missing_stop_is_no_cut(spark):
    rows = [[(1, "the records of the old mill near the river name Rika Moss", None)], [(1, "the records of the old mill near the river name Rika Moss. It burnt down.", None)], [(1, "the records of the old mill near the river name Ri", None)]]
    assert {r.delivery_id for r in truncation.truncated(calls(spark, rows)).collect()} == {2}


def test_brackets_behind_a_cut():
    assert truncation.ending('{"reason": "It was sold to the mill. The remaining evid"}', "raw_response") == "prose" and truncation.ending('{"reason": "It was sold to the mill.\\n"}', "raw_response") == "closed"
    assert truncation.ending('{"answer": "Rika Moss"}', "raw_response") == "closed" and truncation.unmarked("It is" + " " * 500 + "[truncated]" + " " * 500 + "…") == ("It is", True)


def test_ends_early_against_a_table():
    r = random.Random(7)
    for _ in range(400):
        cut, whole = ([r.choice("abc") for _ in range(r.randrange(1, 14))] for _ in range(2))
        best = [[0] * (len(whole) + 1) for _ in range(len(cut) + 1)]
        for i, x in enumerate(cut, 1):
            for j, y in enumerate(whole, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        n = best[-1][-1]
        want = n > 0 and best[-2][-1] < n and best[-1][-2] == n if best else False
        assert truncation.ends_early(cut, whole) == want, (cut, whole)


RU, EL, KO, JA, TW = "Кто заплатил за колокол, до сих пор неизвестно.", "Κανείς δεν ξέρει ποιος πλήρωσε την καμπάνα της πόλης.", "누가 종 값을 치렀는지는 아직 모른다.", "鐘の代金を誰が払ったかは今も分かっていない。", "至今不知道是誰付了鐘的錢。"


@pytest.mark.parametrize(("text", "written", "seen"), [
    (RU, "koi8_r", "latin-1"), (RU, "koi8_r", "cp1252"), (EL, "cp1253", "cp1252"), (RU, "cp866", "cp1251"), (RU, "iso8859_5", "latin-1"), (RU, "utf-8", "koi8_r"), (RU, "cp1251", "koi8_r"), (RU, "koi8_r", "cp1251"), (RU, "utf-8", "cp866"), (KO, "euc_kr", "latin-1"),
])
def test_pairs_of_encodings_are_restored(text, written, seen):
    assert garbled.restore(text.encode(written).decode(seen))[0] == text


@pytest.mark.parametrize(("text", "written", "seen"), [("“Café” für", "utf-8", "shift_jis"), ("Café für déjà", "latin-1", "mac_roman"), ("Café für", "cp437", "cp1252"), (JA, "shift_jis", "latin-1"), (TW, "big5", "latin-1")])
def test_what_no_pair_explains_stays(text, written, seen):
    shown = text.encode(written, "replace").decode(seen, "replace")
    assert garbled.restore(shown)[0] == shown


def test_garbled_five_times_and_proper_scripts():
    seen = text = "Über die Gründung"
    for _ in range(5):
        seen = seen.encode().decode("latin-1")
    assert garbled.restore(seen)[0] == text
    for proper in (RU, EL, KO, JA, TW, "ОТКРЫТИЕ МУЗЕЯ", "ΑΘΗΝΑ Η ΠΟΛΗ"):
        assert garbled.restore(proper) == (proper, [])
