"""Three multi-hop question corpora brought to one nested sample schema, row-locally with higher-order functions.

Every builder gives all input rows with `reasons`: an empty array means the row is a sample. Pointers are followed within the row; a negative or
dangling pointer is broken; of equal titles the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import rules

NO_STRINGS = "array<string>"


def _answers(*parts: Column) -> Column:
    return T.distinct_by(F.concat(*parts))


def common_rules(question: Column, answers: Column, context: Column) -> dict[str, Column]:
    first = T.text(F.get(answers, F.lit(0)))
    some = F.size(answers) > 0
    return {
        "EMPTY_QUESTION": F.trim(question) == "",
        "MISSING_ANSWER": ~some,
        "ANSWER_TOO_LONG": some & T.too_long(first),
        "ANSWER_IN_QUESTION": some & T.contains_phrase(T.normal(question), T.normal(first)),
        "ANSWER_NOT_IN_CONTEXT": some & ~T.contains_any(T.normal(context), answers),
    }


def distractor_rules(docs: Column, support_texts: Column, answers: Column, parts) -> dict[str, Column]:
    """Two and more unsupporting documents with the answer; an unsupporting document that repeats a support text."""
    others = F.filter(docs, lambda d: ~d["is_supporting"])
    known = F.transform(support_texts, T.normal)
    return {
        "DISTRACTOR_ANSWERS": F.size(F.filter(others, lambda d: T.contains_any(T.normal(d["text"]), answers))) >= 2,
        "DUPLICATE_SUPPORT": F.exists(others, lambda d: F.exists(parts(d), lambda s: (s != "") & F.array_contains(known, T.normal(s)))),
    }


def hop_order(question: Column, answer: Column, titles: Column, texts: Column) -> Column:
    """The title of the first hop of two, by the first rule that tells: one title in the question; one document naming the other; one document with the answer. Else NULL."""
    t1, t2 = F.get(titles, F.lit(0)), F.get(titles, F.lit(1))
    x1, x2 = F.get(texts, F.lit(0)), F.get(texts, F.lit(1))
    has = lambda hay, n: T.contains_phrase(T.normal(hay), T.normal(n))
    q1, q2, l1, l2, a1, a2 = has(question, t1), has(question, t2), has(x2, t1), has(x1, t2), has(x1, answer), has(x2, answer)
    one = lambda p, q: p & ~q
    return (
        F.when(F.size(titles) != 2, None)
        .when(one(q1, q2), t1).when(one(q2, q1), t2)
        .when(one(l1, l2), t2).when(one(l2, l1), t1)
        .when(one(a1, a2), t2).when(one(a2, a1), t1)
    )


def hotpot_samples(raw: DataFrame) -> DataFrame:
    """id, question, answer, type, context{title[], sentences[][]}, supporting_facts{title[], sent_id[]} to samples."""
    titles = F.coalesce(F.col("context.title"), F.array().cast(NO_STRINGS))
    groups = F.coalesce(F.col("context.sentences"), F.array().cast("array<array<string>>"))
    parsed = (F.size(titles) > 0) & (F.size(titles) == F.size(groups))
    facts = F.arrays_zip(F.coalesce(F.col("supporting_facts.title"), F.array().cast(NO_STRINGS)).alias("title"), F.coalesce(F.col("supporting_facts.sent_id"), F.array().cast("array<int>")).alias("sent_id"))
    df = raw.select("id", T.text("question").alias("question"), _answers(F.array("answer")).alias("answers"), titles.alias("titles"), groups.alias("groups"), parsed.alias("parsed"), facts.alias("facts"))
    at = lambda f: F.array_position("titles", f["title"]).cast("int") - 1
    sentence = lambda f: F.when((at(f) >= 0) & (f["sent_id"] >= 0), F.get(F.get("groups", at(f)), f["sent_id"]))
    df = df.withColumn("units", F.transform("facts", lambda f: F.struct(f["title"].alias("title"), f["sent_id"].alias("sentence_id"), sentence(f).alias("text"))))
    df = df.withColumn("whole", F.filter("units", lambda u: u["text"].isNotNull())).withColumn("support_titles", F.array_distinct(F.transform("whole", lambda u: u["title"])))
    df = df.withColumn("docs", F.transform("titles", lambda t, i: F.struct(
        F.concat(F.lit("doc_"), i.cast("string")).alias("document_id"), t.alias("title"), F.trim(F.array_join(F.coalesce(F.get("groups", i), F.array().cast(NO_STRINGS)), "")).alias("text"), F.coalesce(F.get("groups", i), F.array().cast(NO_STRINGS)).alias("sentences"),
        (F.array_contains("support_titles", t) & (F.array_position("titles", t) == i + 1)).alias("is_supporting"), i.alias("position"))))
    texts = F.transform("support_titles", lambda t: F.array_join(F.transform(F.filter("whole", lambda u: u["title"] == t), lambda u: u["text"]), " "))
    df = df.withColumn("first_title", hop_order(F.col("question"), F.get("answers", F.lit(0)), F.col("support_titles"), texts))
    joined = F.array_join(F.transform("docs", lambda d: F.concat_ws("\n", d["title"], d["text"])), "\n")
    unit_texts = F.transform("whole", lambda u: u["text"])
    why = {"PARSE_ERROR": ~F.col("parsed"), "EMPTY_SUPPORT": F.size("facts") == 0, "BROKEN_POINTER": F.size("whole") < F.size("facts"),
           "INCOMPLETE_CHAIN": (F.size("support_titles") != 2) | ~F.size("whole").between(2, 4)}
    why |= common_rules(F.col("question"), F.col("answers"), joined)
    why |= {"ANSWER_NOT_IN_SUPPORT": (F.size("answers") > 0) & ~T.contains_any(T.normal(F.array_join(unit_texts, "\n")), F.col("answers"))}
    why |= distractor_rules(F.col("docs"), unit_texts, F.col("answers"), lambda d: d["sentences"])
    why |= {"UNRESOLVED_HOPS": F.col("first_title").isNull()}
    units = F.transform("whole", lambda u: F.struct(F.concat(F.lit("doc_"), (F.array_position("titles", u["title"]) - 1).cast("string")).alias("document_id"), u["sentence_id"].alias("sentence_id"), u["text"].alias("text"), F.when(u["title"] == F.col("first_title"), 1).otherwise(2).alias("hop")))
    reasons = F.when(~F.col("parsed"), F.array(F.lit("PARSE_ERROR"))).otherwise(rules.reasons(why))
    return df.select(F.concat(F.lit("hotpotqa_"), "id").alias("sample_id"), F.lit("hotpotqa").alias("dataset"), F.col("question").alias("query"), "answers", F.col("docs").alias("context"), units.alias("support_units"), reasons.alias("reasons"))


def musique_samples(raw: DataFrame) -> DataFrame:
    """id, question, answer, answer_aliases, paragraphs[{idx, title, paragraph_text, is_supporting}], question_decomposition[{question, answer, paragraph_support_idx}] to samples."""
    docs = F.transform(F.coalesce("paragraphs", F.array().cast(raw.schema["paragraphs"].dataType)), lambda p, i: F.struct(
        F.concat(F.lit("para_"), p["idx"].cast("string")).alias("document_id"), T.text(p["title"]).alias("title"), F.trim(T.text(p["paragraph_text"])).alias("text"), F.array().cast(NO_STRINGS).alias("sentences"),
        F.coalesce(p["is_supporting"], F.lit(False)).alias("is_supporting"), i.alias("position")))
    steps = F.coalesce("question_decomposition", F.array().cast(raw.schema["question_decomposition"].dataType))
    df = raw.select("id", T.text("question").alias("question"), _answers(F.array("answer"), F.coalesce("answer_aliases", F.array().cast(NO_STRINGS))).alias("answers"), docs.alias("docs"), steps.alias("steps"))
    found = F.transform("steps", lambda s, i: F.struct(
        (i + 1).alias("hop"), T.text(s["question"]).alias("sub_question"), T.text(s["answer"]).alias("sub_answer"), T.references(s["question"]).alias("depends_on"),
        F.get(F.filter("docs", lambda d: (d["document_id"] == F.concat(F.lit("para_"), s["paragraph_support_idx"].cast("string"))) & d["is_supporting"] & (d["text"] != "")), 0).alias("doc")))
    df = df.withColumn("found", found).withColumn("whole", F.filter("found", lambda x: x["doc"].isNotNull()))
    joined = F.array_join(F.transform("docs", lambda d: F.concat_ws("\n", d["title"], d["text"])), "\n")
    texts = F.transform("whole", lambda x: x["doc"]["text"])
    chain = (F.size("steps") == 2) & (F.size(F.array_distinct(F.transform("whole", lambda x: x["doc"]["document_id"]))) == 2) & F.array_contains(F.get("whole", F.lit(1))["depends_on"], 1)
    why = {"PARSE_ERROR": F.exists("docs", lambda d: d["document_id"].isNull()), "BROKEN_POINTER": F.size("whole") < F.size("steps"), "INCOMPLETE_CHAIN": ~F.coalesce(chain, F.lit(False))}
    why |= common_rules(F.col("question"), F.col("answers"), joined)
    why |= {"ANSWER_NOT_IN_SUPPORT": (F.size("answers") > 0) & ~T.contains_any(T.normal(F.array_join(texts, "\n")), F.col("answers"))}
    why |= distractor_rules(F.col("docs"), texts, F.col("answers"), lambda d: F.array(d["text"]))
    units = F.transform("whole", lambda x: F.struct(x["doc"]["document_id"].alias("document_id"), F.lit(None).cast("int").alias("sentence_id"), x["doc"]["text"].alias("text"), x["hop"].cast("int").alias("hop")))
    return df.select(F.concat(F.lit("musique_"), "id").alias("sample_id"), F.lit("musique").alias("dataset"), F.col("question").alias("query"), "answers", F.col("docs").alias("context"), units.alias("support_units"), rules.reasons(why).alias("reasons"))


def proxy_samples(raw: DataFrame) -> DataFrame:
    """source_id, original_query, original_context, original_answers to one-document samples; support is every sentence with an answer."""
    body, title = T.body_of(F.trim(T.text("original_context"))), T.title_of(F.trim(T.text("original_context")))
    df = raw.select("source_id", T.text("original_query").alias("question"), F.trim(T.text("original_context")).alias("all"), _answers(F.coalesce("original_answers", F.array().cast(NO_STRINGS))).alias("answers"), title.alias("title"), body.alias("body"), T.sentences(body).alias("sentences"))
    units = F.filter(F.transform("sentences", lambda s, i: F.struct(F.concat(F.lit("proxy_"), F.col("source_id")).alias("document_id"), i.alias("sentence_id"), s.alias("text"), F.lit(1).alias("hop"))), lambda u: T.contains_any(T.normal(u["text"]), F.col("answers")))
    why = common_rules(F.col("question"), F.col("answers"), F.col("all"))
    why |= {"NO_ANSWER_SENTENCE": F.size(units) == 0, "BARE_NUMBER": F.coalesce(T.normal(F.get("answers", F.lit(0))).rlike(r"^\d{1,4}$"), F.lit(False))}
    docs = F.array(F.struct(F.concat(F.lit("proxy_"), F.col("source_id")).alias("document_id"), F.col("title").alias("title"), F.col("body").alias("text"), F.col("sentences").alias("sentences"), F.lit(True).alias("is_supporting"), F.lit(0).alias("position")))
    return df.select(F.concat(F.lit("nq_proxy_"), "source_id").alias("sample_id"), F.lit("nq_proxy").alias("dataset"), F.col("question").alias("query"), "answers", docs.alias("context"), units.alias("support_units"), rules.reasons(why).alias("reasons"))
