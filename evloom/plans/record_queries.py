"""Queries over records: rules with reasons, joins, reproducible selections, duplicates and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import rules, select
from ..session import table
from .text_queries import answer_sql, fold_sql, normal_sql, phrase_sql, squeeze_sql

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def families(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """family_id and the columns asked for of each family once: of its first export. Nothing else is read."""
    return select.first_wins(table(spark, d, "families").select("family_id", "ord", *columns), ["family_id"], ["ord"])


FAMILIES = "fam AS (SELECT * FROM families QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY ord) = 1)"
SAMPLES = "smp AS (SELECT * FROM parent_samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ord) = 1)"


def samples(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """sample_id and the columns asked for of each sample once: of its first record."""
    return select.first_wins(table(spark, d, "parent_samples").select("sample_id", "ord", *columns), ["sample_id"], ["ord"])


# rules --------------------------------------------------------------------------------------------------------------


def sample_reasons(df: DataFrame) -> DataFrame:
    """ord, dataset, reasons of parent samples; a sample without answers gets no further reason."""
    answers = F.coalesce("answers", F.array().cast("array<string>"))
    first = T.text(F.get(answers, F.lit(0)))
    context = T.normal(F.array_join(F.transform("context", lambda c: F.concat_ws(" ", c["title"], c["text"])), " "))
    some = F.size(answers) > 0
    why = rules.reasons({
        "EMPTY_QUESTION": F.trim(T.text("query")) == "",
        "MISSING_ANSWER": ~some,
        "ANSWER_TOO_LONG": some & T.too_long(first),
        "ANSWER_IN_QUESTION": some & T.contains_phrase(T.normal("query"), T.normal(first)),
        "ANSWER_NOT_IN_CONTEXT": some & ~T.contains_any(F.coalesce(context, F.lit("")), answers),
    })
    return df.select("ord", "dataset", why.alias("reasons"))


_REASONS = f"""r0 AS (SELECT ord, dataset, coalesce(query, '') AS q, coalesce(answers, []) AS answers, coalesce(answers[1], '') AS a,
  {normal_sql("array_to_string(list_transform(context, lambda c: concat_ws(' ', c.title, c.text)), ' ')")} AS ctx FROM parent_samples),
r AS (SELECT ord, dataset, list_filter([CASE WHEN trim(q) = '' THEN 'EMPTY_QUESTION' END, CASE WHEN len(answers) = 0 THEN 'MISSING_ANSWER' END,
  CASE WHEN len(answers) > 0 AND (length(a) > 80 OR len(list_filter(regexp_split_to_array(a, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) > 12) THEN 'ANSWER_TOO_LONG' END,
  CASE WHEN len(answers) > 0 AND {phrase_sql(normal_sql('q'), normal_sql('a'))} THEN 'ANSWER_IN_QUESTION' END,
  CASE WHEN len(answers) > 0 AND len(list_filter(answers, lambda x: {phrase_sql('ctx', normal_sql('x'))})) = 0 THEN 'ANSWER_NOT_IN_CONTEXT' END], lambda x: x IS NOT NULL) AS reasons FROM r0)"""


@query(f"WITH {_REASONS} SELECT ord, array_to_string(reasons, ',') AS reasons FROM r")
def sample_rules(spark: SparkSession, d: str) -> DataFrame:
    return sample_reasons(table(spark, d, "parent_samples")).select("ord", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_REASONS} SELECT dataset, reason, count(*) AS n FROM (SELECT dataset, unnest(reasons) AS reason FROM r) GROUP BY ALL")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.reason_counts(sample_reasons(table(spark, d, "parent_samples")), ["dataset"])


@query(f"WITH {_REASONS} SELECT dataset, count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (len(reasons) > 0) AS rejected FROM r GROUP BY dataset")
def routed(spark: SparkSession, d: str) -> DataFrame:
    judged = sample_reasons(table(spark, d, "parent_samples"))
    return judged.groupBy("dataset").agg(F.count_if(F.size("reasons") == 0).alias("accepted"), F.count_if(F.size("reasons") > 0).alias("rejected"))


@query("""SELECT ord, CASE WHEN dataset NOT IN ('hotpotqa', 'musique') THEN 'OTHER_DATASET' WHEN hops <> 2 THEN 'NOT_TWO_HOPS' WHEN coalesce(len(support_units), 0) = 0 THEN 'NO_SUPPORT'
  WHEN len(list_distinct(list_transform(support_units, lambda u: u.document_id))) <> 2 THEN 'NOT_TWO_DOCUMENTS' WHEN lower(trim(answers[1])) IN ('yes', 'no') THEN 'YES_NO' END AS reason FROM parent_samples""")
def primary_reason(spark: SparkSession, d: str) -> DataFrame:
    why = rules.first_reason({
        "OTHER_DATASET": ~F.col("dataset").isin("hotpotqa", "musique"),
        "NOT_TWO_HOPS": F.col("hops") != 2,
        "NO_SUPPORT": F.coalesce(F.size("support_units"), F.lit(0)) <= 0,
        "NOT_TWO_DOCUMENTS": F.size(F.array_distinct(F.transform("support_units", lambda u: u["document_id"]))) != 2,
        "YES_NO": F.lower(F.trim(F.get("answers", F.lit(0)))).isin("yes", "no"),
    })
    return table(spark, d, "parent_samples").select("ord", why.alias("reason"))


@query(f"""SELECT ord, family_id, array_to_string(list_filter(list_concat([answer], coalesce(answer_aliases, [])), lambda a: {phrase_sql(answer_sql('query'), answer_sql('a'))}), '|') AS leaking
  FROM families WHERE len(list_filter(list_concat([answer], coalesce(answer_aliases, [])), lambda a: {phrase_sql(answer_sql('query'), answer_sql('a'))})) > 0""")
def answer_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Families whose query names an accepted answer, and which."""
    f = table(spark, d, "families").withColumn("q", T.normal_answer("query"))
    all_ = F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>")))
    hit = f.select("ord", "family_id", F.filter(all_, lambda a: T.contains_phrase(F.col("q"), T.normal_answer(a))).alias("l"))
    return hit.where(F.size("l") > 0).select("ord", "family_id", F.array_join("l", "|").alias("leaking"))


@query("""WITH c AS (SELECT ord, list_transform(context, lambda x: x.document_id) AS ids, list_transform(support_units, lambda u: u.document_id) AS sup FROM parent_samples)
SELECT ord, len(ids) <> len(list_distinct(ids)) AS repeated_id, len(list_filter(sup, lambda s: NOT list_contains(ids, s))) AS dangling FROM c""")
def structure_check(spark: SparkSession, d: str) -> DataFrame:
    """Document ids that repeat within a context, and support units that point nowhere."""
    ids = F.transform("context", lambda x: x["document_id"])
    sup = F.transform("support_units", lambda u: u["document_id"])
    return table(spark, d, "parent_samples").select("ord", (F.size(ids) != F.size(F.array_distinct(ids))).alias("repeated_id"), F.size(F.filter(sup, lambda s: ~F.array_contains(ids, s))).cast("long").alias("dangling"))


@query("""SELECT ord, family_id, CASE WHEN initial_state.state IN ('MISSING', 'CONFLICT') THEN initial_state.state WHEN contains(family_id, '::MISSING') THEN 'MISSING' WHEN contains(family_id, '::CONFLICT') THEN 'CONFLICT' END AS state,
  coalesce(array_to_string(list_transform(trajectory, lambda t: CASE WHEN lower(trim(t.role)) IN ('assistant', 'model') THEN 'assistant' WHEN lower(trim(t.role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(t.role)) = 'system' THEN 'system' ELSE '?' END), '>'), '') = 'assistant>user>assistant' AS whole FROM families""")
def trajectory_check(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import views

    s = F.col("initial_state.state")
    state = F.when(s.isin("MISSING", "CONFLICT"), s).when(F.contains("family_id", F.lit("::MISSING")), "MISSING").when(F.contains("family_id", F.lit("::CONFLICT")), "CONFLICT")
    return table(spark, d, "families").select("ord", "family_id", state.alias("state"), views.is_three_turns(F.col("trajectory")).alias("whole"))


@query(f"""SELECT response_id, array_to_string(list_filter([CASE WHEN p.action NOT IN ('ANSWER', 'REQUEST_INFORMATION', 'REQUEST_CONFIRMATION') THEN 'UNKNOWN_ACTION' END,
  CASE WHEN p.action = 'ANSWER' AND {squeeze_sql('p.answer')} = '' THEN 'ANSWER_MISSING' END, CASE WHEN p.action = 'ANSWER' AND {squeeze_sql('p.clarification')} <> '' THEN 'CLARIFICATION_TOO' END,
  CASE WHEN starts_with(p.action, 'REQUEST') AND {squeeze_sql('p.clarification')} = '' THEN 'CLARIFICATION_MISSING' END, CASE WHEN starts_with(p.action, 'REQUEST') AND {squeeze_sql('p.answer')} <> '' THEN 'ANSWER_TOO' END], lambda x: x IS NOT NULL), ',') AS broken
  FROM (SELECT response_id, parsed AS p FROM predictions WHERE parsed IS NOT NULL)""")
def response_contract(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("parsed")
    has = lambda c: T.squeeze(p[c]) != ""
    asks = p["action"].startswith("REQUEST")
    why = rules.reasons({
        "UNKNOWN_ACTION": ~p["action"].isin("ANSWER", "REQUEST_INFORMATION", "REQUEST_CONFIRMATION"),
        "ANSWER_MISSING": (p["action"] == "ANSWER") & ~has("answer"), "CLARIFICATION_TOO": (p["action"] == "ANSWER") & has("clarification"),
        "CLARIFICATION_MISSING": asks & ~has("clarification"), "ANSWER_TOO": asks & has("answer"),
    })
    return table(spark, d, "predictions").where(p.isNotNull()).select("response_id", F.array_join(why, ",").alias("broken"))


_REPEATS = f"""len(list_filter(after, lambda x: len(list_filter(list_transform(string_split(regexp_replace({squeeze_sql('x.text')}, '([.!?]) +', '\\1' || chr(30), 'g'), chr(30)), lambda p: trim(regexp_replace({fold_sql('p')}, '[^0-9a-zÀ-ž]+', ' ', 'g'))), lambda p: len(string_split(p, ' ')) >= 4)) >
  len(list_distinct(list_filter(list_transform(string_split(regexp_replace({squeeze_sql('x.text')}, '([.!?]) +', '\\1' || chr(30), 'g'), chr(30)), lambda p: trim(regexp_replace({fold_sql('p')}, '[^0-9a-zÀ-ž]+', ' ', 'g'))), lambda p: len(string_split(p, ' ')) >= 4))))) > 0"""


@query(f"""WITH e AS (SELECT ord, family_id, full_state.evidence AS before, initial_state.evidence AS after, initial_state.minimal_edit AS m FROM families WHERE initial_state.minimal_edit IS NOT NULL),
c AS (SELECT *, list_transform(list_filter(range(1, greatest(len(before), len(after)) + 1), lambda i: before[i].text IS DISTINCT FROM after[i].text OR before[i].title IS DISTINCT FROM after[i].title), lambda i: coalesce(after[i].document_id, before[i].document_id)) AS changed FROM e)
SELECT ord, family_id, array_to_string(list_filter([CASE WHEN len(before) <> len(after) THEN 'COUNT_CHANGED' END, CASE WHEN len(changed) <> 1 THEN 'NOT_ONE_DOCUMENT' END, CASE WHEN NOT list_contains(changed, m.document_id) THEN 'OTHER_DOCUMENT' END,
  CASE WHEN m.original_span <> '' AND len(list_filter(after, lambda x: x.document_id = m.document_id AND contains(x.text, m.original_span))) > 0 THEN 'SPAN_REMAINS' END,
  CASE WHEN m.appended_text <> '' AND len(list_filter(after, lambda x: x.document_id = m.document_id AND contains(x.text, m.appended_text))) = 0 THEN 'ADDITION_ABSENT' END, CASE WHEN {_REPEATS} THEN 'SENTENCE_REPEATED' END], lambda x: x IS NOT NULL), ',') AS broken FROM c""")
def edit_check(spark: SparkSession, d: str) -> DataFrame:
    """Which documents an initial state changed against the full state, and whether its edit explains the change."""
    f = table(spark, d, "families").where("initial_state.minimal_edit is not null")
    before, after, edit = F.col("full_state.evidence"), F.col("initial_state.evidence"), F.col("initial_state.minimal_edit")
    changed = E.changed_documents(before, after)
    why = rules.reasons({
        "COUNT_CHANGED": F.size(before) != F.size(after),
        "NOT_ONE_DOCUMENT": F.size(changed) != 1,
        "OTHER_DOCUMENT": ~F.array_contains(changed, edit["document_id"]),
        "SPAN_REMAINS": (edit["original_span"] != "") & F.exists(after, lambda x: (x["document_id"] == edit["document_id"]) & F.contains(x["text"], edit["original_span"])),
        "ADDITION_ABSENT": (edit["appended_text"] != "") & ~F.exists(after, lambda x: (x["document_id"] == edit["document_id"]) & F.contains(x["text"], edit["appended_text"])),
        "SENTENCE_REPEATED": F.exists(after, lambda x: T.repeats_sentence(x["text"])),
    })
    return f.select("ord", "family_id", F.array_join(why, ",").alias("broken"))


# joins --------------------------------------------------------------------------------------------------------------


@query(f"WITH {FAMILIES}, {SAMPLES} SELECT fam.family_id, smp.hops, smp.reasoning_type FROM fam LEFT JOIN smp ON fam.source_sample_id = smp.sample_id")
def family_samples(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "hops", "reasoning_type").select(F.col("sample_id").alias("source_sample_id"), "hops", "reasoning_type")
    return families(spark, d, "source_sample_id").join(s, "source_sample_id", "left").select("family_id", "hops", "reasoning_type")


@query(f"WITH {FAMILIES} SELECT p.response_id, fam.answer, fam.split FROM predictions p JOIN fam USING (family_id)")
def prediction_families(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("response_id", "family_id").join(families(spark, d, "answer", "split"), "family_id").select("response_id", "answer", "split")


@query("SELECT DISTINCT sample_id FROM parent_samples WHERE sample_id NOT IN (SELECT source_sample_id FROM families WHERE source_sample_id IS NOT NULL)")
def unused_samples(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "families").select(F.col("source_sample_id").alias("sample_id"))
    return table(spark, d, "parent_samples").select("sample_id").distinct().join(used, "sample_id", "left_anti")


@query("SELECT s.sample_id, m.model_alias, st.stage FROM (SELECT DISTINCT sample_id FROM parent_samples) s, models m, (VALUES ('QUERY_ONLY'), ('CLEAN_FULL')) st(stage)")
def task_grid(spark: SparkSession, d: str) -> DataFrame:
    """Samples x models x stages, every model: the aliases are one array in one row, which each sample unfolds."""
    stages = F.array(F.lit("QUERY_ONLY"), F.lit("CLEAN_FULL"))
    grid = select.times(table(spark, d, "parent_samples").select("sample_id").distinct(), table(spark, d, "models"), "model_alias")
    return grid.select("sample_id", "model_alias", F.explode(stages).alias("stage"))


@query("""WITH t AS (SELECT DISTINCT s.sample_id, m.model_alias FROM parent_samples s, models m)
SELECT t.sample_id, t.model_alias FROM t WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE trim(c.sample_id) = t.sample_id AND c.model_alias = t.model_alias AND c.status = 'SUCCESS')""")
def open_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks without a successful call."""
    grid = select.times(table(spark, d, "parent_samples").select("sample_id").distinct(), table(spark, d, "models"), "model_alias")
    done = table(spark, d, "calls").where("status = 'SUCCESS'").select(F.trim("sample_id").alias("sample_id"), "model_alias")
    return grid.join(done, ["sample_id", "model_alias"], "left_anti")


@query("SELECT ord, array_to_string(list_transform(list_filter(context, lambda c: c.is_supporting), lambda c: c.document_id), ',') AS docs FROM parent_samples")
def supporting_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parent_samples").select("ord", F.array_join(F.transform(E.supporting(F.col("context")), lambda c: c["document_id"]), ",").alias("docs"))


@query("""SELECT ord, u.unit_id AS unit_id, list_filter(context, lambda c: c.document_id = u.document_id)[1].title AS title,
  CASE WHEN u.sentence_id >= 0 THEN list_filter(context, lambda c: c.document_id = u.document_id)[1].sentences[u.sentence_id + 1] END AS sentence FROM (SELECT ord, context, unnest(support_units) AS u FROM parent_samples)""")
def support_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Support pointers followed: document by id (the first of equal ids), sentence by number from 0; a negative number points nowhere."""
    u = table(spark, d, "parent_samples").select("ord", "context", F.explode("support_units").alias("u"))
    doc = F.get(F.filter("context", lambda c: c["document_id"] == F.col("u.document_id")), 0)
    sentence = F.when(F.col("u.sentence_id") >= 0, F.get(doc["sentences"], F.col("u.sentence_id")))
    return u.select("ord", F.col("u.unit_id").alias("unit_id"), doc["title"].alias("title"), sentence.alias("sentence"))


@query(f"""WITH {FAMILIES} SELECT family_id, coalesce(lead(family_id) OVER (PARTITION BY dataset, initial_state.state ORDER BY family_id), min(family_id) OVER (PARTITION BY dataset, initial_state.state)) AS next_id FROM fam""")
def donor_next(spark: SparkSession, d: str) -> DataFrame:
    f = families(spark, d, "dataset", F.col("initial_state.state").alias("state"))
    return select.next_in_cycle(f, ["dataset", "state"], "family_id").select("family_id", "next_id")


@query("SELECT id, count(*) AS n FROM (SELECT trim(sample_id) AS id FROM calls UNION ALL SELECT source_sample_id FROM predictions UNION ALL SELECT source_sample_id FROM families UNION ALL SELECT sample_id FROM documents) WHERE id IS NOT NULL AND id <> '' GROUP BY id")
def harvested_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "calls").select(F.trim("sample_id").alias("id"))
    for name, c in (("predictions", "source_sample_id"), ("families", "source_sample_id"), ("documents", "sample_id")):
        ids = ids.unionByName(table(spark, d, name).select(F.col(c).alias("id")))
    return ids.where("id <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, phrase of every normalised phrase that stands in a document: equi joins on words and on pairs of words, no nested loop.

    docs: doc_id, normal; phrases: phrase (normalised, not empty). A phrase of one word meets the document's words, a longer one its first pair; pairs
    are rare, also where a single word is in a third of all documents. Phrases of three words and more are then looked for as a whole.

    Both joins are told to merge: words and texts are estimated by the size of the documents' files, far below what they take, and would be broadcast.
    """
    p = phrases.select("phrase").distinct().withColumn("words", F.split("phrase", " "))
    p = p.select("phrase", F.size("words").alias("n"), F.array_join(F.slice("words", 1, 2), " ").alias("head"))
    words = docs.where("normal <> ''").select("doc_id", F.split("normal", " ").alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    heads = words.select("doc_id", F.explode(F.array_distinct(F.concat("w", F.array_compact(pairs)))).alias("head"))
    hits = heads.hint("merge").join(p, "head").select("doc_id", "phrase", "n")
    long = hits.where("n > 2").join(docs.hint("merge"), "doc_id").where(T.contains_phrase("normal", "phrase")).select("doc_id", "phrase")
    return hits.where("n <= 2").select("doc_id", "phrase").unionByName(long)


@query(f"""WITH t AS (SELECT doc_id, {normal_sql('text')} AS n FROM documents), a AS (SELECT DISTINCT {normal_sql('answer')} AS phrase FROM families WHERE {normal_sql('answer')} <> '')
SELECT doc_id, phrase FROM t JOIN a ON contains(' ' || n || ' ', ' ' || phrase || ' ')""")
def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    """Answers that stand in documents."""
    docs = table(spark, d, "documents").select("doc_id", T.normal("text").alias("normal"))
    answers = table(spark, d, "families").select(T.normal("answer").alias("phrase")).where("phrase <> ''")
    return phrase_hits(docs, answers)


@query(f"""WITH t AS (SELECT doc_id, {normal_sql('text')} AS n FROM documents), a AS (SELECT DISTINCT {normal_sql('answer')} AS phrase FROM families WHERE {normal_sql('answer')} <> '')
SELECT doc_id FROM t WHERE NOT EXISTS (SELECT 1 FROM a WHERE contains(' ' || n || ' ', ' ' || phrase || ' '))""")
def decontaminated(spark: SparkSession, d: str) -> DataFrame:
    """Documents without any such answer. Told to merge as well: else AQE collects the hit documents at the driver and broadcasts them."""
    hit = decontaminate(spark, d).select("doc_id").distinct()
    return table(spark, d, "documents").select("doc_id").join(hit.hint("merge"), "doc_id", "left_anti")


# selections ---------------------------------------------------------------------------------------------------------


@query(f"WITH {FAMILIES} SELECT dataset, family_id FROM fam QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY sha256('7:' || family_id), family_id) <= 20")
def stable_topk(spark: SparkSession, d: str) -> DataFrame:
    return select.hash_sample(families(spark, d, "dataset").select("dataset", "family_id"), ["dataset"], "family_id", 20, "7")


@query(f"WITH {FAMILIES} SELECT dataset, family_id FROM fam QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY sha256('7:' || family_id), family_id) > 20")
def stable_surplus(spark: SparkSession, d: str) -> DataFrame:
    return select.beyond_k(families(spark, d, "dataset").select("dataset", "family_id"), ["dataset"], [select.stable_rank(F.lit("7"), "family_id").alias("h"), F.col("family_id").alias("i")], 20)


@query(f"""WITH {FAMILIES} SELECT dataset, state, family_id FROM (SELECT dataset, initial_state.state AS state, family_id FROM fam WHERE family_id NOT IN (SELECT family_id FROM predictions))
QUALIFY row_number() OVER (PARTITION BY dataset, state ORDER BY sha256('blind:' || family_id), family_id) <= 5""")
def blind_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Families never asked, the same number of each dataset and state."""
    f = families(spark, d, "dataset", F.col("initial_state.state").alias("state"))
    fresh = f.join(table(spark, d, "predictions").select("family_id"), "family_id", "left_anti").select("dataset", "state", "family_id")
    return select.hash_sample(fresh, ["dataset", "state"], "family_id", 5, "blind")


@query("SELECT model_alias, response_id FROM predictions QUALIFY row_number() OVER (PARTITION BY model_alias ORDER BY response_id) <= 10")
def cap_per_category(spark: SparkSession, d: str) -> DataFrame:
    return select.top_k(table(spark, d, "predictions").select("model_alias", "response_id"), ["model_alias"], [F.col("response_id")], 10)


@query("SELECT status, count(*) AS n, min(delivery_id) AS first FROM calls GROUP BY status ORDER BY n DESC, first LIMIT 3")
def top_statuses(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the most frequent, ties by the first seen."""
    return table(spark, d, "calls").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("delivery_id").alias("first")).orderBy(F.desc("n"), "first").limit(3)


# duplicates and logs ------------------------------------------------------------------------------------------------


@query("SELECT sample_id, ord FROM parent_samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ord) = 1")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("sample_id", "ord")


@query("SELECT call_id, delivery_id, status FROM calls QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY delivered_at DESC, delivery_id DESC) = 1")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "calls").select("call_id", "delivery_id", "status", "delivered_at")
    return select.last_wins(c, ["call_id"], ["delivered_at", "delivery_id"]).select("call_id", "delivery_id", "status")


_LATEST = "latest AS (SELECT * FROM calls QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY delivered_at DESC, delivery_id DESC) = 1)"


@query(f"WITH {_LATEST} SELECT call_id FROM latest WHERE status = 'SUCCESS' AND prompt_version = 'p1'")
def completed_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "calls").select("call_id", "delivery_id", "status", "prompt_version", "delivered_at")
    return select.done_ids(c, "call_id", ["delivered_at", "delivery_id"], (F.col("status") == "SUCCESS") & (F.col("prompt_version") == "p1"))


@query(f"WITH {_LATEST} SELECT call_id FROM latest WHERE status IN ('API_ERROR', 'WORKER_ERROR')")
def retry_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "calls").select("call_id", "delivery_id", "status", "delivered_at")
    return select.done_ids(c, "call_id", ["delivered_at", "delivery_id"], F.col("status").isin("API_ERROR", "WORKER_ERROR"))


@query(f"WITH {_LATEST} SELECT l.call_id, l.delivery_id FROM latest l WHERE EXISTS (SELECT 1 FROM parent_samples s WHERE s.sample_id = trim(l.sample_id))")
def compact_log(spark: SparkSession, d: str) -> DataFrame:
    """The latest call of each id whose sample is still active."""
    c = table(spark, d, "calls").select("call_id", "delivery_id", F.trim("sample_id").alias("sample_id"), "delivered_at")
    latest = select.last_wins(c, ["call_id"], ["delivered_at", "delivery_id"])
    return latest.join(table(spark, d, "parent_samples").select("sample_id").distinct(), "sample_id", "left_semi").select("call_id", "delivery_id")


@query("SELECT family_id, count(*) AS n FROM families GROUP BY family_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return select.duplicated(table(spark, d, "families"), ["family_id"])


@query("SELECT source_sample_id FROM families GROUP BY source_sample_id HAVING count(DISTINCT (coalesce(query, ''), coalesce(answer, ''))) > 1")
def inconsistent_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose families differ in query or answer."""
    return select.inconsistent(table(spark, d, "families"), ["source_sample_id"], F.struct(T.text("query"), T.text("answer")))


@query("SELECT a.sample_id FROM (SELECT DISTINCT sample_id FROM parent_samples) a INTERSECT SELECT sample_id FROM documents")
def sample_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parent_samples").select("sample_id").intersect(table(spark, d, "documents").select("sample_id"))


@query("SELECT sample_id FROM documents WHERE sample_id IS NOT NULL EXCEPT SELECT trim(sample_id) FROM calls")
def sample_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("sample_id is not null").select("sample_id").subtract(table(spark, d, "calls").select(F.trim("sample_id").alias("sample_id")))


@query("SELECT kind, count(*) AS n FROM (SELECT 'sample' AS kind, query FROM parent_samples UNION ALL SELECT 'family', query FROM families) GROUP BY kind")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "parent_samples").select(F.lit("sample").alias("kind"), "query")
    return a.unionByName(table(spark, d, "families").select(F.lit("family").alias("kind"), "query")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


