"""Queries over gates and verdicts: audits, consensus, agreement, acceptance, and the views built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import rules, stats, views
from ..session import table
from .record_queries import FAMILIES, families
from .score_queries import SCORED, scored
from .text_queries import normal_sql, phrase_sql, plain_sql

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


DIMENSIONS = ("edit_is_local", "target_absent", "question_still_clear")


def audits(spark: SparkSession, d: str) -> DataFrame:
    """One row per audit attempt with a strict JSON object: its dimensions and failure codes, as far as they have the right type."""
    a = table(spark, d, "calls").where("stage = 'AUDIT'").select("delivery_id", F.trim("sample_id").alias("sample_id"), "model_alias", F.explode("attempts").alias("a")).where("a.raw_response is not null")
    parsed = F.from_json(T.unfence("a.raw_response"), "edit_is_local boolean, target_absent boolean, question_still_clear boolean, failure_codes array<string>, rationale string", {"mode": "PERMISSIVE"})
    return a.select("delivery_id", "sample_id", "model_alias", F.col("a.attempt").alias("attempt"), parsed.alias("p")).where(F.col("p.rationale").isNotNull())


_AUDITS = """au AS (SELECT delivery_id, trim(sample_id) AS sample_id, model_alias, x.attempt AS attempt, try_cast(CASE WHEN starts_with(t, '```') THEN regexp_replace(regexp_replace(t, '(?i)^```[ \\t\\r\\n]*(?:json|text)?\\s*', ''), '\\s*```$', '') ELSE t END AS JSON) AS j
  FROM (SELECT *, regexp_replace(x.raw_response, '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT delivery_id, sample_id, model_alias, unnest(attempts) AS x FROM calls WHERE stage = 'AUDIT') WHERE x.raw_response IS NOT NULL)),
av AS (SELECT *, (j->>'edit_is_local') = 'true' AND (j->>'target_absent') = 'true' AND (j->>'question_still_clear') = 'true' AS ok FROM au WHERE j->>'rationale' IS NOT NULL AND json_type(j) = 'OBJECT')"""


@query(f"WITH {_AUDITS} SELECT delivery_id, attempt, coalesce(ok, false) AS passed, coalesce(json_array_length(j->'failure_codes'), 0)::BIGINT AS codes FROM av")
def audit_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The derived verdict: all dimensions true; what the model itself concludes does not count."""
    dims = [F.col(f"p.{x}") for x in DIMENSIONS]
    return audits(spark, d).select("delivery_id", "attempt", rules.all_true(dims).alias("passed"), F.greatest(F.coalesce(F.size("p.failure_codes"), F.lit(0)), F.lit(0)).cast("long").alias("codes"))


@query(f"WITH {_AUDITS} SELECT delivery_id, attempt, coalesce((j->>'edit_is_local') = 'false' AND (j->>'target_absent') = 'false' AND (j->>'question_still_clear') = 'false', false) AS passed FROM av")
def reverse_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The reverse gate over the same dimensions, read as defects: it passes if every one is known and false."""
    return audits(spark, d).select("delivery_id", "attempt", rules.none_true([F.col(f"p.{x}") for x in DIMENSIONS]).alias("passed"))


@query(f"""WITH {_AUDITS}, g AS (SELECT sample_id, model_alias, bool_and(coalesce(ok, false)) AS passed FROM av GROUP BY ALL),
s AS (SELECT DISTINCT sample_id FROM parent_samples)
SELECT s.sample_id, array_to_string(list_filter([CASE WHEN a.passed IS NULL THEN 'A_ABSENT' WHEN NOT a.passed THEN 'A_FAILED' END, CASE WHEN b.passed IS NULL THEN 'B_ABSENT' WHEN NOT b.passed THEN 'B_FAILED' END], lambda x: x IS NOT NULL), ',') AS exclusions
FROM s LEFT JOIN g a ON a.sample_id = s.sample_id AND a.model_alias = 'ember_large' LEFT JOIN g b ON b.sample_id = s.sample_id AND b.model_alias = 'quill_32b'""")
def gate_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Samples with the reasons that two auditors give against them; an absent audit is no pass."""
    ok = rules.all_true([F.col(f"p.{x}") for x in DIMENSIONS])
    g = audits(spark, d).groupBy("sample_id", "model_alias").agg(F.min(ok).alias("passed"))
    side = lambda model, n: g.where(F.col("model_alias") == model).select("sample_id", F.col("passed").alias(n))
    s = table(spark, d, "parent_samples").select("sample_id").distinct().join(side("ember_large", "a"), "sample_id", "left").join(side("quill_32b", "b"), "sample_id", "left")
    why = rules.reasons({"A_ABSENT": F.col("a").isNull(), "A_FAILED": ~F.col("a"), "B_ABSENT": F.col("b").isNull(), "B_FAILED": ~F.col("b")})
    return s.select("sample_id", F.array_join(why, ",").alias("exclusions"))


@query("""WITH l AS (SELECT trim(sample_id) AS sample_id, stage, model_alias, arg_max(predicted, (delivered_at, delivery_id)) AS predicted FROM calls WHERE status = 'SUCCESS' GROUP BY ALL)
SELECT a.stage, count(*) AS pairs, count(*) FILTER (a.predicted IS NOT DISTINCT FROM b.predicted) AS agreeing FROM l a JOIN l b USING (sample_id, stage) WHERE a.model_alias = 'quill_8b' AND b.model_alias = 'tern_7b' GROUP BY a.stage""")
def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often two models' latest predictions agree; two missing ones agree."""
    l = table(spark, d, "calls").where("status = 'SUCCESS'").groupBy(F.trim("sample_id").alias("sample_id"), "stage", "model_alias").agg(F.max_by("predicted", F.struct("delivered_at", "delivery_id")).alias("predicted"))  # noqa: E741
    side = lambda model, n: l.where(F.col("model_alias") == model).select("sample_id", "stage", F.col("predicted").alias(n))
    both = side("quill_8b", "a").join(side("tern_7b", "b"), ["sample_id", "stage"])
    return both.groupBy("stage").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("agreeing"))


REQUIRED = ("sample_id", "dataset", "source_id", "query", "schema_version")


@query("SELECT ord, array_to_string(list_filter([" + ", ".join(f"CASE WHEN trim(coalesce({c}, '')) = '' THEN '{c}' END" for c in REQUIRED) + ", " + ", ".join(f"CASE WHEN coalesce(len({c}), 0) = 0 THEN '{c}' END" for c in ("answers", "context", "support_units")) + "], lambda x: x IS NOT NULL), ',') AS missing FROM parent_samples")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    why = {c: F.trim(T.text(c)) == "" for c in REQUIRED} | {c: F.coalesce(F.size(c), F.lit(0)) <= 0 for c in ("answers", "context", "support_units")}
    return table(spark, d, "parent_samples").select("ord", F.array_join(rules.reasons(why), ",").alias("missing"))


@query(f"""SELECT ord, family_id, m.original_span <> '' AND len(list_filter(e, lambda x: {phrase_sql(normal_sql('x.text'), normal_sql('m.original_span'))})) > 0 AS still_there,
  len(list_filter(e, lambda x: {phrase_sql(normal_sql("concat_ws(' ', x.title, x.text)"), normal_sql('answer'))})) > 0 AS answer_there
  FROM (SELECT ord, family_id, answer, initial_state.minimal_edit AS m, initial_state.evidence AS e FROM families WHERE initial_state.state = 'MISSING' AND initial_state.minimal_edit IS NOT NULL AND initial_state.evidence IS NOT NULL)""")
def deletion_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a removed span or the answer still stands in the evidence it was removed from."""
    f = table(spark, d, "families").where("initial_state.state = 'MISSING' and initial_state.minimal_edit is not null and initial_state.evidence is not null")
    span, e = F.col("initial_state.minimal_edit.original_span"), F.col("initial_state.evidence")
    there = lambda text, phrase: T.let(T.normal(phrase), lambda p: F.exists(e, lambda x: T.contains_phrase(T.normal(text(x)), p)))
    return f.select("ord", "family_id", ((span != "") & there(lambda x: x["text"], span)).alias("still_there"), there(lambda x: F.concat_ws(" ", x["title"], x["text"]), F.col("answer")).alias("answer_there"))


@query(f"""WITH {SCORED} SELECT model_alias, avg((action IS NOT NULL)::INT) AS valid, avg((action <> 'ANSWER')::INT) FILTER (phase = 'full' AND action IS NOT NULL) AS over_request, avg((action = 'ANSWER')::INT) FILTER (phase = 'initial' AND action IS NOT NULL) AS under_request FROM sc WHERE status <> 'NOT_RUN' GROUP BY model_alias""")
def request_rates(spark: SparkSession, d: str) -> DataFrame:
    """Requests where an answer was due, answers where a request was; only over attempts that ran. Without rows: NULL."""
    s = scored(spark, d, "status <> 'NOT_RUN'")
    act = F.col("action")
    when = lambda phase, c: stats.rate(F.when((F.col("phase") == phase) & act.isNotNull(), c))
    return s.groupBy("model_alias").agg(stats.rate(act.isNotNull()).alias("valid"), when("full", act != "ANSWER").alias("over_request"), when("initial", act == "ANSWER").alias("under_request"))


@query(f"""WITH {SCORED} SELECT response_id, correct OR len(list_filter(accepted, lambda a: {plain_sql('a')} <> '' AND contains({plain_sql('asked')}, {plain_sql('a')}))) > 0 AS leaked FROM sc WHERE phase = 'initial'""")
def answer_known(spark: SparkSession, d: str) -> DataFrame:
    """First turns that give an accepted answer or mention one, anywhere in a word."""
    s = scored(spark, d, "phase = 'initial'")
    named = T.let(T.normal_plain("asked"), lambda h: F.exists(F.transform("accepted", T.normal_plain), lambda a: (a != "") & F.contains(h, a)))
    return s.select("response_id", (F.col("correct") | F.coalesce(named, F.lit(False))).alias("leaked"))


@query(f"""WITH {SCORED}, m AS (SELECT model_alias, family_id, max((phase = 'initial' AND coalesce(action = want, false))::INT) AS a, max((phase = 'continuation' AND correct)::INT) AS c, bool_or(phase = 'continuation' AND status <> 'NOT_RUN') AS ran FROM sc GROUP BY ALL)
SELECT model_alias, avg((a = 1 AND c = 1)::INT) AS low, avg((a = 1 AND (c = 1 OR NOT ran))::INT) AS high FROM m GROUP BY model_alias""")
def success_bounds(spark: SparkSession, d: str) -> DataFrame:
    """End-to-end success per model; what was not run counts as failed in the lower bound and as good in the upper."""
    s = scored(spark, d)
    m = s.groupBy("model_alias", "family_id").agg(
        F.max(((F.col("phase") == "initial") & F.coalesce(F.col("action") == F.col("want"), F.lit(False))).cast("int")).alias("a"),
        F.max(((F.col("phase") == "continuation") & F.col("correct")).cast("int")).alias("c"), F.max((F.col("phase") == "continuation") & (F.col("status") != "NOT_RUN")).alias("ran"))
    return m.groupBy("model_alias").agg(stats.rate((F.col("a") == 1) & (F.col("c") == 1)).alias("low"), stats.rate((F.col("a") == 1) & ((F.col("c") == 1) | ~F.col("ran"))).alias("high"))


@query("""WITH w AS (SELECT * FROM (VALUES ('hotpotqa', 300), ('musique', 150), ('nq_proxy', 100)) t(dataset, least)), g AS (SELECT dataset, count(DISTINCT family_id) AS n FROM families GROUP BY dataset)
SELECT w.dataset, least, coalesce(n, 0) AS families, coalesce(n, 0) >= least AS met FROM w LEFT JOIN g USING (dataset)""")
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Counts against minima per dataset; a dataset without rows does not meet its minimum."""
    want = spark.createDataFrame([("hotpotqa", 300), ("musique", 150), ("nq_proxy", 100)], "dataset string, least int")
    got = table(spark, d, "families").groupBy("dataset").agg(F.countDistinct("family_id").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return want.join(got, "dataset", "left").select("dataset", "least", n.alias("families"), (n >= F.col("least")).alias("met"))


@query("""SELECT dataset, count(DISTINCT s.sample_id) AS samples, count(DISTINCT f.source_sample_id) AS used, CASE WHEN count(DISTINCT s.sample_id) > 0 THEN count(DISTINCT f.source_sample_id) / count(DISTINCT s.sample_id) END AS yield
  FROM (SELECT DISTINCT sample_id, dataset FROM parent_samples) s LEFT JOIN (SELECT DISTINCT source_sample_id FROM families) f ON f.source_sample_id = s.sample_id GROUP BY dataset""")
def yields(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "families").select(F.col("source_sample_id").alias("sample_id"), F.lit(1).alias("u")).distinct()
    s = table(spark, d, "parent_samples").select("sample_id", "dataset").distinct().join(used, "sample_id", "left")
    return s.groupBy("dataset").agg(F.countDistinct("sample_id").alias("samples"), F.countDistinct(F.when(F.col("u") == 1, F.col("sample_id"))).alias("used"), (F.countDistinct(F.when(F.col("u") == 1, F.col("sample_id"))) / F.countDistinct("sample_id")).alias("yield"))


@query(f"""WITH {FAMILIES}, p AS (SELECT p.*, fam.query AS q, fam.trajectory AS tr, fam.answer AS gold FROM predictions p JOIN fam USING (family_id) WHERE p.parsed IS NOT NULL)
SELECT response_id, CASE WHEN phase = 'full' AND starts_with(parsed.action, 'REQUEST') THEN 'OVER_REQUEST' WHEN phase = 'initial' AND parsed.action = 'ANSWER' THEN 'UNDER_REQUEST' WHEN phase = 'continuation' AND starts_with(parsed.action, 'REQUEST') THEN 'LATE_RECOVERY' END AS category,
  CASE WHEN phase = 'initial' THEN coalesce(tr[1].content, '') ELSE coalesce(gold, '') END AS chosen, CASE WHEN parsed.action = 'ANSWER' THEN coalesce(parsed.answer, '') ELSE coalesce(parsed.clarification, '') END AS rejected FROM p
WHERE (phase = 'full' AND starts_with(parsed.action, 'REQUEST')) OR (phase = 'initial' AND parsed.action = 'ANSWER') OR (phase = 'continuation' AND starts_with(parsed.action, 'REQUEST'))""")
def preference_categories(spark: SparkSession, d: str) -> DataFrame:
    """Rejected responses by what is wrong with their action, each beside what was wanted."""
    f = families(spark, d, "answer", "trajectory")
    p = table(spark, d, "predictions").where("parsed is not null").select("response_id", "family_id", "phase", "parsed").join(f, "family_id")
    asks, act = F.col("parsed.action").startswith("REQUEST"), F.col("parsed.action")
    category = F.when((F.col("phase") == "full") & asks, "OVER_REQUEST").when((F.col("phase") == "initial") & (act == "ANSWER"), "UNDER_REQUEST").when((F.col("phase") == "continuation") & asks, "LATE_RECOVERY")
    chosen = F.when(F.col("phase") == "initial", T.text(F.get("trajectory", F.lit(0))["content"])).otherwise(T.text("answer"))
    return p.select("response_id", category.alias("category"), chosen.alias("chosen"), F.when(act == "ANSWER", T.text("parsed.answer")).otherwise(T.text("parsed.clarification")).alias("rejected")).where("category is not null")


@query()
def control_variants(spark: SparkSession, d: str) -> DataFrame:
    """Control evidence of every family: restored or resolved, and counterfactual; what cannot be built comes with its reason."""
    f = families(spark, d, "answer", "full_state", "initial_state")
    edit, docs = F.col("initial_state.minimal_edit"), F.col("initial_state.evidence")
    back = F.when(F.col("initial_state.state") == "MISSING", E.undo_replacement(docs, edit)).otherwise(E.undo_addition(docs, edit))
    kind = F.when(F.col("initial_state.state") == "MISSING", "RESTORED").otherwise("RESOLVED")
    restored = f.select("family_id", kind.alias("control"), back.alias("evidence"), F.when(edit.isNull(), "NO_EDIT").when(back.isNull(), "SPAN_NOT_FOUND").alias("skipped"))
    new = E.shifted_last_number(F.col("answer"))
    counter = f.select("family_id", F.lit("COUNTERFACTUAL").alias("control"), F.when(new.isNotNull(), E.counterfactual_evidence(F.col("full_state.evidence"), F.array("answer"), new)).alias("evidence"), F.when(new.isNull(), "NO_NUMBER").alias("skipped"))
    return restored.unionByName(counter).select("family_id", "control", "skipped", F.md5(T.render_evidence("evidence")).alias("h"))


@query(f"""WITH {FAMILIES} SELECT family_id, 'user' AS role, md5('Question:' || chr(10) || coalesce(query, '') || chr(10) || chr(10) || 'Evidence:' || chr(10) ||
  coalesce(array_to_string(list_transform(range(1, len(initial_state.evidence) + 1), lambda i: '[Document ' || i || '] ' || coalesce(initial_state.evidence[i].title, '') || chr(10) || coalesce(initial_state.evidence[i].text, '')), chr(10) || chr(10)), '')) AS h FROM fam""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The user turn shown to a model: question and rendered evidence."""
    body = F.concat(F.lit("Question:\n"), T.text("query"), F.lit("\n\nEvidence:\n"), T.text(T.render_evidence("evidence")))
    return families(spark, d, "query", F.col("initial_state.evidence").alias("evidence")).select("family_id", F.lit("user").alias("role"), F.md5(body).alias("h"))


@query("""SELECT dataset, max(len(w)) AS longest, count(*) FILTER (len(w) > 60) AS over FROM (SELECT dataset, list_filter(regexp_split_to_array(coalesce(query, ''), '[\\s\\p{Z}]+'), lambda x: x <> '') AS w FROM parent_samples) GROUP BY dataset""")
def prompt_lengths(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(F.split(T.text("query"), r"[\s\p{Z}]+"), lambda x: x != ""))
    return table(spark, d, "parent_samples").groupBy("dataset").agg(F.max(n).cast("long").alias("longest"), F.count_if(n > 60).alias("over"))


@query("""WITH e AS (SELECT trim(sample_id) AS sample_id, model_alias FROM calls WHERE stage = 'QUERY_ONLY'), s AS (SELECT DISTINCT sample_id FROM parent_samples)
SELECT (SELECT count(*) FROM s) AS samples, (SELECT count(*) FROM s WHERE sample_id IN (SELECT sample_id FROM e)) AS covered, (SELECT count(DISTINCT (sample_id, model_alias)) FROM e WHERE sample_id NOT IN (SELECT sample_id FROM s)) AS strangers""")
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    """An independent count: samples, those with calls of the first stage, and calls of samples that do not exist."""
    e = table(spark, d, "calls").where("stage = 'QUERY_ONLY'").select(F.trim("sample_id").alias("sample_id"), "model_alias").distinct()
    s = table(spark, d, "parent_samples").select("sample_id").distinct()
    covered = s.join(e.select("sample_id").distinct().withColumn("c", F.lit(1)), "sample_id", "left").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.coalesce("c", F.lit(0))).alias("covered"))
    return covered.crossJoin(e.join(s, "sample_id", "left_anti").agg(F.count(F.lit(1)).alias("strangers")))


@query("SELECT ord, array_to_string(list_transform(trajectory, lambda t: coalesce(t.role, '?')), '>') AS roles FROM families WHERE trajectory IS NOT NULL")
def trajectory_roles(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "families").where("trajectory is not null")
    return f.select("ord", views.roles(F.col("trajectory")).alias("roles"))
