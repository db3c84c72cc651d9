"""Queries over scores: matches, error kinds, funnels, rates and intervals, counterfactuals, training views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import score, stats, views
from ..session import table
from .record_queries import FAMILIES, families
from .text_queries import _in_sql, answer_sql, phrase_sql, plain_sql

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def scored(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """Predictions with their family: action, expected, correct (the answer matches an accepted one), and groups. where: which predictions (pushed to the scan)."""
    s = F.col("initial_state")
    f = families(spark, d, "answer", "answer_aliases", s["missing_information"].alias("missing"), s["original_value"].alias("v1"), s["conflicting_value"].alias("v2"))
    p = table(spark, d, "predictions").where(where).select("response_id", "family_id", "source_sample_id", "dataset", "state", "model_alias", "phase", "status", "parsed").join(f, "family_id")
    accepted = F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>")))
    act = T.action("parsed.action")
    want = F.when(F.col("phase") == "initial", score.expected_action(F.col("state"))).otherwise("ANSWER")
    return p.select(
        "response_id", "family_id", "source_sample_id", "dataset", "state", "model_alias", "phase", "status", F.when(F.col("parsed").isNotNull(), act).alias("action"), want.alias("want"),
        T.text("parsed.answer").alias("said"), T.text("parsed.clarification").alias("asked"), "answer", accepted.alias("accepted"), "missing", "v1", "v2",
        score.alias_match(F.col("parsed.answer"), accepted).alias("correct"))


_ACT = "CASE WHEN upper(trim(p.parsed.action)) = 'REQUEST_CONFLICT_RESOLUTION' THEN 'REQUEST_CONFIRMATION' WHEN upper(trim(p.parsed.action)) IN ('ANSWER', 'REQUEST_INFORMATION', 'REQUEST_CONFIRMATION') THEN upper(trim(p.parsed.action)) END"
SCORED = f"""{FAMILIES}, sc0 AS (SELECT p.response_id, p.family_id, p.source_sample_id, p.dataset, p.state, p.model_alias, p.phase, p.status, {_ACT} AS action,
  CASE WHEN p.phase = 'initial' THEN CASE p.state WHEN 'MISSING' THEN 'REQUEST_INFORMATION' WHEN 'CONFLICT' THEN 'REQUEST_CONFIRMATION' ELSE 'ANSWER' END ELSE 'ANSWER' END AS want,
  coalesce(p.parsed.answer, '') AS said, coalesce(p.parsed.clarification, '') AS asked, fam.answer, list_concat([fam.answer], coalesce(fam.answer_aliases, [])) AS accepted,
  fam.initial_state.missing_information AS missing, fam.initial_state.original_value AS v1, fam.initial_state.conflicting_value AS v2, {answer_sql('p.parsed.answer')} AS np FROM predictions p JOIN fam USING (family_id)),
sc AS (SELECT *, len(list_filter(accepted, lambda a: {answer_sql('a')} <> '' AND {answer_sql('a')} = np)) > 0 AS correct FROM sc0)"""


@query(f"WITH {SCORED} SELECT response_id, correct, {answer_sql('said')} = {answer_sql('answer')} AS exact FROM sc")
def answer_matches(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("response_id", "correct", score.exact_match(F.col("said"), F.col("answer")).alias("exact"))


@query(f"""WITH {SCORED}, t AS (SELECT response_id, list_filter(string_split({answer_sql('said')}, ' '), lambda w: w <> '') AS p, list_filter(string_split({answer_sql('answer')}, ' '), lambda w: w <> '') AS a FROM sc),
pw AS (SELECT response_id, w, count(*) AS n FROM (SELECT response_id, unnest(p) AS w FROM t) GROUP BY ALL), aw AS (SELECT response_id, w, count(*) AS n FROM (SELECT response_id, unnest(a) AS w FROM t) GROUP BY ALL),
c AS (SELECT response_id, sum(least(pw.n, aw.n)) AS common FROM pw JOIN aw USING (response_id, w) GROUP BY response_id)
SELECT t.response_id, CASE WHEN len(p) + len(a) = 0 THEN 1.0 WHEN coalesce(common, 0) = 0 THEN 0.0 ELSE 2.0::DOUBLE * common / (len(p) + len(a)) END::DOUBLE AS f1 FROM t LEFT JOIN c USING (response_id)""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("response_id", score.token_f1(F.col("said"), F.col("answer")).alias("f1"))


@query(f"""WITH {SCORED}, al AS (SELECT response_id, {answer_sql('said')} AS p, i, {answer_sql('accepted[i]')} AS a FROM (SELECT response_id, said, accepted, unnest(range(1, len(accepted) + 1)) AS i FROM sc)),
t AS (SELECT response_id, i, list_filter(string_split(p, ' '), lambda w: w <> '') AS p, list_filter(string_split(a, ' '), lambda w: w <> '') AS a FROM al),
f AS (SELECT response_id, p, a, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(a, lambda x: x = w))))) AS c FROM t)
SELECT response_id, max(CASE WHEN len(p) + len(a) = 0 THEN 1.0 WHEN coalesce(c, 0) = 0 THEN 0.0 ELSE 2.0::DOUBLE * c / (len(p) + len(a)) END)::DOUBLE AS f1 FROM f GROUP BY response_id""")
def best_f1(spark: SparkSession, d: str) -> DataFrame:
    """The best token F1 over all accepted answers."""
    return scored(spark, d).select("response_id", score.best_f1(F.col("said"), F.col("accepted")).alias("f1"))


@query(f"""WITH {SCORED}, w AS (SELECT response_id, list_distinct(list_filter(string_split({plain_sql('asked')}, ' '), lambda w: w <> '' AND w NOT IN {_in_sql(T.CONTENT_STOP)})) AS said,
  list_distinct(list_filter(string_split({plain_sql('missing')}, ' '), lambda w: w <> '' AND w NOT IN {_in_sql(T.CONTENT_STOP)})) AS ref, {phrase_sql(answer_sql('asked'), answer_sql('answer'))} AS named FROM sc WHERE asked <> '' AND state = 'MISSING')
SELECT response_id, CASE WHEN named OR len(list_intersect(ref, said)) >= 2 THEN 'GAP_MATCH' WHEN len(list_intersect(ref, said)) = 1 THEN 'GAP_PARTIAL' ELSE 'GAP_MISMATCH' END AS label FROM w""")
def gap_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whether a request names what is missing: by the answer, or by words it shares with the gap."""
    s = scored(spark, d, "state = 'MISSING'").where("asked <> ''")
    matched = F.size(F.array_intersect(T.content_words("missing"), T.content_words("asked")))
    return s.select("response_id", score.mention_label(matched, T.contains_phrase(T.normal_answer("asked"), T.normal_answer("answer"))).alias("label"))


@query(f"""WITH {SCORED}, e AS (SELECT model_alias, source_sample_id, avg(correct::INT) AS v FROM sc GROUP BY ALL), p AS (SELECT x.model_alias, x.source_sample_id AS id, x.v - b.v AS dv FROM e x JOIN e b USING (source_sample_id) WHERE b.model_alias = 'quill_8b' AND x.model_alias <> 'quill_8b')
SELECT model_alias, id, CASE WHEN dv > 0 THEN 'improved' ELSE 'worsened' END AS change FROM p WHERE dv <> 0""")
def changed_units(spark: SparkSession, d: str) -> DataFrame:
    """Sources that a run improves or worsens against the baseline, one row each: lists of any length."""
    each = scored(spark, d).select("model_alias", "source_sample_id", F.col("correct").cast("int").alias("c")).groupBy("model_alias", "source_sample_id").agg(F.avg("c").alias("v"))
    base = each.where("model_alias = 'quill_8b'").select("source_sample_id", F.col("v").alias("b"))
    both = each.where("model_alias <> 'quill_8b'").join(base, "source_sample_id").where("v <> b")
    return both.select("model_alias", F.col("source_sample_id").alias("id"), F.when(F.col("v") > F.col("b"), "improved").otherwise("worsened").alias("change"))


@query(f"""WITH {SCORED} SELECT model_alias, state, CASE WHEN action IS NULL THEN 'FORMAT_ERROR' WHEN action = want THEN 'OK' WHEN action = 'ANSWER' AND correct THEN 'ACTION_ERROR_DIRECT_CORRECT' ELSE 'ACTION_ERROR' END AS error, count(*) AS n FROM sc WHERE phase = 'initial' GROUP BY ALL""")
def first_errors(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d, "phase = 'initial'")
    return s.groupBy("model_alias", "state", score.first_error(F.col("action"), F.col("want"), F.col("correct")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCORED} SELECT model_alias, CASE WHEN action IS NULL THEN 'FORMAT_ERROR' WHEN action <> 'ANSWER' THEN 'ACTION_ERROR' WHEN correct THEN 'OK' ELSE 'ANSWER_ERROR' END AS error, count(*) AS n FROM sc WHERE phase = 'full' GROUP BY ALL""")
def full_errors(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d, "phase = 'full'")
    return s.groupBy("model_alias", score.full_error(F.col("action"), F.col("correct")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORED} SELECT want, count(*) FILTER (action = 'ANSWER') AS answered, count(*) FILTER (action = 'REQUEST_INFORMATION') AS information, count(*) FILTER (action = 'REQUEST_CONFIRMATION') AS confirmation, count(*) FILTER (action IS NULL) AS invalid FROM sc GROUP BY want")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """Expected against given actions, with a fixed list of columns."""
    a = F.col("action")
    return scored(spark, d).groupBy("want").agg(F.count_if(a == "ANSWER").alias("answered"), F.count_if(a == "REQUEST_INFORMATION").alias("information"), F.count_if(a == "REQUEST_CONFIRMATION").alias("confirmation"), F.count_if(a.isNull()).alias("invalid"))


@query(f"WITH {SCORED} SELECT state, dataset, count(*) AS n, avg((action = want)::INT) AS right_action, avg(correct::INT) AS correct_rate FROM sc GROUP BY GROUPING SETS ((), (state), (dataset))")
def metric_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return stats.blocks(s, ["state", "dataset"], [F.count(F.lit(1)).alias("n"), stats.rate(F.col("action") == F.col("want")).alias("right_action"), stats.rate(F.col("correct")).alias("correct_rate")])


@query(f"""WITH {SCORED}, e AS (SELECT model_alias, source_sample_id, avg(correct::INT) AS m, sum(correct::INT) AS s, count(*) AS n FROM sc GROUP BY ALL)
SELECT model_alias, avg(m) AS macro, sum(s) / sum(n) AS micro, count(*) AS clusters, sum(n)::BIGINT AS rows FROM e GROUP BY model_alias""")
def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    return stats.macro(scored(spark, d), ["model_alias"], "source_sample_id", F.col("correct").cast("int"))


@query(f"""WITH {SCORED}, r AS (SELECT dataset, model_alias, avg(correct::INT) AS v FROM sc GROUP BY ALL) SELECT dataset, avg(v) AS mean, stddev_samp(v) AS deviation FROM r GROUP BY dataset""")
def mean_std_runs(spark: SparkSession, d: str) -> DataFrame:
    r = scored(spark, d).groupBy("dataset", "model_alias").agg(F.avg(F.col("correct").cast("int")).alias("v"))
    return r.groupBy("dataset").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation"))


@query(f"""WITH {SCORED}, e AS (SELECT model_alias, source_sample_id, avg(correct::INT) AS v FROM sc GROUP BY ALL)
SELECT x.model_alias, avg(x.v - b.v) AS delta, count(*) FILTER (x.v > b.v) AS better, count(*) FILTER (x.v < b.v) AS worse, count(*) AS units FROM e x JOIN e b USING (source_sample_id) WHERE b.model_alias = 'quill_8b' AND x.model_alias <> 'quill_8b' GROUP BY x.model_alias""")
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    return stats.paired_delta(scored(spark, d), "source_sample_id", "model_alias", F.col("correct").cast("int"), "quill_8b")


_HASH15 = "('0x' || substr(sha256({0}), 1, 15))::BIGINT"


@query(f"""WITH {SCORED}, u AS (SELECT model_alias, {_HASH15.format("'b1:' || source_sample_id")} % 4096 AS bucket, sum(correct::INT)::DOUBLE AS num, count(*) AS den FROM sc GROUP BY ALL),
l AS (SELECT model_alias, list(num ORDER BY bucket) AS nums, list(den ORDER BY bucket) AS dens, count(*) AS k FROM u GROUP BY model_alias),
it AS (SELECT l.*, i.range AS it, unnest(range(1, k + 1)) AS j FROM l, range(50) i),
dr AS (SELECT model_alias, it, {_HASH15.format("'b1:' || model_alias || ':' || it || ':' || j")} % k + 1 AS pos, nums, dens FROM it),
st AS (SELECT model_alias, it, sum(nums[pos]) / sum(dens[pos]) AS stat FROM dr GROUP BY ALL), o AS (SELECT model_alias, list(stat ORDER BY stat) AS s FROM st GROUP BY ALL)
SELECT model_alias, s[least(50, floor(50 * 0.025)::INT + 1)] AS low, s[least(50, floor(50 * 0.5)::INT + 1)] AS mid, s[least(50, floor(50 * 0.975)::INT + 1)] AS high FROM o""")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return stats.cluster_bootstrap(scored(spark, d), ["model_alias"], "source_sample_id", F.col("correct").cast("int"), 50, "b1")


@query()
def cluster_bootstrap_10000(spark: SparkSession, d: str) -> DataFrame:
    """The whole job: 10,000 iterations over true clusters. cluster_bootstrap is the same over 50 and hash buckets, beside SQL."""
    return stats.whole_cluster_bootstrap(scored(spark, d), ["model_alias"], "source_sample_id", F.col("correct").cast("int"), 10_000, "b1")


@query(f"""WITH {SCORED}, w AS (SELECT response_id, list_distinct(list_filter(string_split({plain_sql('asked')}, ' '), lambda w: w <> '' AND w NOT IN {_in_sql(T.CONTENT_STOP)})) AS said,
  list_distinct(list_filter(string_split({plain_sql('missing')}, ' '), lambda w: w <> '' AND w NOT IN {_in_sql(T.CONTENT_STOP)})) AS ref FROM sc WHERE asked <> '' AND state = 'MISSING')
SELECT response_id, CASE WHEN len(ref) > 0 THEN len(list_intersect(ref, said)) / len(ref) END AS recall FROM w""")
def gap_recall(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d, "state = 'MISSING'").where("asked <> ''")
    return s.select("response_id", score.recall(F.col("asked"), F.col("missing")).alias("recall"))


@query(f"""WITH {SCORED} SELECT response_id, contains({plain_sql('asked')}, {plain_sql('v1')}) AND contains({plain_sql('asked')}, {plain_sql('v2')}) AS both_values FROM sc WHERE asked <> '' AND state = 'CONFLICT' AND phase = 'initial'""")
def both_values(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d, "state = 'CONFLICT' and phase = 'initial'").where("asked <> ''")
    said = T.normal_plain("asked")
    return s.select("response_id", (F.contains(said, T.normal_plain("v1")) & F.contains(said, T.normal_plain("v2"))).alias("both_values"))


@query("""WITH s AS (SELECT trim(sample_id) AS sample_id, stage, bool_and(coalesce(status = 'SUCCESS' AND answer_correct = (stage <> 'QUERY_ONLY'), false)) AS ok FROM calls WHERE stage IN ('QUERY_ONLY', 'CLEAN_FULL', 'COUNTERFACTUAL') GROUP BY ALL),
w AS (SELECT sample_id, bool_or(ok) FILTER (stage = 'QUERY_ONLY') AS q, bool_or(ok) FILTER (stage = 'CLEAN_FULL') AS f, bool_or(ok) FILTER (stage = 'COUNTERFACTUAL') AS c FROM s GROUP BY sample_id)
SELECT CASE WHEN q IS NULL THEN 'NOT_ASKED' WHEN NOT q THEN 'KNOWN' WHEN f IS NULL OR NOT f THEN 'NOT_SOLVED' WHEN c IS NULL OR NOT c THEN 'NOT_FOLLOWED' ELSE 'QUALIFIED' END AS decision, count(*) AS samples FROM w GROUP BY 1""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """Samples by the first gate that stopped them; a stage without calls is not a failed one."""
    c = table(spark, d, "calls").where(F.col("stage").isin("QUERY_ONLY", "CLEAN_FULL", "COUNTERFACTUAL")).select(F.trim("sample_id").alias("sample_id"), "stage", "status", "answer_correct")
    s = score.stage_pass(c, ["sample_id", "stage"], F.col("stage") != "QUERY_ONLY")
    w = s.groupBy("sample_id").agg(*[F.max(F.when(F.col("stage") == stage, F.col("passed"))).alias(n) for stage, n in (("QUERY_ONLY", "q"), ("CLEAN_FULL", "f"), ("COUNTERFACTUAL", "c"))])
    no = lambda n: ~F.coalesce(F.col(n), F.lit(False))
    decision = F.when(F.col("q").isNull(), "NOT_ASKED").when(~F.col("q"), "KNOWN").when(no("f"), "NOT_SOLVED").when(no("c"), "NOT_FOLLOWED").otherwise("QUALIFIED")
    return w.groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("samples"))


@query("""SELECT stage, model_alias, count(*) AS calls, count(*) FILTER (status = 'SUCCESS') AS good, avg((status = 'SUCCESS')::INT) AS rate, count(DISTINCT trim(sample_id)) AS samples FROM calls GROUP BY ALL""")
def stage_report(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("status") == "SUCCESS"
    return table(spark, d, "calls").groupBy("stage", "model_alias").agg(F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("good"), stats.rate(ok).alias("rate"), F.countDistinct(F.trim("sample_id")).alias("samples"))


# evidence -----------------------------------------------------------------------------------------------------------


@query("""SELECT ord, e.document_id AS document_id, CASE WHEN e.document_id = m.document_id THEN CASE WHEN m.replacement_span <> '' THEN replace(e.text, m.replacement_span, m.original_span) ELSE trim(concat_ws(' ', e.text, m.original_span)) END ELSE e.text END AS text
  FROM (SELECT ord, initial_state.minimal_edit AS m, initial_state.evidence AS ev, unnest(initial_state.evidence) AS e FROM families WHERE initial_state.state = 'MISSING')
  WHERE len(list_filter(ev, lambda x: x.document_id = m.document_id AND contains(x.text, m.replacement_span))) > 0""")
def undone_replacement(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "families").where("initial_state.state = 'MISSING'")
    back = E.undo_replacement(F.col("initial_state.evidence"), F.col("initial_state.minimal_edit"))
    return f.select("ord", F.explode(back).alias("e")).select("ord", "e.document_id", "e.text")


@query("""SELECT ord, e.document_id AS document_id, CASE WHEN e.document_id = m.document_id THEN rtrim(replace(e.text, m.appended_text, '')) ELSE e.text END AS text
  FROM (SELECT ord, initial_state.minimal_edit AS m, initial_state.evidence AS ev, unnest(initial_state.evidence) AS e FROM families WHERE initial_state.state = 'CONFLICT')
  WHERE len(list_filter(ev, lambda x: x.document_id = m.document_id AND contains(x.text, m.appended_text))) > 0""")
def undone_addition(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "families").where("initial_state.state = 'CONFLICT'")
    back = E.undo_addition(F.col("initial_state.evidence"), F.col("initial_state.minimal_edit"))
    return f.select("ord", F.explode(back).alias("e")).select("ord", "e.document_id", "e.text")


@query(f"""SELECT ord, e.document_id AS document_id, CASE WHEN len(list_filter(all_, lambda a: {phrase_sql(answer_sql("concat_ws(' ', e.title, e.text)"), answer_sql('a'))})) > 0 THEN '' ELSE e.text END AS text
  FROM (SELECT ord, list_concat([answer], coalesce(answer_aliases, [])) AS all_, unnest(initial_state.evidence) AS e FROM families)""")
def answer_safe_evidence(spark: SparkSession, d: str) -> DataFrame:
    all_ = F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>")))
    f = table(spark, d, "families").select("ord", F.explode(E.without_answers(F.col("initial_state.evidence"), all_)).alias("e"))
    return f.select("ord", "e.document_id", "e.text")


_PHRASES = "".join(f" WHEN {' OR '.join(f'contains(q, {chr(39)}{p}{chr(39)})' for p in ps)} THEN '{k}'" for k, ps in T.QUESTION_PHRASES.items())


@query(f"""WITH {FAMILIES}, s AS (SELECT dataset, coalesce(answer, '') AS a, {answer_sql('query')} AS q, {answer_sql('answer')} AS na FROM fam)
SELECT CASE WHEN regexp_matches(a, '(^|[^\\p{{L}}\\p{{N}}_])(1[0-9]{{3}}|20[0-9]{{2}})([^\\p{{L}}\\p{{N}}_]|$)') OR regexp_matches(lower(a), '{"|".join(m.lower() for m in T.MONTHS)}') THEN 'DATE'
  WHEN regexp_matches(trim(a), '^[+-]?\\d[\\d.,]*(\\s*%|\\s+[A-Za-z]+)?$') THEN 'NUMBER' WHEN list_has_any(string_split(q, ' '), {T.PERSON_WORDS}) THEN 'PERSON'{_PHRASES} WHEN na IN ('yes', 'no') THEN 'BOOLEAN' ELSE 'OTHER' END AS kind, dataset, count(*) AS n FROM s GROUP BY ALL""")
def semantic_types(spark: SparkSession, d: str) -> DataFrame:
    f = families(spark, d, "query", "answer", "dataset").select(T.semantic_type("query", "answer").alias("kind"), "dataset")
    return f.groupBy("kind", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query()
def counterfactuals(spark: SparkSession, d: str) -> DataFrame:
    """Counterfactual answer and evidence of every family, or why there is none."""
    f = families(spark, d, "answer", "answer_aliases", "source_sample_id", "query", "full_state").withColumn("new", E.counterfactual_answer(F.col("answer"), F.col("source_sample_id"), F.col("query")))
    all_ = F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>")))
    f = f.withColumn("changed", E.counterfactual_evidence(F.col("full_state.evidence"), all_, F.col("new")))
    return f.select("family_id", "answer", "new", E.counterfactual_error(F.col("full_state.evidence"), F.col("changed"), all_, F.col("new")).alias("error"), F.md5(T.render_evidence("changed")).alias("h"))


@query("""WITH a AS (SELECT ord, answer, regexp_extract_all(answer, '\\b(1[0-9]{3}|20[0-9]{2})\\b', 1) AS y, regexp_extract_all(answer, '(\\d+)', 1) AS n FROM families),
o AS (SELECT ord, answer, coalesce(y[-1], n[-1]) AS old, CASE WHEN y[-1] IS NOT NULL THEN (y[-1]::BIGINT + 3)::VARCHAR ELSE (try_cast(n[-1] AS HUGEINT) + 7)::VARCHAR END AS new FROM a)
SELECT ord, CASE WHEN new IS NOT NULL THEN substr(answer, 1, instr(answer, old) - 1) || new || substr(answer, instr(answer, old) + length(old)) END AS shifted FROM o""")
def shifted_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "families").select("ord", E.shifted_last_number(F.col("answer")).alias("shifted"))


# views --------------------------------------------------------------------------------------------------------------


@query("""SELECT ord, 1 + len(trajectory) AS messages, coalesce(query, '') AS prompt, coalesce(trajectory[1].content, '') AS first FROM families WHERE trajectory IS NOT NULL AND len(trajectory) > 0""")
def dialogue_views(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "families").where("size(trajectory) > 0")
    m = views.messages(F.col("query"), F.col("trajectory"))
    start = views.first_turn(m)
    return f.select("ord", F.size(m).cast("long").alias("messages"), F.get(start, F.lit(0))["content"].alias("prompt"), F.get(start, F.lit(1))["content"].alias("first"))


@query(f"""WITH {FAMILIES}, a AS (SELECT p.response_id, p.family_id, p.parsed, fam.query, coalesce(fam.trajectory[1].content, '') AS chosen, fam.trajectory[1].action AS want FROM predictions p JOIN fam USING (family_id) WHERE p.phase = 'initial')
SELECT response_id, family_id, 'UNDER_REQUEST' AS category, query, chosen, coalesce(parsed.answer, '') AS rejected FROM a WHERE chosen <> '' AND parsed IS NOT NULL AND coalesce(parsed.answer, '') <> chosen AND parsed.action = 'ANSWER' AND want <> 'ANSWER'""")
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    f = families(spark, d, "query", "trajectory", F.col("initial_state.state").alias("state"))
    return views.preference_pairs(table(spark, d, "predictions"), f)[0]


@query(f"""WITH {FAMILIES}, a AS (SELECT p.response_id, p.family_id, p.parsed, coalesce(fam.trajectory[1].content, '') AS chosen FROM predictions p JOIN fam USING (family_id) WHERE p.phase = 'initial')
SELECT response_id, family_id, CASE WHEN parsed IS NULL THEN 'UNPARSEABLE' ELSE 'IDENTICAL' END AS skip FROM a WHERE chosen <> '' AND (parsed IS NULL OR coalesce(parsed.answer, '') = chosen)""")
def preference_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Responses that give no pair, and why."""
    f = families(spark, d, "query", "trajectory", F.col("initial_state.state").alias("state"))
    return views.preference_pairs(table(spark, d, "predictions"), f)[1]


@query(f"""WITH {FAMILIES}, g AS (SELECT source_sample_id, concat_ws('/', dataset, initial_state.state) AS stratum, count(*) AS n FROM fam GROUP BY ALL),
t AS (SELECT g.*, r.range AS trial, ('0x' || substr(sha256('s1:' || r.range || ':' || source_sample_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM g, range(20) r),
s AS (SELECT trial, stratum, sum(n) AS al, sum(n) FILTER (u < 0.8) AS a, sum(n) FILTER (u >= 0.8 AND u < 0.9) AS b, sum(n) FILTER (u >= 0.9) AS c FROM t GROUP BY ALL),
e AS (SELECT trial, round(sum(((coalesce(a, 0) - al * 0.8) / greatest(al * 0.8, 1)) ^ 2 + ((coalesce(b, 0) - al * 0.1) / greatest(al * 0.1, 1)) ^ 2 + ((coalesce(c, 0) - al * 0.1) / greatest(al * 0.1, 1)) ^ 2), 9) AS score FROM s GROUP BY trial),
best AS (SELECT trial FROM e ORDER BY score, trial LIMIT 1)
SELECT DISTINCT source_sample_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split FROM t JOIN best USING (trial)""")
def balanced_split(spark: SparkSession, d: str) -> DataFrame:
    """Sources dealt to splits by the best of 20 hashed trials, by state and dataset."""
    f = families(spark, d, "source_sample_id", F.concat_ws("/", "dataset", F.col("initial_state.state")).alias("stratum"))
    return views.balanced_split(f, "source_sample_id", F.col("stratum"), {"train": 0.8, "dev": 0.1, "test": 0.1}, 20, "s1")


@query()
def balanced_split_5000(spark: SparkSession, d: str) -> DataFrame:
    """The whole job: the best of 5,000 trials. balanced_split is the search over 20, beside SQL."""
    f = families(spark, d, "source_sample_id", F.concat_ws("/", "dataset", F.col("initial_state.state")).alias("stratum"))
    return views.searched_split(f, "source_sample_id", F.col("stratum"), {"train": 0.8, "dev": 0.1, "test": 0.1}, 5000, "s1")


@query("SELECT source_sample_id, count(DISTINCT split) AS splits FROM families GROUP BY source_sample_id HAVING count(DISTINCT split) > 1")
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    return views.leaks(table(spark, d, "families"), "source_sample_id")


@query("""SELECT before, role, count(*) AS n FROM (SELECT ord, k, CASE WHEN lower(trim(t.role)) IN ('assistant', 'model') THEN 'assistant' WHEN lower(trim(t.role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(t.role)) = 'system' THEN 'system' END AS role,
  lag(CASE WHEN lower(trim(t.role)) IN ('assistant', 'model') THEN 'assistant' WHEN lower(trim(t.role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(t.role)) = 'system' THEN 'system' END) OVER (PARTITION BY ord ORDER BY k) AS before
  FROM (SELECT ord, unnest(trajectory) AS t, unnest(range(len(trajectory))) AS k FROM families)) GROUP BY ALL""")
def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    return views.adjacent_turns(table(spark, d, "families")).groupBy("before", "role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split, dataset, count(DISTINCT family_id) AS families, count(DISTINCT source_sample_id) AS sources FROM families GROUP BY ALL")
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "families").groupBy("split", "dataset").agg(F.countDistinct("family_id").alias("families"), F.countDistinct("source_sample_id").alias("sources"))
