"""Queries over sources, sinks, corpora and streams: what is written is read back, what is built is held against SQL over the same raw rows."""

from __future__ import annotations

import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpora
from ..session import shared_folder, table
from ..sources import files
from ..streaming import log
from .text_queries import normal_sql, phrase_sql, sentences_sql

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one."""
    return f"{shared_folder(spark).removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


# files --------------------------------------------------------------------------------------------------------------


@query("SELECT family_id, query, answer, answer_aliases FROM families")
def source_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written whole, at once, and read strictly."""
    f, to = table(spark, d, "families").select("family_id", "query", "answer", "answer_aliases"), scratch(spark, "jsonl")
    files.write_jsonl(f, to)
    return files.read_jsonl(spark, to, f.schema)


@query("SELECT model_alias, context_tokens FROM models UNION ALL SELECT model_alias, context_tokens FROM models")
def source_appended(spark: SparkSession, d: str) -> DataFrame:
    """A log that is appended to twice."""
    m, to = table(spark, d, "models").select("model_alias", "context_tokens"), scratch(spark, "log")
    files.append_log(m, to)
    files.append_log(m, to)
    return files.read_jsonl(spark, to, m.schema)


@query("SELECT CASE WHEN payload IS NULL OR json_type(try_cast(payload AS JSON)) IS DISTINCT FROM 'OBJECT' THEN 'bad' ELSE 'good' END AS kind, count(*) AS n FROM raw_records WHERE trim(coalesce(payload, '')) <> '' GROUP BY 1")
def source_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Raw records as lines of text, read leniently: good rows and corrupt lines; blank lines are skipped."""
    to = scratch(spark, "lines")
    one_line = F.regexp_replace("payload", r"[\r\n]+", " ")
    table(spark, d, "raw_records").where("payload is not null").select(one_line.alias("value")).write.text(to)
    good, bad = files.split_corrupt(files.read_jsonl(spark, to, "family_id string, source_sample_id string", strict=False).cache())
    return good.select(F.lit("good").alias("kind")).unionByName(bad.select(F.lit("bad").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT action, content_field FROM action_fields")
def source_zip(spark: SparkSession, d: str) -> DataFrame:
    """A member of a ZIP archive, read line by line; the archive is made from a table that never grows."""
    to = Path(scratch(spark, "zip"))
    to.mkdir(parents=True)
    rows = table(spark, d, "action_fields").select(F.to_json(F.struct("action", "content_field")).alias("j")).collect()
    with zipfile.ZipFile(to / "a.zip", "w") as z:
        z.writestr("m.jsonl", "\n\n".join(r["j"] for r in rows) + "\n")
    return files.read_jsonl_zip(spark, f"{to}/a.zip", "m.jsonl", "action string, content_field string")


@query("SELECT 0::BIGINT AS n")
def source_absent(spark: SparkSession, d: str) -> DataFrame:
    """A file that is not there has no rows."""
    return files.read_optional(spark, scratch(spark, "none"), "a string").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT model_alias, provider, '' AS verdict FROM models")
def sink_review(spark: SparkSession, d: str) -> DataFrame:
    """A review table as CSV with a byte order mark and empty columns for labels, read again."""
    to = scratch(spark, "csv")
    files.write_review_csv(table(spark, d, "models").select("model_alias", "provider"), to, ["verdict"])
    got = spark.read.option("header", True).csv(to)
    return got.toDF(*[c.removeprefix("﻿") for c in got.columns]).select("model_alias", "provider", F.coalesce("verdict", F.lit("")).alias("verdict"))


@query("SELECT sha256(model_alias || chr(10)) AS sha256, length(model_alias || chr(10)) AS bytes FROM models")
def file_checksums(spark: SparkSession, d: str) -> DataFrame:
    """One file per model, its size and SHA-256."""
    to = scratch(spark, "sums")
    table(spark, d, "models").select(F.col("model_alias").alias("m"), F.col("model_alias").alias("value")).write.partitionBy("m").text(to)
    return files.checksums(spark, to).where("path like '%.txt'").select("sha256", "bytes")


@query("SELECT model_alias, '## ' || model_alias || chr(10) || chr(10) || '- provider: ' || coalesce(provider, '—') || chr(10) || '- context: ' || coalesce(context_tokens::VARCHAR, '—') AS section FROM models")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "models").select("model_alias", files.markdown_section(F.col("model_alias"), {"provider": F.col("provider"), "context": F.col("context_tokens")}).alias("section"))


# corpora ------------------------------------------------------------------------------------------------------------


def raw_proxy(spark: SparkSession, d: str) -> DataFrame:
    """Samples taken apart again to question, titled text and answers."""
    one = F.get("context", F.lit(0))
    return table(spark, d, "parent_samples").select(F.col("ord").cast("string").alias("source_id"), F.col("query").alias("original_query"), F.concat(F.lit("Title: "), T.text(one["title"]), F.lit("\n\n"), T.text(one["text"])).alias("original_context"), F.col("answers").alias("original_answers"))


_PROXY = f"""raw AS (SELECT ord::VARCHAR AS source_id, coalesce(query, '') AS q, 'Title: ' || coalesce(context[1].title, '') || chr(10) || chr(10) || coalesce(context[1].text, '') AS x, coalesce(answers, []) AS an FROM parent_samples),
k AS (SELECT *, trim(x) AS al, CASE WHEN regexp_matches(trim(x), '(?is)^\\s*title:[ \\t]*[^\\n]*\\n+.*$') THEN trim(regexp_extract(trim(x), '(?is)^\\s*title:[ \\t]*([^\\n]*)\\n+(.*)$', 2)) ELSE trim(x) END AS body, list_transform(an, lambda a: {normal_sql('a')}) AS keys FROM raw),
b AS (SELECT source_id, q, al, body, list_filter(list_transform(range(1, len(an) + 1), lambda i: CASE WHEN keys[i] <> '' AND list_position(keys, keys[i]) = i THEN an[i] END), lambda a: a IS NOT NULL) AS an FROM k),
n AS (SELECT *, list_transform(an, lambda a: {normal_sql('a')}) AS ks, {normal_sql('al')} AS nal, {normal_sql('q')} AS nq, coalesce(an[1], '') AS a1, list_transform({sentences_sql('body')}, lambda s: {normal_sql('s')}) AS sn FROM b),
u AS (SELECT *, len(list_filter(sn, lambda s: len(list_filter(ks, lambda k: {phrase_sql('s', 'k')})) > 0)) AS units FROM n)"""


@query(f"""WITH {_PROXY} SELECT 'nq_proxy_' || source_id AS sample_id, units, array_to_string(list_filter([CASE WHEN trim(q) = '' THEN 'EMPTY_QUESTION' END, CASE WHEN len(an) = 0 THEN 'MISSING_ANSWER' END,
  CASE WHEN len(an) > 0 AND (length(a1) > 80 OR len(list_filter(regexp_split_to_array(a1, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) > 12) THEN 'ANSWER_TOO_LONG' END,
  CASE WHEN len(an) > 0 AND {phrase_sql('nq', 'ks[1]')} THEN 'ANSWER_IN_QUESTION' END, CASE WHEN len(an) > 0 AND len(list_filter(ks, lambda k: {phrase_sql('nal', 'k')})) = 0 THEN 'ANSWER_NOT_IN_CONTEXT' END,
  CASE WHEN units = 0 THEN 'NO_ANSWER_SENTENCE' END, CASE WHEN regexp_full_match(coalesce(ks[1], ''), '\\d{{1,4}}') THEN 'BARE_NUMBER' END], lambda x: x IS NOT NULL), ',') AS reasons FROM u""")
def proxy_corpus(spark: SparkSession, d: str) -> DataFrame:
    """One-document samples built from question, titled text and answers, with the reasons against each."""
    s = corpora.proxy_samples(raw_proxy(spark, d))
    return s.select("sample_id", F.size("support_units").cast("long").alias("units"), F.array_join("reasons", ",").alias("reasons"))


def raw_hotpot(spark: SparkSession, d: str) -> DataFrame:
    """Samples with sentences taken apart to titles, sentences and pointers."""
    s = table(spark, d, "parent_samples").where("exists(context, c -> c.sentences is not null)").alias("s")
    title = lambda u: F.get(F.filter("s.context", lambda c: c["document_id"] == u["document_id"]), 0)["title"]
    return s.select(
        F.col("ord").cast("string").alias("id"), F.col("query").alias("question"), F.get("answers", F.lit(0)).alias("answer"), F.col("reasoning_type").alias("type"),
        F.struct(F.transform("s.context", lambda c: c["title"]).alias("title"), F.transform("s.context", lambda c: F.coalesce(c["sentences"], F.array(c["text"]))).alias("sentences")).alias("context"),
        F.struct(F.transform("support_units", title).alias("title"), F.transform("support_units", lambda u: u["sentence_id"]).alias("sent_id")).alias("supporting_facts"))


@query("""WITH s AS (SELECT ord, list_transform(context, lambda c: c.title) AS titles, list_transform(context, lambda c: coalesce(c.sentences, [c.text])) AS groups, support_units AS su, context FROM parent_samples WHERE len(list_filter(context, lambda c: c.sentences IS NOT NULL)) > 0),
f AS (SELECT ord, len(su) AS facts, len(list_filter(su, lambda u: u.sentence_id >= 0 AND groups[list_position(titles, list_filter(context, lambda c: c.document_id = u.document_id)[1].title)][u.sentence_id + 1] IS NOT NULL)) AS whole FROM s)
SELECT 'hotpotqa_' || ord AS sample_id, whole AS units, facts = 0 AS empty, whole < facts AS broken FROM f""")
def hotpot_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Samples with pointers to sentences: how many point somewhere, and what the builder says of the others."""
    s = corpora.hotpot_samples(raw_hotpot(spark, d))
    return s.select("sample_id", F.size("support_units").cast("long").alias("units"), F.array_contains("reasons", "EMPTY_SUPPORT").alias("empty"), F.array_contains("reasons", "BROKEN_POINTER").alias("broken"))


def raw_musique(spark: SparkSession, d: str) -> DataFrame:
    """Samples with a decomposition taken apart to paragraphs and steps."""
    s = table(spark, d, "parent_samples").where("decomposition is not null")
    return s.select(
        F.col("ord").cast("string").alias("id"), F.col("query").alias("question"), F.get("answers", F.lit(0)).alias("answer"), F.slice("answers", F.lit(2), F.size("answers")).alias("answer_aliases"),
        F.transform("context", lambda c: F.struct(c["position"].alias("idx"), c["title"].alias("title"), c["text"].alias("paragraph_text"), c["is_supporting"].alias("is_supporting"))).alias("paragraphs"),
        F.transform("decomposition", lambda q: F.struct(q["sub_question"].alias("question"), q["sub_answer"].alias("answer"), F.get(F.filter("context", lambda c: c["document_id"] == q["support_document_id"]), 0)["position"].alias("paragraph_support_idx"))).alias("question_decomposition"))


@query("""WITH s AS (SELECT ord, decomposition AS st, list_transform(decomposition, lambda q: list_filter(context, lambda c: c.position = list_filter(context, lambda x: x.document_id = q.support_document_id)[1].position AND coalesce(c.is_supporting, false) AND trim(coalesce(c.text, '')) <> '')[1]) AS docs FROM parent_samples WHERE decomposition IS NOT NULL)
SELECT 'musique_' || ord AS sample_id, len(list_filter(docs, lambda x: x IS NOT NULL)) AS units, len(list_filter(docs, lambda x: x IS NOT NULL)) < len(st) AS broken FROM s""")
def musique_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Samples with steps that point to paragraphs: how many point to a supporting one."""
    s = corpora.musique_samples(raw_musique(spark, d))
    return s.select("sample_id", F.size("support_units").cast("long").alias("units"), F.array_contains("reasons", "BROKEN_POINTER").alias("broken"))


# streams ------------------------------------------------------------------------------------------------------------


def stream_of_calls(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The calls as a stream of files, in portions."""
    to = scratch(spark, "stream")
    table(spark, d, "calls").select(*columns).repartition(4, "delivery_id").write.parquet(to)
    return log.read_log(spark, to, spark.read.parquet(to).schema, 2)


@query("SELECT call_id, delivery_id, status FROM calls QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY delivered_at DESC, delivery_id DESC) = 1")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each call, kept up by micro-batches."""
    to = scratch(spark, "latest")
    log.keep_latest(stream_of_calls(spark, d, "call_id", "delivery_id", "status", "delivered_at"), "call_id", ["delivered_at", "delivery_id"], to, scratch(spark, "checkpoint")).awaitTermination()
    last = max(Path(to).glob("v*"), key=lambda p: int(p.name[1:]))
    return spark.read.parquet(str(last)).select("call_id", "delivery_id", "status")


@query(r"""WITH k AS (SELECT delivery_id, nullif(regexp_replace(sample_id, '^\s+|\s+$', '', 'g'), '') AS s, lower(nullif(regexp_replace(request_hash, '^\s+|\s+$', '', 'g'), '')) AS h,
  try_cast(CASE WHEN regexp_matches(trim(created_at), '(Z|[+-]\d\d:?\d\d)$') THEN trim(created_at) ELSE trim(created_at) || '+00:00' END AS timestamptz) AS t FROM calls)
SELECT count(DISTINCT CASE WHEN s IS NULL OR h IS NULL OR t IS NULL THEN '#' || delivery_id ELSE concat_ws('|', s, h, t::VARCHAR) END) AS messages FROM k""")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """How many messages are left of a stream of deliveries, with a watermark that no delivery misses."""
    to = scratch(spark, "once")
    once = log.once_within(stream_of_calls(spark, d, "delivery_id", "sample_id", "request_hash", "created_at", "delivered_at"), "36500 days")
    once.select("delivery_id").writeStream.format("parquet").option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start(to).awaitTermination()
    return spark.read.parquet(to).agg(F.count(F.lit(1)).alias("messages"))
