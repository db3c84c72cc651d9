"""Queries over text functions: documents, families, calls and parent samples, whole tables and whole texts."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as T
from ..operators import rules
from ..session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@functools.lru_cache(2)
def _folding(compat: bool) -> tuple[str, str, list[tuple[str, str]]]:
    """Characters of the basic plane that lower() leaves otherwise than folding does: (single ones, what each becomes, those that become several).

    Several: in the blocks of Latin, punctuation, letter-like signs and number forms; those of other scripts have no place in the test tables.
    """
    one, to, many = [], [], []
    for c in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0xFFFE))):
        want = (unicodedata.normalize("NFKC", c) if compat else c).casefold()
        if want == (c.lower() if len(c.lower()) == 1 else c):
            continue
        if len(want) == 1:
            one.append(c)
            to.append(want)
        elif c < "\u2500" or "\ufb00" <= c <= "\ufb06":
            many.append((c, want))
    return "".join(one), "".join(to), many


def fold_sql(x: str, compat: bool = False) -> str:
    """Folding spelt out character by character; independent of the library that the JVM calls."""
    one, to, many = _folding(compat)
    quoted = lambda c: "'" + c.replace("'", "''") + "'"
    t = x
    for c, want in many:
        t = f"replace({t}, {quoted(c)}, {quoted(want)})"
    t = f"lower(translate({t}, {quoted(one)}, {quoted(to)}))"
    t = f"nfc_normalize({t})" if compat else t
    return f"CASE WHEN {x} IS NULL THEN '' WHEN regexp_matches({x}, '[^\\x00-\\x7f]') THEN {t} ELSE lower({x}) END"


def normal_sql(x: str) -> str:
    return f"trim(regexp_replace({fold_sql(x, True)}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def plain_sql(x: str) -> str:
    return f"trim(regexp_replace({fold_sql(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def answer_sql(x: str) -> str:
    """Commas between figures go twice, since a pattern without look-ahead consumes the figure behind."""
    t = fold_sql(x, True)
    t = f"regexp_replace(regexp_replace({t}, '(\\d),(\\d)', '\\1\\2', 'g'), '(\\d),(\\d)', '\\1\\2', 'g')"
    t = f"replace(replace({t}, '''', ''), '’', '')"
    t = f"trim(regexp_replace(regexp_replace({t}, '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"
    return f"array_to_string(list_filter(string_split({t}, ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


def phrase_sql(h: str, n: str) -> str:
    return f"({n} <> '' AND {h} <> '' AND contains(' ' || {h} || ' ', ' ' || {n} || ' '))"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def sentences_sql(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({squeeze_sql(x)}, '([.!?]) +([\"''(\\[]?[A-Z0-9])', '\\1' || chr(30) || '\\2', 'g'), chr(30)), lambda s: s <> '')"


@query(f"SELECT doc_id, md5({normal_sql('text')}) AS h FROM documents")
def norm_phrase(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.normal("text")).alias("h"))


@query(f"SELECT doc_id, md5({answer_sql('text')}) AS h FROM documents")
def norm_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.normal_answer("text")).alias("h"))


@query(f"SELECT doc_id, md5({plain_sql('text')}) AS h FROM documents")
def norm_plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.normal_plain("text")).alias("h"))


@query(f"SELECT doc_id, len({sentences_sql('text')}) AS sentences, md5(array_to_string({sentences_sql('text')}, '|')) AS h FROM documents")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = T.sentences("text")
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("sentences"), F.md5(F.array_join(s, "|")).alias("h"))


@query(f"""WITH s AS (SELECT source, unnest({sentences_sql('text')}) AS x FROM documents)
SELECT source, count(*) AS sentences, avg(length(x)) AS mean_length, max(length(x)) AS longest FROM s GROUP BY source""")
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("source", F.explode(T.sentences("text")).alias("x"))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("sentences"), F.avg(F.length("x")).alias("mean_length"), F.max(F.length("x")).cast("long").alias("longest"))


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({squeeze_sql('text')}, '([.!?]) +', '\\1' || chr(30), 'g'), chr(30)),
  lambda p: trim(regexp_replace({fold_sql('p')}, '[^0-9a-zÀ-ž]+', ' ', 'g'))), lambda p: len(string_split(p, ' ')) >= 4) AS l FROM documents)
SELECT doc_id FROM s WHERE len(l) > len(list_distinct(l))""")
def repeated_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(T.repeats_sentence("text")).select("doc_id")


@query(f"""SELECT CASE WHEN regexp_matches(trim(answer), '^\\d+([.,]\\d+)?$') THEN 'number'
  WHEN regexp_matches(answer, '(^|[^\\p{{L}}\\p{{N}}_])(1[0-9]{{3}}|20[0-9]{{2}})([^\\p{{L}}\\p{{N}}_]|$)') THEN 'date_or_year'
  WHEN len(list_filter(string_split({normal_sql('answer')}, ' '), lambda w: w <> '')) <= 6 THEN 'short_entity' ELSE 'short_text' END AS kind,
  dataset, count(*) AS n FROM families GROUP BY ALL""")
def answer_types(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "families").select(T.answer_type("answer").alias("kind"), "dataset")
    return kinds.groupBy("kind", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT family_id, ord, length(coalesce(answer, '')) > 20 OR len(list_filter(regexp_split_to_array(coalesce(answer, ''), '[\\s\\p{Z}]+'), lambda w: w <> '')) > 3 AS long FROM families""")
def long_answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "families").select("family_id", "ord", T.too_long("answer", 20, 3).alias("long"))


@query("""WITH t AS (SELECT ord, CASE WHEN unnest.title IS NULL THEN coalesce(unnest.text, '') ELSE 'Title: ' || unnest.title || chr(10) || chr(10) || coalesce(unnest.text, '') END AS x
  FROM (SELECT ord, unnest(context) AS unnest FROM parent_samples))
SELECT ord, trim(regexp_extract(x, '(?is)^\\s*title:[ \\t]*([^\\n]*)\\n+(.*)$', 1)) AS title,
  md5(CASE WHEN regexp_matches(x, '(?is)^\\s*title:[ \\t]*[^\\n]*\\n+.*$') THEN trim(regexp_extract(x, '(?is)^\\s*title:[ \\t]*([^\\n]*)\\n+(.*)$', 2)) ELSE x END) AS body FROM t""")
def title_body(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "parent_samples").select("ord", F.explode("context").alias("c"))
    x = c.select("ord", F.when(F.col("c.title").isNull(), T.text("c.text")).otherwise(F.concat(F.lit("Title: "), F.col("c.title"), F.lit("\n\n"), T.text("c.text"))).alias("x"))
    return x.select("ord", T.title_of("x").alias("title"), F.md5(T.body_of("x")).alias("body"))


@query("""SELECT ord, q.hop AS hop, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(q.sub_question, ''), '#(\\d+)', 1), lambda n: try_cast(n AS HUGEINT)))), ',') AS refs
  FROM (SELECT ord, unnest(decomposition) AS q FROM parent_samples)""")
def hop_references(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "parent_samples").select("ord", F.explode("decomposition").alias("q"))
    return q.select("ord", F.col("q.hop").alias("hop"), F.array_join(F.transform(T.references("q.sub_question"), lambda n: n.cast("string")), ",").alias("refs"))


def _in_sql(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split({plain_sql('query')}, ' '), lambda w: w <> '' AND w NOT IN {_in_sql(T.CONTENT_STOP)}))) AS w FROM parent_samples) GROUP BY w""")
def content_word_counts(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "parent_samples").select(F.explode(T.content_words("query")).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split({plain_sql('initial_state.missing_information')}, ' '), lambda w: w <> '' AND w NOT IN {_in_sql(T.SLOT_STOP)}))) AS w FROM families) GROUP BY w""")
def slot_word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words that say what is missing, without those that say nothing of a slot."""
    w = table(spark, d, "families").select(F.explode(T.content_words("initial_state.missing_information", T.SLOT_STOP)).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_TAGS = " UNION ALL ".join(f"SELECT '{tag}' AS tag, '{w}' AS w" for tag, ws in T.RELATIONS.items() for w in ws)


@query(f"""WITH tags AS ({_TAGS}), t AS (SELECT doc_id, unnest(list_distinct(string_split(regexp_replace(lower(coalesce(text, '')), '[^0-9a-zÀ-ž]+', ' ', 'g'), ' '))) AS w FROM documents)
SELECT tag, count(DISTINCT doc_id) AS documents FROM t JOIN tags USING (w) GROUP BY tag""")
def relation_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.explode(T.relation_tags("text")).alias("tag"))
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("documents"))


#: Wording that hedges a claim, and wording that speaks of the evidence itself.
HEDGES = r"(?i)\b(reportedly|allegedly|supposedly|actually|some accounts|disputed|is usually explained)\b"
ARTEFACTS = r"( [.,;:]|\(\s*\)|  +|\.\.)"


@query(f"""SELECT doc_id, regexp_matches(text, '{HEDGES}') AS hedged, regexp_matches(text, '{ARTEFACTS}') AS artefact FROM documents WHERE regexp_matches(text, '{HEDGES}') OR regexp_matches(text, '{ARTEFACTS}')""")
def surface_flags(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.col("text").rlike(HEDGES).alias("hedged"), F.col("text").rlike(ARTEFACTS).alias("artefact"))
    return t.where("hedged or artefact")


@query("""SELECT response_id FROM predictions WHERE """ + " OR ".join("contains(lower(coalesce(raw_response, '')), '" + p.replace("'", "''") + "')" for p in T.ABSTAIN))
def abstain_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").where(T.abstains("raw_response")).select("response_id")


#: Shapes of secrets.
SECRETS = {"private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "api_key": "\\bsk-[A-Za-z0-9_-]{20,}", "access_token": "\\bgh[pousr]_[A-Za-z0-9]{20,}"}


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in SECRETS.items()) + "], lambda x: x IS NOT NULL)[1] AS secret FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in SECRETS.values()))
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select("doc_id", rules.first_reason({n: F.col("text").rlike(p) for n, p in SECRETS.items()}).alias("secret"))
    return hits.where("secret is not null")


@query("""WITH a AS (SELECT delivery_id, k, x.raw_response AS raw FROM (SELECT delivery_id, unnest(attempts) AS x, unnest(range(len(attempts)))::INT AS k FROM calls) WHERE x.raw_response IS NOT NULL),
t AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM a),
u AS (SELECT *, CASE WHEN starts_with(s, '```') THEN regexp_replace(regexp_replace(s, '(?i)^```[ \\t\\r\\n]*(?:json|text)?\\s*', ''), '\\s*```$', '') ELSE s END AS inside FROM t)
SELECT delivery_id, k, starts_with(s, '```') AS fenced, json_valid(inside) AND json_type(try_cast(inside AS JSON)) = 'OBJECT' AS strict FROM u""")
def json_fences(spark: SparkSession, d: str) -> DataFrame:
    """Which raw responses are fenced, and which hold a strict JSON object."""
    a = table(spark, d, "calls").select("delivery_id", F.posexplode("attempts").alias("k", "x")).where("x.raw_response is not null")
    t = T.unfence("x.raw_response")
    strict = T.is_json_object(t)
    return a.select("delivery_id", "k", F.regexp_replace("x.raw_response", r"^\s+", "").startswith("```").alias("fenced"), strict.alias("strict"))


def unfence_sql(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN starts_with({t}, '```') THEN regexp_replace(regexp_replace({t}, '(?i)^```[ \\t\\r\\n]*(?:json|text)?\\s*', ''), '\\s*```$', '') ELSE {t} END"


@query(f"""WITH a AS (SELECT delivery_id, k, x.raw_response AS raw FROM (SELECT delivery_id, unnest(attempts) AS x, unnest(range(len(attempts)))::INT AS k FROM calls) WHERE x.raw_response IS NOT NULL),
u AS (SELECT delivery_id, k, raw, {unfence_sql('raw')} AS t, coalesce(list_filter(list_transform(regexp_split_to_array(raw, '[\\r\\n]'), lambda s: trim(s)), lambda s: s <> '')[1], '') AS line FROM a)
SELECT delivery_id, k, coalesce(CASE WHEN starts_with(t, '{{') THEN trim(try_cast(t AS JSON)->>'answer') END, regexp_replace(regexp_replace(trim(regexp_replace(line, '(?i)^(?:answer|final answer|答案)\\s*[:：]\\s*', '')), '^"+', ''), '"+$', '')) AS answer FROM u""")
def predicted_answers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "calls").select("delivery_id", F.posexplode("attempts").alias("k", "x")).where("x.raw_response is not null")
    return a.select("delivery_id", "k", T.predicted_answer("x.raw_response").alias("answer"))


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN upper(trim(t.action)) = 'REQUEST_CONFLICT_RESOLUTION' THEN 'REQUEST_CONFIRMATION'
  WHEN upper(trim(t.action)) IN ('ANSWER', 'REQUEST_INFORMATION', 'REQUEST_CONFIRMATION') THEN upper(trim(t.action)) END AS action
  FROM (SELECT unnest(trajectory) AS t FROM families)) GROUP BY action""")
def canonical_actions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "families").select(F.explode("trajectory").alias("t"))
    return t.groupBy(T.action("t.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT ord, md5(array_to_string(list_transform(range(1, len(context) + 1), lambda i: '[Document ' || i || '] ' || coalesce(context[i].title, '') || chr(10) || coalesce(context[i].text, '')), chr(10) || chr(10))) AS h FROM parent_samples""")
def rendered_evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parent_samples").select("ord", F.md5(T.render_evidence("context")).alias("h"))


def json_text_sql(x: str) -> str:
    return f"to_json({x})::VARCHAR"


def canonical_sql(x: str, kind: t.DataType) -> str:
    if isinstance(kind, t.StructType):
        fields = " || ',' || ".join(f"'\"{f.name}\":' || {canonical_sql(f'{x}.{f.name}', f.dataType)}" for f in sorted(kind.fields, key=lambda f: f.name))
        out = f"'{{' || {fields} || '}}'"
    elif isinstance(kind, t.ArrayType):
        out = f"'[' || array_to_string(list_transform({x}, lambda v: {canonical_sql('v', kind.elementType)}), ',') || ']'"
    else:
        out = json_text_sql(x) if isinstance(kind, t.StringType) else f"({x})::VARCHAR"
    return f"coalesce(CASE WHEN {x} IS NOT NULL THEN {out} END, 'null')"


def struct_of(**fields: t.DataType) -> t.StructType:
    return t.StructType([t.StructField(n, k) for n, k in fields.items()])


_STRING, _STRINGS, _INT = t.StringType(), t.ArrayType(t.StringType()), t.IntegerType()
#: The type of calls.request_body.
REQUEST_BODY = struct_of(
    temperature=t.DoubleType(), top_p=t.DoubleType(), max_tokens=_INT, seed=_INT, stop=_STRINGS, chat_template_kwargs=struct_of(enable_thinking=t.BooleanType(), thinking_budget=_INT),
    response_format=struct_of(type=_STRING, json_schema=struct_of(name=_STRING, strict=t.BooleanType(), required=_STRINGS)))
REQUEST = struct_of(model_alias=_STRING, prompt_version=_STRING, request_body=REQUEST_BODY, sample_id=_STRING)


@query(f"SELECT sha256({canonical_sql('r', REQUEST)}) AS h, count(*) AS n FROM (SELECT {{'model_alias': model_alias, 'prompt_version': prompt_version, 'request_body': request_body, 'sample_id': sample_id}} AS r FROM calls) GROUP BY 1")
def request_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct requests by the canonical hash of body, model, prompt version and sample: keys in order at every level, NULL fields as null."""
    r = table(spark, d, "calls").select(F.struct("model_alias", "prompt_version", "request_body", "sample_id").alias("r"))
    return r.select(T.request_hash(F.col("r"), REQUEST).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


_GAPPED = f"""e AS (SELECT ord, family_id, string_split({answer_sql('answer')}, ' ') AS nm, string_split({answer_sql('e.text')}, ' ') AS h FROM (SELECT ord, family_id, answer, unnest(initial_state.evidence) AS e FROM families)),
w AS (SELECT ord, family_id, nm, h, len(nm) AS n, coalesce(list_position(h, nm[1]), 0) AS pos, 1 AS k FROM e WHERE len(nm) >= 2),
r AS (SELECT * FROM w WHERE pos > 0 UNION ALL SELECT ord, family_id, nm, h, n, pos + list_position(h[pos + 1:], nm[k + 1]), k + 1 FROM r WHERE k < n AND coalesce(list_position(h[pos + 1:], nm[k + 1]), 0) BETWEEN 1 AND 3)"""


@query(f"WITH RECURSIVE {_GAPPED} SELECT DISTINCT ord, family_id FROM r WHERE k = n")
def gapped_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Families whose initial evidence names the answer with up to two words between."""
    f = table(spark, d, "families").select("ord", "family_id", "answer", F.explode("initial_state.evidence").alias("e"))
    hit = T.gapped_mention(T.normal_answer("e.text"), T.normal_answer("answer"))
    return f.where(hit).select("ord", "family_id").distinct()


@query(f"""WITH a AS (SELECT delivery_id, k, {unfence_sql('x.raw_response')} AS t FROM (SELECT delivery_id, unnest(attempts) AS x, unnest(range(len(attempts)))::INT AS k FROM calls) WHERE x.raw_response IS NOT NULL),
b AS (SELECT *, regexp_extract(t, '(?s)(\\{{.*\\}})', 1) AS i FROM a)
SELECT delivery_id, k, CASE WHEN starts_with(t, '{{') AND json_type(try_cast(t AS JSON)) = 'OBJECT' THEN 'strict' WHEN starts_with(i, '{{') AND json_type(try_cast(i AS JSON)) = 'OBJECT' THEN 'inner' ELSE 'none' END AS found FROM b""")
def json_objects(spark: SparkSession, d: str) -> DataFrame:
    """Whether a raw response is a JSON object, or holds one from its first brace to its last."""
    a = table(spark, d, "calls").select("delivery_id", F.posexplode("attempts").alias("k", "x")).where("x.raw_response is not null")
    t, got = T.unfence("x.raw_response"), T.json_object("x.raw_response")
    return a.select("delivery_id", "k", F.when(got.isNull(), "none").when(got == t, "strict").otherwise("inner").alias("found"))


@query(f"""WITH f AS (SELECT ord, list_concat([answer], coalesce(answer_aliases, [])) AS v FROM families), k AS (SELECT ord, v, list_transform(v, lambda a: {normal_sql('a')}) AS ks FROM f)
SELECT ord, array_to_string(list_filter(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN ks[i] <> '' AND list_position(ks, ks[i]) = i THEN v[i] END), lambda a: a IS NOT NULL), '|') AS answers FROM k""")
def distinct_answers(spark: SparkSession, d: str) -> DataFrame:
    """Accepted answers, the first spelling of each."""
    all_ = F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>")))
    return table(spark, d, "families").select("ord", F.array_join(T.distinct_by(all_), "|").alias("answers"))


@query("""SELECT model_alias, sum(CASE WHEN a.usage.in_tokens IS NULL THEN 0 ELSE a.usage.in_tokens END)::BIGINT AS in_tokens, sum(coalesce(a.usage.out_tokens, 0))::BIGINT AS out_tokens,
  avg(a.latency_seconds) AS latency FROM (SELECT model_alias, unnest(attempts) AS a FROM calls) GROUP BY model_alias""")
def usage(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "calls").select("model_alias", F.explode("attempts").alias("a"))
    return a.groupBy("model_alias").agg(F.sum(F.coalesce("a.usage.in_tokens", F.lit(0))).alias("in_tokens"), F.sum(F.coalesce("a.usage.out_tokens", F.lit(0))).alias("out_tokens"), F.avg("a.latency_seconds").alias("latency"))
