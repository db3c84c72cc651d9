"""Queries over deliveries and nested records (problems 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import messages, nested
from ..session import table
from .text_queries import REQUEST_BODY, canonical_sql


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls")
    return messages.repeated_deliveries(calls, messages.call_message_keys(), ["delivered_at"], "delivery_id")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls").select("delivery_id", "sample_id", "request_hash", "created_at", "delivered_at", "status", "batch_id")
    return messages.exactly_once(calls, messages.call_message_keys(), ["delivered_at"], "delivery_id").select("delivery_id", "status", "batch_id")


def p7_per_batch(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls").select("delivery_id", "sample_id", "request_hash", "created_at", "delivered_at", "batch_id")
    gone = messages.repeated_deliveries(calls, messages.call_message_keys(), ["delivered_at"], "delivery_id").withColumn("again", F.lit(1))
    return calls.join(gone, "delivery_id", "left").groupBy("batch_id").agg(F.count(F.lit(1)).alias("deliveries"), F.sum(F.coalesce("again", F.lit(0))).alias("repeated"))


_P7 = r"""
WITH k AS (SELECT delivery_id, status, batch_id, delivered_at, nullif(regexp_replace(sample_id, '^\s+|\s+$', '', 'g'), '') AS s,
  lower(nullif(regexp_replace(request_hash, '^\s+|\s+$', '', 'g'), '')) AS h,
  try_cast(CASE WHEN regexp_matches(trim(created_at), '(Z|[+-]\d\d:?\d\d)$') THEN trim(created_at) ELSE trim(created_at) || '+00:00' END AS timestamptz) AS t FROM calls),
r AS (SELECT *, s IS NOT NULL AND h IS NOT NULL AND t IS NOT NULL AND
  row_number() OVER (PARTITION BY s, h, t ORDER BY delivered_at, delivery_id) > 1 AS again FROM k)
"""

P6_PATHS = """
WITH r AS (SELECT record_id, try_cast(payload AS JSON) AS j FROM raw_records WHERE payload IS NOT NULL),
i AS (SELECT record_id, j, CASE WHEN json_type(j->'initial_state') = 'VARCHAR' THEN try_cast(j->>'initial_state' AS JSON) ELSE j->'initial_state' END AS s FROM r),
lists(record_id, entity, l) AS (
  SELECT record_id, 'attempt', j->'constructor'->'editor'->'attempts' FROM i UNION ALL
  SELECT record_id, 'evidence', s->'evidence' FROM i UNION ALL
  SELECT record_id, 'minimal_edit', s->'minimal_edit' FROM i UNION ALL
  SELECT record_id, 'request_body', j->'constructor'->'request_body' FROM i UNION ALL
  SELECT record_id, 'response_format', j->'constructor'->'request_body'->'response_format' FROM i),
top AS (SELECT record_id, entity, unnest(x) AS o, unnest(range(1, len(x) + 1)) AS k FROM
  (SELECT record_id, entity, CASE json_type(l) WHEN 'ARRAY' THEN CAST(l AS JSON[]) WHEN 'OBJECT' THEN [l] END AS x FROM lists)),
err AS (SELECT record_id, node, unnest(x) AS o, unnest(range(1, len(x) + 1)) AS k FROM
  (SELECT record_id, k::VARCHAR AS node, CASE json_type(o->'errors') WHEN 'ARRAY' THEN CAST(o->'errors' AS JSON[]) WHEN 'OBJECT' THEN [o->'errors'] END AS x FROM top WHERE entity = 'attempt')),
span AS (SELECT record_id, node, unnest(x) AS o, unnest(range(1, len(x) + 1)) AS k FROM
  (SELECT record_id, node || '.' || k AS node, CASE json_type(o->'spans') WHEN 'ARRAY' THEN CAST(o->'spans' AS JSON[]) WHEN 'OBJECT' THEN [o->'spans'] END AS x FROM err)),
found AS (
  SELECT record_id, entity, k::VARCHAR AS node FROM top WHERE json_type(o) = 'OBJECT' UNION ALL
  SELECT record_id, 'error', node || '.' || k FROM err WHERE json_type(o) = 'OBJECT' UNION ALL
  SELECT record_id, 'span', node || '.' || k FROM span WHERE json_type(o) = 'OBJECT')
"""


def p6_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return nested.occurrences(table(spark, d, "raw_records"), "record_id", "payload")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_occurrences(spark, d).where(F.col("entity").isin(*nested.ENTITIES)).select("record_id", "entity", "node")


def p6_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(p6_occurrences(spark, d))


def p6_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridge(p6_occurrences(spark, d), "record_id")


def p6_entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("record_id").alias("records"))


def p6_attempts(spark: SparkSession, d: str) -> DataFrame:
    return nested.attempts_table(table(spark, d, "calls"))


def p6_structural_errors(spark: SparkSession, d: str) -> DataFrame:
    return nested.structural_errors_table(table(spark, d, "calls"))


def p6_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Records without rows, and why."""
    return nested.rejected(table(spark, d, "raw_records"), "record_id", "payload")


def p6_error_codes(spark: SparkSession, d: str) -> DataFrame:
    """The code of every error, from the objects that the occurrences point to: objects stand once, occurrences keep every place."""
    occ = p6_occurrences(spark, d).where("entity = 'error'")
    codes = nested.objects(occ).select("object_id", F.get_json_object("content", "$.code").alias("code"))
    return occ.select("record_id", "node", "object_id").join(codes, "object_id").select("record_id", "node", "code")


def p6_call_objects(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct object of attempts and request bodies of calls, once."""
    return nested.objects(nested.typed_occurrences(table(spark, d, "calls"), "delivery_id", ["attempts", "request_body"]))


def p6_call_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridge(nested.typed_occurrences(table(spark, d, "calls"), "delivery_id", ["attempts", "request_body"]), "delivery_id")


def p6_state_objects(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct object of initial states, evidence and edits of families, once."""
    return nested.objects(nested.typed_occurrences(table(spark, d, "families"), "ord", ["initial_state"]))


def p6_state_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridge(nested.typed_occurrences(table(spark, d, "families"), "ord", ["initial_state"]), "ord")


def p6_request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Distinct request bodies under their identity."""
    return nested.request_bodies(table(spark, d, "calls"))[0]


def p6_request_bridge(spark: SparkSession, d: str) -> DataFrame:
    """The body of every delivery."""
    return nested.request_bodies(table(spark, d, "calls"))[1]


def p6_request_objects(spark: SparkSession, d: str) -> DataFrame:
    """Distinct request bodies with all their fields, by body_id."""
    return nested.request_objects(table(spark, d, "calls"))[0]


def p6_request_lists(spark: SparkSession, d: str) -> DataFrame:
    """Elements of stop and required, by body_id and position."""
    return nested.request_objects(table(spark, d, "calls"))[1]


def p6_request_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The body of every delivery."""
    return nested.request_objects(table(spark, d, "calls"))[2]


def p6_evidence(spark: SparkSession, d: str) -> DataFrame:
    return nested.evidence_table(table(spark, d, "families"))


def p6_edits(spark: SparkSession, d: str) -> DataFrame:
    return nested.states_table(table(spark, d, "families"))


_BODY = f"sha256({canonical_sql('b', REQUEST_BODY)})"

QUERIES = {f.__name__: f for f in (p6_found, p6_objects, p6_bridge, p6_entity_counts, p6_rejects, p6_error_codes, p6_call_objects, p6_call_bridge, p6_state_objects, p6_state_bridge, p6_attempts, p6_structural_errors, p6_request_bodies, p6_request_bridge, p6_request_objects, p6_request_lists, p6_request_deliveries, p6_evidence, p6_edits, p7_found, p7_kept, p7_per_batch)}

SQL = {
    "p7_found": _P7 + "SELECT delivery_id FROM r WHERE again",
    "p7_kept": _P7 + "SELECT delivery_id, status, batch_id FROM r WHERE NOT again",
    "p7_per_batch": _P7 + "SELECT batch_id, count(*) AS deliveries, sum(again::INT)::BIGINT AS repeated FROM r GROUP BY batch_id",
    "p6_found": P6_PATHS + "SELECT record_id, entity, node FROM found",
    "p6_entity_counts": P6_PATHS + "SELECT entity, count(*) AS objects, count(DISTINCT record_id) AS records FROM found GROUP BY entity",
    "p6_attempts": """SELECT delivery_id, k AS ordinal, a.attempt AS attempt, a.raw_response AS raw_response, a.api_error AS api_error, a.parse_error AS parse_error,
        a.latency_seconds AS latency_seconds, a.usage.in_tokens AS in_tokens, a.usage.out_tokens AS out_tokens
        FROM (SELECT delivery_id, unnest(attempts) AS a, unnest(range(1, len(attempts) + 1))::INT AS k FROM calls) WHERE a IS NOT NULL""",
    "p6_structural_errors": """SELECT delivery_id, ak AS attempt_ordinal, k AS ordinal, error FROM (
        SELECT delivery_id, ak, unnest(a.structural_errors) AS error, unnest(range(1, len(a.structural_errors) + 1))::INT AS k FROM (
        SELECT delivery_id, unnest(attempts) AS a, unnest(range(1, len(attempts) + 1))::INT AS ak FROM calls)) WHERE error IS NOT NULL""",
    "p6_request_bodies": f"""SELECT {_BODY} AS body_id, count(*) AS deliveries, b.temperature AS temperature, b.top_p AS top_p, b.max_tokens AS max_tokens, b.seed AS seed,
        array_to_string(b.stop, '|') AS stop, b.chat_template_kwargs.enable_thinking AS enable_thinking, b.chat_template_kwargs.thinking_budget AS thinking_budget,
        b.response_format.type AS format_type, b.response_format.json_schema.name AS schema_name, array_to_string(b.response_format.json_schema.required, '|') AS required
        FROM (SELECT request_body AS b FROM calls WHERE request_body IS NOT NULL) GROUP BY b""",
    "p6_request_bridge": f"SELECT delivery_id, {_BODY} AS body_id FROM (SELECT delivery_id, request_body AS b FROM calls WHERE request_body IS NOT NULL)",
    "p6_request_deliveries": f"SELECT delivery_id, {_BODY} AS body_id FROM (SELECT delivery_id, request_body AS b FROM calls WHERE request_body IS NOT NULL)",
    "p6_request_objects": f"""SELECT {_BODY} AS body_id, count(*) AS deliveries, b.temperature AS temperature, b.top_p AS top_p, b.max_tokens AS max_tokens, b.seed AS seed, len(b.stop)::INT AS stop_length,
        b.chat_template_kwargs.enable_thinking AS enable_thinking, b.chat_template_kwargs.thinking_budget AS thinking_budget, b.response_format.type AS format_type,
        b.response_format.json_schema.name AS schema_name, b.response_format.json_schema.strict AS strict, len(b.response_format.json_schema.required)::INT AS required_length
        FROM (SELECT request_body AS b FROM calls WHERE request_body IS NOT NULL) GROUP BY b""",
    "p6_request_lists": f"""WITH o AS (SELECT DISTINCT {_BODY} AS body_id, b FROM (SELECT request_body AS b FROM calls WHERE request_body IS NOT NULL)),
        l AS (SELECT body_id, 'stop' AS list, b.stop AS x FROM o UNION ALL SELECT body_id, 'required', b.response_format.json_schema.required FROM o)
        SELECT body_id, list, unnest(range(1, len(x) + 1))::INT AS ordinal, unnest(x) AS element FROM l""",
    "p6_rejects": """SELECT record_id, CASE WHEN payload IS NULL OR trim(payload) = '' THEN 'EMPTY' WHEN try_cast(payload AS JSON) IS NULL THEN 'NOT_JSON' ELSE 'NO_OBJECT' END AS reason
        FROM raw_records WHERE payload IS NULL OR trim(payload) = '' OR try_cast(payload AS JSON) IS NULL OR json_type(try_cast(payload AS JSON)) <> 'OBJECT'""",
    "p6_error_codes": P6_PATHS + "SELECT record_id, node || '.' || k AS node, o->>'code' AS code FROM err WHERE json_type(o) = 'OBJECT'",
    "p6_evidence": """SELECT ord, family_id, k AS ordinal, e.document_id AS document_id, e.title AS title, e.text AS text FROM (
        SELECT ord, family_id, unnest(initial_state.evidence) AS e, unnest(range(1, len(initial_state.evidence) + 1))::INT AS k FROM families) WHERE e IS NOT NULL""",
    "p6_edits": """SELECT ord, family_id, s.state AS state, s.missing_information AS missing_information, s.conflict_target AS conflict_target, s.original_claim AS original_claim, s.conflicting_claim AS conflicting_claim, s.original_value AS original_value,
        s.conflicting_value AS conflicting_value, s.minimal_edit.document_id AS edit_document_id, s.minimal_edit.original_span AS original_span,
        s.minimal_edit.replacement_span AS replacement_span, s.minimal_edit.appended_text AS appended_text
        FROM (SELECT ord, family_id, initial_state AS s FROM families WHERE initial_state IS NOT NULL)""",
}
