"""Flat tables from deeply nested records, with Merkle identities.

Every object of a JSON record is canonicalised and hashed bottom-up: an object's identity is the SHA-256 of its
own fields in key order, with child objects replaced by their identities. Equal subtrees so have equal identities and
are stored once (`objects`); every occurrence stays as a bridge row (`occurrences`) with its parent, field and ordinal.

Parsing needs Python (shapes vary from record to record); it runs batchwise over Arrow, one pass, and the rest is JVM.
Typed nested columns (structs and arrays of a Parquet table) are flattened by JVM generators for tables of one kind; their Merkle identities come from
the same canonical form, written by to_json without NULL fields (typed_occurrences), so that an object has one identity whether it was typed or text.

Defined results: NULL, blank or invalid JSON, or JSON nested beyond the parser's depth gives no rows here, and one row of `rejected`; a field that is
absent or null, and an empty list, give no rows; a null or scalar element keeps its position and gives no row; of a key
written twice the last counts; a record that comes twice gives its rows twice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import request_hash

#: Lists (or objects where others hold a list) whose positions make up a node's address.
COUNTED = ("attempts", "errors", "spans")
#: entity: (field, field that holds the parent; None: any)
ENTITIES = {
    "attempt": ("attempts", "editor"),
    "error": ("errors", "attempts"),
    "span": ("spans", "errors"),
    "evidence": ("evidence", "initial_state"),
    "minimal_edit": ("minimal_edit", "initial_state"),
    "request_body": ("request_body", "constructor"),
    "response_format": ("response_format", "request_body"),
}
#: Fields that may hold an object as JSON text.
AS_TEXT = ("initial_state",)
_BY_FIELD = {v: k for k, v in ENTITIES.items()}

OCCURRENCE = "object_id string, parent_id string, path string, parent_path string, field string, ordinal int, entity string, node string, content string"


def merkle(record: object) -> list[dict]:
    """All objects of a parsed record, children before parents; content is the canonical own form."""
    out: list[dict] = []

    def visit(obj: dict, field: str, holder: str, path: str, up: str | None, ordinal: int, address: tuple[int, ...], siblings: list[dict]) -> str:
        own = {}
        kids: list[dict] = []
        for key in sorted(obj):
            own[key] = value(obj[key], key, field, f"{path}.{key}", path, address, kids)
        content = json.dumps(own, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        digest = hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()
        for row in kids:
            row["parent_id"] = digest
        entity = _BY_FIELD.get((field, holder)) or field
        node = ".".join(map(str, address)) if field in COUNTED else str(ordinal)
        out.append({"object_id": digest, "parent_id": None, "path": path, "parent_path": up, "field": field, "ordinal": ordinal, "entity": entity, "node": node, "content": content})
        siblings.append(out[-1])
        return digest

    def value(x: object, key: str, holder: str, path: str, up: str, address: tuple[int, ...], kids: list[dict]) -> object:
        if key in AS_TEXT and isinstance(x, str):
            try:
                parsed = json.loads(x)
            except (ValueError, RecursionError):
                parsed = None
            x = parsed if isinstance(parsed, dict) else x
        if isinstance(x, dict):
            return {"#": visit(x, key, holder, f"{path}[1]", up, 1, (*address, 1) if key in COUNTED else address, kids)}
        if isinstance(x, list):
            return [items(y, k, key, holder, path, up, address, kids) for k, y in enumerate(x, 1)]
        return x

    def items(y: object, k: int, key: str, holder: str, path: str, up: str, address: tuple[int, ...], kids: list[dict]) -> object:
        if isinstance(y, dict):
            return {"#": visit(y, key, holder, f"{path}[{k}]", up, k, (*address, k) if key in COUNTED else address, kids)}
        if isinstance(y, list):
            return [items(z, j, key, holder, f"{path}[{k}]", up, address, kids) for j, z in enumerate(y, 1)]
        return y

    if isinstance(record, dict):
        visit(record, "record", "", "$", None, 1, (), [])
    return out


def occurrences(df: DataFrame, id_col: str, payload: str) -> DataFrame:
    """A row for every object of every record: id_col and the columns of OCCURRENCE."""
    names = [c.split()[0] for c in OCCURRENCE.split(", ")]
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("rid"), F.col(payload).alias("payload")).where("payload is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32() if n == "ordinal" else pa.string() for n in names]
        for batch in batches:
            which: list[int] = []
            cols: list[list] = [[] for _ in names]
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    rows = merkle(json.loads(text))
                except (ValueError, RecursionError):
                    continue
                which += [i] * len(rows)
                for col, name in zip(cols, names):
                    col.extend(r[name] for r in rows)
            ids = batch.column(0).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, types)]], names=["rid", *names])

    return source.mapInArrow(run, f"rid {kind}, {OCCURRENCE}").withColumnRenamed("rid", id_col)


def typed_occurrences(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """occurrences of typed nested columns: a record is an object of the columns that are not NULL."""
    return occurrences(df.select(id_col, F.to_json(F.struct(*columns)).alias("payload")), id_col, "payload")


def rejected(df: DataFrame, id_col: str, payload: str) -> DataFrame:
    """id_col, reason of every record that gives no rows: EMPTY (NULL or blank), NOT_JSON, TOO_DEEP (for the parser), NO_OBJECT (JSON of another kind)."""
    kind = df.schema[id_col].dataType.simpleString()

    def why(text: str | None) -> str | None:
        if text is None or not text.strip():
            return "EMPTY"
        try:
            return None if isinstance(json.loads(text), dict) else "NO_OBJECT"
        except RecursionError:
            return "TOO_DEEP"
        except ValueError:
            return "NOT_JSON"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([why(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["rid", "reason"]).filter(found.is_valid())

    return df.select(F.col(id_col).alias("rid"), F.col(payload).alias("payload")).mapInArrow(run, f"rid {kind}, reason string").withColumnRenamed("rid", id_col)


def objects(occ: DataFrame) -> DataFrame:
    """Each distinct object once, with how often it occurs; partial aggregation keeps hot objects off the shuffle."""
    return occ.groupBy("object_id").agg(F.first("entity").alias("entity"), F.first("content").alias("content"), F.count(F.lit(1)).alias("occurrences"))


def bridge(occ: DataFrame, id_col: str) -> DataFrame:
    """Parent-child rows: every occurrence by its path, with field and ordinal under the parent."""
    return occ.where("parent_path is not null").select(id_col, "parent_id", "object_id", "parent_path", "path", "field", "ordinal")


def attempts_table(calls: DataFrame) -> DataFrame:
    """calls.attempts, one row per attempt that is not null, keyed by delivery_id and position from 1."""
    return calls.select("delivery_id", F.posexplode("attempts").alias("pos", "a")).where("a is not null").select(
        "delivery_id", (F.col("pos") + 1).alias("ordinal"), F.col("a.attempt").alias("attempt"), F.col("a.raw_response").alias("raw_response"),
        F.col("a.api_error").alias("api_error"), F.col("a.parse_error").alias("parse_error"), F.col("a.latency_seconds").alias("latency_seconds"),
        F.col("a.usage.in_tokens").alias("in_tokens"), F.col("a.usage.out_tokens").alias("out_tokens"))


def structural_errors_table(calls: DataFrame) -> DataFrame:
    """calls.attempts.structural_errors, keyed by delivery_id, attempt position and own position."""
    return calls.select("delivery_id", F.posexplode("attempts").alias("pos", "a")).select(
        "delivery_id", (F.col("pos") + 1).alias("attempt_ordinal"), F.posexplode("a.structural_errors").alias("k", "error")).where("error is not null").select(
        "delivery_id", "attempt_ordinal", (F.col("k") + 1).alias("ordinal"), "error")


def _identity(calls: DataFrame, column: str) -> Column:
    """SHA-256 of the canonical JSON of a request body."""
    return request_hash(F.col(column), calls.schema["request_body"].dataType)


def request_bodies(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls.request_body as (objects, bridge): distinct bodies by identity, and the delivery that holds each."""
    held = calls.where("request_body is not null").select("delivery_id", F.col("request_body").alias("b"))
    held = held.withColumn("body_id", _identity(calls, "b"))
    distinct = held.groupBy("body_id").agg(F.first("b").alias("b"), F.count(F.lit(1)).alias("deliveries")).select(
        "body_id", "deliveries", F.col("b.temperature").alias("temperature"), F.col("b.top_p").alias("top_p"), F.col("b.max_tokens").alias("max_tokens"),
        F.col("b.seed").alias("seed"), F.array_join("b.stop", "|").alias("stop"), F.col("b.chat_template_kwargs.enable_thinking").alias("enable_thinking"),
        F.col("b.chat_template_kwargs.thinking_budget").alias("thinking_budget"), F.col("b.response_format.type").alias("format_type"),
        F.col("b.response_format.json_schema.name").alias("schema_name"), F.array_join("b.response_format.json_schema.required", "|").alias("required"))
    return distinct, held.select("delivery_id", "body_id")


def request_objects(calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """calls.request_body as (bodies, lists, bridge): every field of a distinct body under body_id; elements of its lists by position, also NULL ones; the delivery that holds each.

    A list that is NULL, and one that is empty, have no elements; bodies tells them apart by the lists' lengths.
    """
    held = calls.where("request_body is not null").select("delivery_id", F.col("request_body").alias("b")).withColumn("body_id", _identity(calls, "b"))
    distinct = held.groupBy("body_id").agg(F.first("b").alias("b"), F.count(F.lit(1)).alias("deliveries"))
    schema = F.col("b.response_format.json_schema")
    length = lambda x: F.when(x.isNotNull(), F.size(x))
    bodies = distinct.select(
        "body_id", "deliveries", F.col("b.temperature").alias("temperature"), F.col("b.top_p").alias("top_p"), F.col("b.max_tokens").alias("max_tokens"), F.col("b.seed").alias("seed"),
        length(F.col("b.stop")).alias("stop_length"), F.col("b.chat_template_kwargs.enable_thinking").alias("enable_thinking"), F.col("b.chat_template_kwargs.thinking_budget").alias("thinking_budget"),
        F.col("b.response_format.type").alias("format_type"), schema["name"].alias("schema_name"), schema["strict"].alias("strict"), length(schema["required"]).alias("required_length"))
    lists = [distinct.select("body_id", F.lit(n).alias("list"), F.posexplode(x).alias("pos", "element")) for n, x in (("stop", F.col("b.stop")), ("required", schema["required"]))]
    elements = lists[0].unionByName(lists[1]).select("body_id", "list", (F.col("pos") + 1).alias("ordinal"), "element")
    return bodies, elements, held.select("delivery_id", "body_id")


def evidence_table(families: DataFrame, state: str = "initial_state") -> DataFrame:
    """Evidence documents of a state, keyed by ord (the export), family_id and position."""
    return families.select("ord", "family_id", F.posexplode(f"{state}.evidence").alias("pos", "e")).where("e is not null").select(
        "ord", "family_id", (F.col("pos") + 1).alias("ordinal"), F.col("e.document_id").alias("document_id"), F.col("e.title").alias("title"), F.col("e.text").alias("text"))


def states_table(families: DataFrame) -> DataFrame:
    """initial_state with its minimal_edit, one row per export that has one."""
    s = F.col("initial_state")
    return families.where(s.isNotNull()).select(
        "ord", "family_id", s["state"].alias("state"), s["missing_information"].alias("missing_information"), s["conflict_target"].alias("conflict_target"),
        s["original_claim"].alias("original_claim"), s["conflicting_claim"].alias("conflicting_claim"),
        s["original_value"].alias("original_value"), s["conflicting_value"].alias("conflicting_value"), s["minimal_edit"]["document_id"].alias("edit_document_id"),
        s["minimal_edit"]["original_span"].alias("original_span"), s["minimal_edit"]["replacement_span"].alias("replacement_span"), s["minimal_edit"]["appended_text"].alias("appended_text"))
