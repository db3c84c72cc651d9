"""Queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import garbled, grouped, mixing, overlaps, responses, tokens, truncation, unify


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(table(spark, d, "calls")).select("delivery_id", "attempt", "field")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(table(spark, d, "calls"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return responses.defects(table(spark, d, "predictions"), table(spark, d, "action_fields"))


def p2_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Defective responses per model and phase."""
    of = table(spark, d, "predictions").select("response_id", "model_alias", "phase")
    return p2_found(spark, d).join(of, "response_id").groupBy("model_alias", "phase", "defect").agg(F.count(F.lit(1)).alias("responses"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.found_pairs(table(spark, d, "families"))


def p3_per_split(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping held-out families and their links per split, dataset and reason."""
    return overlaps.overlap_report(table(spark, d, "families"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped.groups(table(spark, d, "families"))


def p4_assigned(spark: SparkSession, d: str) -> DataFrame:
    """family_id, split of every family."""
    return grouped.assign(table(spark, d, "families"), table(spark, d, "split_targets"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each split."""
    targets = table(spark, d, "split_targets")
    got = p4_assigned(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("families"))
    return targets.join(got, "split", "left").crossJoin(F.broadcast(got.agg(F.sum("families").alias("all")))).select("split", "share", F.coalesce("families", F.lit(0)).alias("families"), (F.coalesce("families", F.lit(0)) / F.col("all")).alias("actual"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.affected_fields(table(spark, d, "families"))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct string of answers, aliases and evidence in its one form, with its field, how many spellings it had and how often it is used."""
    rows = unify.unify_column(unify.family_strings(table(spark, d, "families")).groupBy("field", "text").agg(F.count(F.lit(1)).alias("n")), "text")
    return rows.groupBy("field", "unified").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("uses"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, tokens, copies of the mix."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share per source."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restored(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """How each garbled document was garbled, and its text as far as it can be restored."""
    return garbled.restored(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_by_model, p3_found, p3_per_split, p4_found, p4_assigned, p4_shares, p5_found, p5_unified, p8_ids, p9_mix, p9_report, p10_found, p10_restored)}
_NOBODY = ", ".join(f"'{x}'" for x in grouped.NOBODY)

SQL: dict[str, str] = {
    "p4_found": f"""WITH RECURSIVE k AS (SELECT DISTINCT family_id, unnest(list_filter([
      's:' || nullif(regexp_replace(source_sample_id, '^\\s+|\\s+$', '', 'g'), ''), 'e:' || nullif(regexp_replace(seed_entity, '^\\s+|\\s+$', '', 'g'), ''),
      CASE WHEN lower(regexp_replace(author, '^[\\s[:punct:]]+|[\\s[:punct:]]+$', '', 'g')) NOT IN ({_NOBODY}) THEN 'a:' || coalesce(dataset, '') || ':' || regexp_replace(author, '^\\s+|\\s+$', '', 'g') END], lambda x: x IS NOT NULL)) AS key
      FROM families WHERE family_id IS NOT NULL),
    star AS (SELECT key, min(family_id) AS hub FROM k GROUP BY key), link AS (SELECT DISTINCT family_id AS a, hub AS b FROM k JOIN star USING (key)),
    both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    r(start, node) AS (SELECT DISTINCT family_id, family_id FROM k UNION SELECT r.start, both_.b FROM r JOIN both_ ON r.node = both_.a),
    g AS (SELECT start AS family_id, min(node) AS group_id, count(*) AS n FROM r GROUP BY start)
    SELECT family_id, group_id FROM g WHERE n > 1""",
}
