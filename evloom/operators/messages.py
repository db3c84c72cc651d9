"""Exactly one copy of messages that were delivered at least once.

A message is identified by key columns. Its kept delivery is the smallest by (order columns), found by one
hash aggregation, min_by over a struct, which combines on the map side: a message delivered a million times
sends one row per input partition. Rows in which any key column is missing are messages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY, _ORDER = "__key_{}", "__order"


def trimmed(c: Column | str) -> Column:
    """Text without white space at either end; NULL where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(out != "", out)


def instant(c: Column | str) -> Column:
    """ISO-8601 text in any spelling (T or blank, Z or offset, any fraction) as an instant; without a zone it is UTC.

    NULL for text that is no date.
    """
    return trimmed(c).try_cast("timestamp")


def call_message_keys() -> dict[str, Column]:
    return {"sample_id": trimmed("sample_id"), "request_hash": F.lower(trimmed("request_hash")), "created_at": instant("created_at")}


def first_deliveries(df: DataFrame, keys: dict[str, Column], order: list[str], id_col: str) -> DataFrame:
    """One row per message with complete keys: key columns, kept (id_col of the smallest delivery), deliveries."""
    cols = [c.alias(_KEY.format(i)) for i, c in enumerate(keys.values())]
    names = [_KEY.format(i) for i in range(len(cols))]
    slim = df.select(*cols, F.struct(*[F.col(o) for o in order], F.col(id_col).alias("__id")).alias(_ORDER)).dropna(subset=names)
    return slim.groupBy(*names).agg(F.min_by(F.col(f"{_ORDER}.__id"), F.col(_ORDER)).alias("kept"), F.count(F.lit(1)).alias("deliveries"))


def repeated_deliveries(df: DataFrame, keys: dict[str, Column], order: list[str], id_col: str) -> DataFrame:
    """id_col of every delivery but the first of its message; order lists the columns that say which is first, then id_col.

    NULL key: never a repetition. NULL in an order column sorts first. Rows with the same id_col count as one delivery.
    An empty table gives no rows. Columns other than those named are not read, whatever their names.
    """
    kept = first_deliveries(df, keys, order, id_col).where("deliveries > 1")
    names = [_KEY.format(i) for i in range(len(keys))]
    rows = df.select(*[c.alias(n) for n, c in zip(names, keys.values())], F.col(id_col))
    return rows.join(kept, names).where(F.col(id_col) != F.col("kept")).select(id_col)


def exactly_once(df: DataFrame, keys: dict[str, Column], order: list[str], id_col: str) -> DataFrame:
    """df with one row per message; all its columns, and every row with missing keys, stay.

    One scan and one aggregation, the smallest struct of (order, id_col, the other columns): rows that repeat a delivery under the same id are told
    apart by their other columns, and of rows equal in all columns one stays. Columns that have no order (maps) are carried, but do not decide.
    """
    cols = [c.alias(_KEY.format(i)) for i, c in enumerate(keys.values())]
    names = [_KEY.format(i) for i in range(len(cols))]
    lone = F.when(~F.least(*[F.col(n).isNotNull() for n in names], F.lit(True)), F.monotonically_increasing_id())
    ordered = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    first = F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate([*order, id_col])], *[F.col(f"`{c}`") for c in ordered])
    keyed = df.select("*", *cols).withColumn("__lone", lone)
    if len(ordered) == len(df.columns):
        one = F.min(first)
    else:
        one = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), first)
    return keyed.groupBy(*names, "__lone").agg(one.alias("__row")).select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns])
