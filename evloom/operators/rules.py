"""Rules as data: every rule is a named condition, a row's verdict is the array of names that hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in the order given; a NULL condition does not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def first_reason(rules: dict[str, Column]) -> Column:
    """The first name whose condition holds; NULL if none."""
    out = F.lit(None).cast("string")
    for name, c in reversed(rules.items()):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def route(df: DataFrame, why: Column, name: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(rows without reasons, rows with them)."""
    judged = df.withColumn(name, why)
    return judged.where(F.size(name) == 0).drop(name), judged.where(F.size(name) > 0)


def reason_counts(df: DataFrame, by: list[str], name: str = "reasons") -> DataFrame:
    """How many rows each reason was given to."""
    return df.select(*by, F.explode(name).alias("reason")).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def all_true(dimensions: list[Column]) -> Column:
    """Forward gate: every dimension is known and true."""
    out = F.lit(True)
    for d in dimensions:
        out = out & F.coalesce(d, F.lit(False))
    return out


def none_true(defects: list[Column]) -> Column:
    """Reverse gate: every defect is known and false."""
    out = F.lit(True)
    for d in defects:
        out = out & F.coalesce(~d, F.lit(False))
    return out
