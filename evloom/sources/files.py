"""Files in and out: JSON lines (plain, or inside a ZIP), review tables, Markdown, checksums."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..session import ship_package


def read_jsonl(spark: SparkSession, path: str, schema: str | t.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. Strict: a bad line fails the job; else bad lines come as rows with _corrupt only."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    parsed = spark.createDataFrame([], schema).schema.add("_corrupt", "string")
    return spark.read.schema(parsed).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt lines) of a lenient read."""
    return df.where("_corrupt is null").drop("_corrupt"), df.where("_corrupt is not null").select("_corrupt")


def read_jsonl_zip(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """JSON lines of one member of each ZIP file. A ZIP is not splittable: a task reads its member as a stream, line by line."""
    ship_package(spark)
    blobs = spark.read.format("binaryFile").load(path).select("content")

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for blob in f["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z, z.open(member) as lines_:
                    batch: list[str] = []
                    for line in io.TextIOWrapper(lines_, "utf-8"):
                        if line.strip():
                            batch.append(line)
                        if len(batch) == 5000:
                            yield pd.DataFrame({"line": batch})
                            batch = []
                    yield pd.DataFrame({"line": pd.Series(batch, dtype=object)})

    return blobs.mapInPandas(lines, "line string").select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or no rows where nothing lies at path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return read_jsonl(spark, path, schema) if there else spark.createDataFrame([], schema)


def with_line_numbers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that could not be parsed, with file, for messages; good lines are left out."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where("trim(value) <> ''")
    return raw.where(F.from_json("value", schema, {"mode": "PERMISSIVE"}).isNull() | F.get_json_object("value", "$").isNull())


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; the committer publishes them at once. Without overwrite an existing folder is an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def review_table(df: DataFrame, labels: list[str]) -> DataFrame:
    """A flat table for reviewers: nested columns as JSON, and an empty column for each label."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (t.ArrayType, t.StructType, t.MapType)) else F.col(f.name) for f in df.schema.fields]
    return df.select(*flat, *[F.lit("").alias(x) for x in labels])


def write_review_csv(df: DataFrame, path: str, labels: list[str]) -> None:
    """CSV with header; the first header starts with a byte order mark, for spreadsheets."""
    table = review_table(df, labels)
    first = table.columns[0]
    table.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def markdown_section(title: Column, facts: dict[str, Column]) -> Column:
    """A heading and a list of facts."""
    lines = [F.concat(F.lit("- "), F.lit(k), F.lit(": "), F.coalesce(v.cast("string"), F.lit("—"))) for k, v in facts.items()]
    return F.concat_ws("\n", F.concat(F.lit("## "), title), F.lit(""), *lines)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256 of every file below a folder. Each file is hashed by one task, so files must fit a task's memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def oversized(spark: SparkSession, folder: str, most: int = 10_000_000, suffixes: tuple[str, ...] = (".pem", ".key", ".env")) -> DataFrame:
    """path, reason of files that are too large or of a blocked kind; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    blocked = F.lit(False)
    for s in suffixes:
        blocked = blocked | F.col("path").endswith(s)
    return files.select("path", F.when(F.col("length") > most, "TOO_LARGE").when(blocked, "BLOCKED_KIND").alias("reason")).where("reason is not null")


def load_config(path: str) -> dict:
    """A JSON configuration, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
