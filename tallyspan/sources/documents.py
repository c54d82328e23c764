"""Sources of measurement documents: JSON Lines with their hashes, and rosters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

ROSTER = "required array<string>, views array<struct<view:string,cases:array<string>>>, controls array<struct<class:string,cases:array<string>>>"


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line with the last id before it in its split, and its number there. Lines come in the order of the file."""
    split, last, n = None, None, 0
    for batch in batches:
        before, numbers = [], []
        for at, record in zip(zip(batch["file"].to_pylist(), batch["block"].to_pylist()), batch["id"].to_pylist()):
            if at != split:
                split, last, n = at, None, 0
            before.append(last)
            numbers.append(n)
            last, n = record if record is not None else last, n + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(numbers, pa.int64())], names=[*batch.schema.names, "before", "line_at"])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of JSON Lines files: (value, file, block, record, line_at, line_sha256, code).

    record is the line by schema, null where it can't be read; code is record-invalid or id-order-invalid. Ids are texts and must ascend strictly
    within a file. A null, an empty line, a carriage return and a record without an id are invalid, and the next line is held against the id before
    them. Spark splits large files by bytes; a line is known by its split's start (block) and its number in it (line_at).

    Lines are checked as a task reads them. Across splits only one row a split is compared with the one before it, so no task holds a file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = lines.withColumn("record", F.when(~F.col("value").contains("\r"), F.from_json("value", schema, {"mode": "PERMISSIVE"}))).withColumn("id", F.col("record.id").cast("string"))
    told = T.StructType([*rows.schema.fields, T.StructField("before", T.StringType()), T.StructField("line_at", T.LongType())])
    rows = rows.mapInArrow(_before, told)
    splits = rows.groupBy("file", "block").agg(F.max_by("id", F.when(F.col("id").isNotNull(), F.col("line_at"))).alias("last"))
    entry = F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(splits.select("file", "block", entry.alias("entry")), ["file", "block"])
    code = F.when(F.col("id").isNull(), "record-invalid").when(F.coalesce("before", "entry") >= F.col("id"), "id-order-invalid")
    return rows.select("value", "file", "block", "record", "line_at", F.sha2(F.encode("value", "UTF-8"), 256).alias("line_sha256"), code.alias("code"))


def roster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a roster document: (view) that must not be empty, (case_id, view) and (case_id, control_class)."""
    doc = spark.read.schema(ROSTER).option("multiLine", True).option("mode", "FAILFAST").json(path)
    pairs = lambda c, name: doc.select(F.explode(c).alias("x")).select(F.explode("x.cases").alias("case_id"), F.col(f"x.{name}").alias("y"))
    views, classes = pairs("views", "view"), pairs("controls", "class")
    return doc.select(F.explode("required").alias("view")), views.withColumnRenamed("y", "view"), classes.withColumnRenamed("y", "control_class")
