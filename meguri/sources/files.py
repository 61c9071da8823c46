"""Readers and writers of JSON documents, JSON lines, half-precision matrices and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole-file JSON documents of a path or pattern, with the name of each file."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.input_file_name())


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The well-formed records of JSON-lines files; blank and malformed lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def json_lines_counted(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The records of JSON-lines files, and one row with the numbers of records and of malformed lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("r"))
    ok = F.col(f"r.{BROKEN}").isNull()
    return parsed.filter(ok).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), parsed.agg(F.count_if(ok).alias("records"), F.count_if(~ok).alias("malformed"))


def lenient_records(text: DataFrame, column: str, schema: str) -> DataFrame:
    """Records in loosely written JSON: code fences and array brackets around them fall away, missing line breaks between objects do not matter."""
    bare = F.regexp_replace(F.regexp_replace(F.col(column), r"(?m)^\s*```\w*\s*$", ""), r"^\s*\[|\]\s*$", "")
    pieces = F.split(F.regexp_replace(bare, r"\}\s*,?\s*\{", "}\x01{"), "\x01")
    return text.select(F.explode(pieces).alias("piece")).select(F.from_json(F.regexp_replace(F.trim("piece"), r",\s*$", ""), schema).alias("r")).filter("r is not null").select("r.*")


def half_matrix(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``(file, row, vector)`` of files of little-endian half-precision rows of ``dim`` numbers; a file of another size is refused."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                if len(content) % (2 * dim):
                    raise ValueError(f"{name} holds no rows of {dim} half-precision numbers")
                rows = np.frombuffer(content, "<f2").reshape(-1, dim).astype(np.float32)
                yield pd.DataFrame({"file": name, "row": np.arange(len(rows)), "vector": list(rows)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, vector array<float>")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces a table; with partitions, only those that ``df`` has rows of."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)
