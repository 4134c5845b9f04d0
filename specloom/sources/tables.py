"""Tables, libraries and FASTA from and to files."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import specloom
from specloom.schema import LIBRARY_COLUMNS, normalize, require

FORMS = {".parquet": None, ".tsv": "\t", ".tsv.gz": "\t", ".csv": ",", ".csv.gz": ","}


def form_of(path: str) -> str:
    low = str(path).lower()
    for end in sorted(FORMS, key=len, reverse=True):
        if low.endswith(end):
            return end
    raise ValueError(f"{path}: the name must end in one of {', '.join(FORMS)}")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def must_exist(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its file name's end. Text columns are inferred unless a schema is given; empty fields are null."""
    end = form_of(path)
    must_exist(spark, path)
    if end == ".parquet":
        return spark.read.parquet(str(path))
    reader = spark.read.options(header=True, sep=FORMS[end], nullValue="", emptyValue="")
    return strip_headers((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(str(path)))


def with_order(df: DataFrame, name: str = "_specloom_ord") -> DataFrame:
    """A last tie-breaker: the order of rows in their files."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_library(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return with_order(normalize(read_table(spark, path, schema)))


def write_table(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Writes by the name's end. ``single_file`` gathers all rows in one file, for tools that need that."""
    end = form_of(path)
    out = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    if end == ".parquet":
        out.parquet(str(path))
    else:
        out.options(header=True, sep=FORMS[end], compression="gzip" if end.endswith(".gz") else "none").csv(str(path))


def write_library(df: DataFrame, path: str, single_file: bool = False) -> None:
    require(df, LIBRARY_COLUMNS)
    write_table(df, path, single_file)


def sidecar_paths(path: str) -> tuple[str, str]:
    p = PurePosixPath(str(path))
    end = form_of(str(path))
    stem = str(path)[: -len(end)] if p.name.lower().endswith(end) else str(path)
    return f"{stem}.summary.tsv", f"{stem}.params.json"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_summary(spark: SparkSession, row: dict[str, Any], path: str) -> None:
    line = lambda xs: "\t".join("" if x is None else str(x) for x in xs)
    _write_text(spark, path, line(row) + "\n" + line(row.values()) + "\n")


def read_summaries(spark: SparkSession, paths: list[str]) -> list[dict[str, Any]]:
    """Rows of summary files, a line each, as text; absent fields are missing keys."""
    rows = []
    for path in paths:
        names, values = (line["value"].split("\t") for line in spark.read.text(path).limit(2).collect())
        rows.append({k: v for k, v in zip(names, values, strict=True) if v != ""})
    return rows


def write_json(spark: SparkSession, content: dict[str, Any], path: str) -> None:
    _write_text(spark, path, json.dumps(content, indent=2, default=str) + "\n")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_params(spark: SparkSession, params: dict[str, Any], path: str) -> None:
    _write_text(spark, path, json.dumps({"version": specloom.__version__, **params}, indent=2, default=str) + "\n")


def merge_tables(spark: SparkSession, paths: list[str], path: str, columns: list[str] | None = None, single_file: bool = True, order: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Chunks as one table, with the chosen columns, sorted by ``order``; the commit of the writer makes it atomic."""
    if not paths:
        raise ValueError("there are no chunks to merge")
    if {form_of(p) for p in paths} == {".parquet"}:
        merged = spark.read.option("mergeSchema", True).parquet(*paths)
    else:
        merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_table(spark, p) for p in paths])
    if columns:
        require(merged, columns)
        merged = merged.select(*columns)
    write_table(order(merged) if order else merged, path, single_file)
    return merged


def protein_id(header):
    """The header's first word; of a|b|..., b if it is not empty."""
    token = F.get(F.split(F.trim(header), r"\s+"), F.lit(0))
    second = F.get(F.split(token, "[|]"), F.lit(1))
    return F.when(F.coalesce(second, F.lit("")) != "", second).otherwise(token)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, description, sequence). Records are split at '>' that begins a line, so large files are read in parallel;
    text before the first header is dropped, '*' is dropped, and sequences are upper-cased."""
    must_exist(spark, path)
    records = spark.read.option("lineSep", "\n>").text(str(path)).where("trim(value) <> ''")
    head = records.select(F.col("value"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    first = head.groupBy("f").agg(F.min("i").alias("m"))  # one row a file
    head = head.join(F.broadcast(first), "f").withColumn("value", F.when(F.col("i") == F.col("m"), F.col("value")).otherwise(F.concat(F.lit(">"), "value"))).select("value", "i")
    # headers that are indented stay inside a record: split it again
    parts = head.select("i", F.posexplode(F.split(F.concat(F.lit("\n"), "value"), r"\r?\n[ \t]*>")).alias("j", "record")).where("j > 0")
    lines = F.split(F.col("record"), r"\r?\n")
    description = F.trim(F.get(lines, F.lit(0)))
    sequence = F.upper(F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), ""), r"[\s*]", ""))
    return parts.select(protein_id(description).alias("protein_id"), description.alias("description"), sequence.alias("sequence"))


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"^\s+|\s+$", "", c) for c in df.columns])
