"""Retention times attached from a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.schema import PRECURSOR_KEY, DataError, numeric, require

DEFAULT_RT = "NormalizedRetentionTime"


def parse_key(text: str) -> list[str]:
    if not (names := [x.strip() for x in text.split(",") if x.strip()]):
        raise ValueError("a key needs a column")
    return names


def _norm(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    if kind == "string":
        return F.trim(c)
    return F.col(c).cast("bigint").cast("string") if kind in ("int", "bigint", "smallint", "tinyint", "double", "float") else F.trim(F.col(c).cast("string"))


def rt_by_key(rt: DataFrame, key: Sequence[str], column: str, order: Sequence[str] | None = None) -> DataFrame:
    """One row a key: its first time that is not null, its rows, and its distinct times."""
    require(rt, [*key, column])
    value = numeric(column)
    at = F.struct(*order) if order else F.monotonically_increasing_id()
    rows = rt.select(*[_norm(rt, c).alias(f"_specloom_{i}") for i, c in enumerate(key)], value.alias("t"), at.alias("o"))
    return rows.groupBy(*[f"_specloom_{i}" for i in range(len(key))]).agg(F.min_by("t", F.when(F.col("t").isNotNull(), F.col("o"))).alias("t"), F.count("*").alias("n"), F.count_distinct("t").alias("times"))


def attach(library: DataFrame, rt: DataFrame, column: str, key: Sequence[str] = PRECURSOR_KEY, output: str = DEFAULT_RT, order: Sequence[str] | None = None) -> DataFrame:
    """A left join by normalised key columns; null keys match nothing; an existing output column is replaced."""
    require(library, key)
    times = rt_by_key(rt, key, column, order)
    left = library.drop(output).withColumns({f"_specloom_l{i}": _norm(library, c) for i, c in enumerate(key)})
    on = [F.col(f"_specloom_l{i}") == F.col(f"_specloom_{i}") for i in range(len(key))]
    joined = left.join(times.withColumnRenamed("t", output).drop("n", "times"), on, "left")
    return joined.drop(*[f"_specloom_{x}{i}" for i in range(len(key)) for x in ("", "l")])


def stats(library: DataFrame, rt: DataFrame, column: str, key: Sequence[str] = PRECURSOR_KEY, output: str = DEFAULT_RT, order: Sequence[str] | None = None) -> DataFrame:
    """One row: rows and precursors, matched and not, and duplicate and conflicting keys of the table."""
    keys = rt_by_key(rt, key, column, order).agg(F.sum("n").cast("bigint").alias("n_rt_rows"), F.count("*").alias("n_rt_unique_keys"), F.sum(F.col("n") - 1).cast("bigint").alias("n_rt_duplicate_key_rows"), F.count_if(F.col("times") > 1).alias("n_rt_keys_with_conflicting_values"))
    by = attach(library, rt, column, key, output, order).groupBy(*PRECURSOR_KEY).agg(F.count("*").alias("n"), F.count(output).alias("m"))
    rows = by.agg(F.sum("n").cast("bigint").alias("n_library_rows"), F.count("*").alias("n_library_precursors"), F.sum("m").cast("bigint").alias("n_matched_library_rows"), F.count_if(F.col("m") > 0).alias("n_matched_precursors"))
    rows = rows.withColumn("n_unmatched_library_rows", F.col("n_library_rows") - F.col("n_matched_library_rows")).withColumn("n_unmatched_precursors", F.col("n_library_precursors") - F.col("n_matched_precursors"))
    rows = rows.withColumn("pct_matched_precursors", F.coalesce(100.0 * F.try_divide("n_matched_precursors", "n_library_precursors"), F.lit(0.0)))
    return rows.crossJoin(keys)  # one row each


def check_match_rate(row: dict, least: float) -> None:
    if row["pct_matched_precursors"] / 100 < least:
        raise DataError(f"{row['pct_matched_precursors']:.2f} % of precursors have a retention time; {100 * least:.2f} % are asked for")
