"""Exact summaries of libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.schema import PRECURSOR_KEY


def library_summary(df: DataFrame, top_n: int | None = None) -> DataFrame:
    """One row: precursors (null keys count), transitions, and mean, median, least and most transitions a precursor."""
    by = df.groupBy(*PRECURSOR_KEY).agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    cols = [
        F.count("*").alias("n_precursors_output"), zero(F.sum("n")).cast("bigint").alias("n_transitions_output"),
        zero(F.avg("n")).cast("double").alias("mean_transitions_per_precursor"), zero(F.median("n")).cast("double").alias("median_transitions_per_precursor"),
        zero(F.min("n")).alias("min_transitions_per_precursor"), zero(F.max("n")).alias("max_transitions_per_precursor"),
    ]
    if top_n is not None:
        cols.append(F.count_if(F.col("n") < top_n).alias("n_precursors_with_less_than_n"))
    return by.agg(*cols)


def chunk_rollup(df: DataFrame, chunk: str) -> DataFrame:
    """Counts by chunk rolled up; mean and median are exact over all precursors, not over the chunks' medians."""
    by = df.groupBy(chunk, *PRECURSOR_KEY).agg(F.count("*").alias("n"))
    return by.agg(F.count_distinct(chunk).alias("n_chunks"), F.count("*").alias("n_precursors"), F.sum("n").cast("bigint").alias("n_transitions"), F.avg("n").alias("mean"), F.median("n").cast("double").alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))


def roll_up(summaries: list[dict[str, str]], counters: list[str]) -> dict[str, int]:
    """Sums of the counters that any of the chunks' summaries hold; a row a chunk."""
    return {c: sum(int(float(s.get(c, 0))) for s in summaries) for c in counters if any(c in s for s in summaries)}
