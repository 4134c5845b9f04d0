"""Ranking, deduplication and top-N of transitions.

Every operator takes ``order``: columns that break the last ties, by default the row order of the files they were read
from. One repartition by precursor serves both windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.schema import PRECURSOR_KEY, TRANSITION_KEY, drop_helpers, positive

ORDER = "_specloom_ord"


def ties(df: DataFrame, order: Sequence[str] | None) -> list[Column]:
    names = list(order) if order is not None else [ORDER] if ORDER in df.columns else []
    return [F.asc_nulls_last(c) for c in names]


def rank_order(df: DataFrame, order: Sequence[str] | None = None) -> list[Column]:
    asc = [F.asc_nulls_last(c) for c in ("FragmentType", "FragmentSeriesNumber", "FragmentCharge", "ProductMz")]
    return [F.desc_nulls_last("LibraryIntensity"), *asc, *ties(df, order)]


def by_precursor(df: DataFrame) -> DataFrame:
    return df.repartition(*PRECURSOR_KEY)


def deduplicate(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One row a transition: the most intense, then the least product m/z, then the first."""
    w = W.partitionBy(*TRANSITION_KEY).orderBy(F.desc_nulls_last("LibraryIntensity"), F.asc_nulls_last("ProductMz"), *ties(df, order))
    return df.withColumn("_specloom_dup", F.row_number().over(w)).where("_specloom_dup = 1").drop("_specloom_dup")


def ranked(df: DataFrame, order: Sequence[str] | None = None, name: str = "TransitionRank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*PRECURSOR_KEY).orderBy(*rank_order(df, order))))


def top_n(df: DataFrame, n: int, order: Sequence[str] | None = None, dedup: bool = True) -> DataFrame:
    """The n most intense transitions of each precursor."""
    positive("top_n", n)
    rows = by_precursor(df)
    rows = deduplicate(rows, order) if dedup else rows
    return ranked(rows, order, "_specloom_rank").where(F.col("_specloom_rank") <= n).drop("_specloom_rank")


def in_library_order(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """For sinks only."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in PRECURSOR_KEY], *rank_order(df, order))


def duplicates_removed(df: DataFrame) -> Column:
    """An aggregate: rows beyond one a transition."""
    return (F.count("*") - F.count_distinct(F.struct(*TRANSITION_KEY))).alias("n_duplicate_transitions_removed")


__all__ = ["by_precursor", "deduplicate", "drop_helpers", "duplicates_removed", "in_library_order", "rank_order", "ranked", "ties", "top_n"]
