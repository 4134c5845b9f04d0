"""Two libraries: union of the most intense, rank consensus, and how they overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.operators.select import by_precursor, deduplicate, ranked, ties, top_n
from specloom.schema import PRECURSOR_KEY, TRANSITION_KEY, positive


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("_specloom_src", F.lit(0)).unionByName(b.withColumn("_specloom_src", F.lit(1)), allowMissingColumns=True)


def _prefer_a(df: DataFrame, order: Sequence[str] | None) -> DataFrame:
    w = W.partitionBy(*TRANSITION_KEY).orderBy("_specloom_src", F.asc_nulls_last("ProductMz"), *ties(df, order))
    return df.withColumn("_specloom_one", F.row_number().over(w)).where("_specloom_one = 1").drop("_specloom_one")


def union(a: DataFrame, b: DataFrame, n: int, order: Sequence[str] | None = None) -> DataFrame:
    """The n most intense of each input; a transition in both is a's row, with a's intensity."""
    return _prefer_a(_both(top_n(a, n, order), top_n(b, n, order)), order).drop("_specloom_src")


def consensus(a: DataFrame, b: DataFrame, n: int, order: Sequence[str] | None = None) -> DataFrame:
    """The n best by 1/rank in a + 1/rank in b, with ConsensusScore, RankA and RankB.

    The ranks travel with the rows, so both inputs meet in one window by transition instead of joins.
    """
    positive("top_n", n)
    rows = _both(*(ranked(deduplicate(by_precursor(x), order), order, "_specloom_r") for x in (a, b)))
    every = W.partitionBy(*TRANSITION_KEY)
    rank_in = lambda i: F.max(F.when(F.col("_specloom_src") == i, F.col("_specloom_r"))).over(every)
    rows = rows.withColumns({"RankA": rank_in(0), "RankB": rank_in(1)})
    rows = _prefer_a(rows, order)
    rows = rows.withColumn("ConsensusScore", F.coalesce(1 / F.col("RankA"), F.lit(0.0)) + F.coalesce(1 / F.col("RankB"), F.lit(0.0)))
    last = [F.asc_nulls_last(c) for c in ("FragmentType", "FragmentSeriesNumber", "FragmentCharge", "ProductMz")]
    w = W.partitionBy(*PRECURSOR_KEY).orderBy(F.desc("ConsensusScore"), F.asc_nulls_last("RankA"), F.asc_nulls_last("RankB"), *last)
    return rows.withColumn("_specloom_k", F.row_number().over(w)).where(F.col("_specloom_k") <= n).drop("_specloom_k", "_specloom_src", "_specloom_r")


def input_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: precursors and transitions of both inputs as they are, and common, a-only and b-only precursors."""
    rows = a.select(*PRECURSOR_KEY, F.lit(0).alias("src")).unionByName(b.select(*PRECURSOR_KEY, F.lit(1).alias("src")))
    by = rows.groupBy(*PRECURSOR_KEY).agg(F.count_if(F.col("src") == 0).alias("na"), F.count_if(F.col("src") == 1).alias("nb"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return by.agg(
        F.count_if(F.col("na") > 0).alias("n_precursors_input_a"), F.count_if(F.col("nb") > 0).alias("n_precursors_input_b"),
        total("na").alias("n_transitions_input_a"), total("nb").alias("n_transitions_input_b"),
        F.count_if((F.col("na") > 0) & (F.col("nb") > 0)).alias("n_common_precursors"),
        F.count_if((F.col("na") > 0) & (F.col("nb") == 0)).alias("n_a_only_precursors"), F.count_if((F.col("na") == 0) & (F.col("nb") > 0)).alias("n_b_only_precursors"),
    )
