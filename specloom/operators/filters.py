"""Transition filters, and which peptides a predictor can take."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.schema import csv_ints, csv_words


def fitting(get: Callable[[str], Column | None], fragment_types: str | None = None, fragment_charges: str | None = None, min_fragment_series: int | None = None, max_fragment_series: int | None = None, min_product_mz: float | None = None, max_product_mz: float | None = None) -> Column:
    """True for transitions that stay; ``get`` gives the column, or the field, of a name, or None if there is none.
    Empty or absent limits, and limits on absent columns, do nothing; null values fail an active one."""
    number = lambda c: get(c).try_cast("double")
    tests = [
        (csv_words(fragment_types), "FragmentType", lambda c, v: F.lower(get(c).cast("string")).isin(v)),
        (csv_ints(fragment_charges), "FragmentCharge", lambda c, v: number(c).isin([float(x) for x in v])),
        (min_fragment_series, "FragmentSeriesNumber", lambda c, v: number(c) >= v),
        (max_fragment_series, "FragmentSeriesNumber", lambda c, v: number(c) <= v),
        (min_product_mz, "ProductMz", lambda c, v: number(c) >= v),
        (max_product_mz, "ProductMz", lambda c, v: number(c) <= v),
    ]
    active = [f(c, v) for v, c, f in tests if v not in (None, []) and get(c) is not None]
    return F.coalesce(reduce(lambda a, b: a & b, active, F.lit(True)), F.lit(False))


def predicate(df: DataFrame, **limits) -> Column:
    return fitting(lambda c: F.col(c) if c in df.columns else None, **limits)


def filter_transitions(df: DataFrame, **limits) -> DataFrame:
    return df.where(predicate(df, **limits))


def filter_stats(df: DataFrame, **limits) -> DataFrame:
    kept = F.count_if(predicate(df, **limits))
    return df.agg(F.count("*").alias("n_transitions_before_transition_filters"), (F.count("*") - kept).alias("n_transitions_filtered_by_transition_filters"), kept.alias("n_transitions_after_transition_filters"))


def unsupported(df: DataFrame, sequence: str = "StrippedPeptide") -> Column:
    """Whether a peptide holds selenocysteine; modification names do not count."""
    if sequence in df.columns:
        return F.contains(F.upper(F.coalesce(sequence, F.lit(""))), F.lit("U"))
    return F.contains(F.upper(F.regexp_replace(F.coalesce("ModifiedPeptide", F.lit("")), r"[(\[][^)\]]*[)\]]", "")), F.lit("U"))


def supported_only(df: DataFrame, drop: bool, allow: bool = False) -> DataFrame:
    """``allow``: keep them (the mock can). Otherwise drop them, or fail if there are any."""
    if allow:
        return df
    if not drop and not df.where(unsupported(df)).limit(1).isEmpty():
        raise ValueError("some peptides hold selenocysteine (U); ask to drop them")
    return df.where(~unsupported(df))


def positive_intensity(df: DataFrame, drop_zero: bool = True, column: str = "LibraryIntensity") -> DataFrame:
    value = F.col(column).try_cast("double")
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return df.where(fine & (value > 0) if drop_zero else fine).withColumn(column, value)
