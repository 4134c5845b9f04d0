"""Keys, required columns and plan-time checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names of libraries and their keys.
PRECURSOR_KEY = ["ModifiedPeptide", "PrecursorCharge"]
TRANSITION_KEY = [*PRECURSOR_KEY, "FragmentType", "FragmentSeriesNumber", "FragmentCharge"]
LIBRARY_COLUMNS = ["ModifiedPeptide", "PrecursorCharge", "PrecursorMz", "ProductMz", "LibraryIntensity", "FragmentType", "FragmentSeriesNumber", "FragmentCharge"]
#: All but the precursor's m/z must be there in a row.
CORE_COLUMNS = [c for c in LIBRARY_COLUMNS if c != "PrecursorMz"]
NUMERIC = ["PrecursorCharge", "PrecursorMz", "ProductMz", "LibraryIntensity", "FragmentSeriesNumber", "FragmentCharge"]
INTEGERS = ["PrecursorCharge", "FragmentSeriesNumber", "FragmentCharge"]
MINIMAL_COLUMNS = ["ModifiedPeptide", "StrippedPeptide", *LIBRARY_COLUMNS[1:], "ProteinId"]
HELPER = "_specloom_"


class DataError(ValueError):
    """Rows break a rule that an explicit check tests."""


def require(df: DataFrame, columns: Iterable[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def positive(name: str, value: int) -> int:
    if value < 1:
        raise ValueError(f"{name} must be at least 1")
    return value


def numeric(c: str) -> Column:
    """A number from text with NBSP, spaces or a decimal comma; null where it is none. NaN becomes null."""
    plain = F.replace(F.regexp_replace(F.col(c).cast("string"), "[\\u00A0 ]", ""), F.lit(","), F.lit("."))
    value = plain.try_cast("double")
    return F.when(~F.isnan(value), value)


def coerce_numeric_commas(df: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    text = [c for c in columns if c in df.columns and dict(df.dtypes)[c] == "string"]
    return df.withColumns({c: numeric(c) for c in text})


def normalize(df: DataFrame) -> DataFrame:
    """A library: required columns there, numbers parsed, NaN as null, incomplete rows dropped, integers truncated."""
    require(df, LIBRARY_COLUMNS)
    df = coerce_numeric_commas(df)
    real = [c for c in NUMERIC if dict(df.dtypes)[c] in ("double", "float")]
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real}).withColumn("FragmentType", F.col("FragmentType").cast("string"))
    return df.dropna(subset=CORE_COLUMNS).withColumns({c: F.col(c).cast("int") for c in INTEGERS})


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(HELPER)])


def find_name(names: Sequence[str], preferred: str | None, candidates: Sequence[str]) -> str | None:
    if preferred in names:
        return preferred
    by_lower = {c.lower(): c for c in names}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def csv_words(text: str | None) -> list[str]:
    return [x.strip().lower() for x in (text or "").split(",") if x.strip()]


def csv_ints(text: str | None) -> list[int]:
    return [int(x) for x in csv_words(text)]
