"""Control libraries: random transitions, and reversed intensities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.operators.select import by_precursor, deduplicate, ties
from specloom.schema import PRECURSOR_KEY, TRANSITION_KEY, positive


def random_n(df: DataFrame, n: int, seed: int = 42, order: Sequence[str] | None = None, dedup: bool = True) -> DataFrame:
    """n transitions of each precursor, those of least seeded MD5: uniform, and the same under any partitioning."""
    positive("top_n", n)
    rows = deduplicate(by_precursor(df), order) if dedup else by_precursor(df)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in TRANSITION_KEY]))
    w = W.partitionBy(*PRECURSOR_KEY).orderBy(key, F.asc_nulls_last("ProductMz"), *ties(rows, order))
    return rows.withColumn("_specloom_r", F.row_number().over(w)).where(F.col("_specloom_r") <= n).drop("_specloom_r")


def reverse_intensity(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The i-th least intense row of a precursor gets its i-th greatest intensity; rows and other columns stay.

    Each row goes twice, as itself and as a bare intensity; the rows are ranked from below, the intensities from above, and what has one
    rank meets in a window. All windows share one exchange by precursor, and no row holds another's values.
    """
    side, value, last = F.col("_specloom_side"), F.col("LibraryIntensity"), ties(df, order)
    keep = ["LibraryIntensity", *PRECURSOR_KEY]
    both = by_precursor(df).withColumn("_specloom_side", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.select(*[c if c in keep else F.when(side == 0, F.col(c)).alias(c) for c in df.columns], "_specloom_side")
    from_end = [F.when(side == 0, value.isNull()).otherwise(value.isNotNull()), F.when(side == 0, value).otherwise(-value)]
    both = both.withColumn("_specloom_r", F.row_number().over(W.partitionBy(*PRECURSOR_KEY, "_specloom_side").orderBy(*from_end, *last)))
    mirrored = F.max(F.when(side == 1, value)).over(W.partitionBy(*PRECURSOR_KEY, "_specloom_r"))
    return both.withColumn("LibraryIntensity", mirrored).where(side == 0).drop("_specloom_side", "_specloom_r").select(*df.columns)
