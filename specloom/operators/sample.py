"""A seeded sample of precursors, even over charges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.operators.filters import unsupported
from specloom.schema import PRECURSOR_KEY, require


def stratified(df: DataFrame, size: int | None, charge: str = "PrecursorCharge", seed: int = 42, drop_unsupported: bool = True, key: list[str] | None = None, sequence: str = "StrippedPeptide") -> DataFrame:
    """``size`` rows, as many of each charge (the first charges one more), those of least seeded MD5; what a charge lacks the others fill.

    The charges are few, so their quotas are one small table; no window holds more than a charge's rows, cut by WindowGroupLimit.
    """
    require(df, [charge])
    rows = df.where(~unsupported(df, sequence)) if drop_unsupported else df
    if size is None or size <= 0:
        return rows
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key or PRECURSOR_KEY]))
    rows = rows.withColumn("_specloom_h", h)
    ranked = rows.withColumn("_specloom_r", F.row_number().over(W.partitionBy(charge).orderBy("_specloom_h"))).where(F.col("_specloom_r") <= size)
    sizes = sorted((r[0] is None, r[0], r[1]) for r in rows.groupBy(charge).count().collect())  # one row a charge
    if sum(n for *_, n in sizes) <= size:
        return rows.drop("_specloom_h")
    share, more = divmod(size, len(sizes))
    quota = rows.sparkSession.createDataFrame([(c, share + (i < more)) for i, (_, c, _) in enumerate(sizes)], f"_specloom_c {dict(df.dtypes)[charge]}, _specloom_q int")
    ranked = ranked.join(F.broadcast(quota), F.col(charge).eqNullSafe(F.col("_specloom_c")))
    first = F.col("_specloom_r") <= F.col("_specloom_q")
    picked = ranked.orderBy(F.when(first, 0).otherwise(1), "_specloom_h").limit(size)
    return picked.drop(*[c for c in picked.columns if c.startswith("_specloom_")])
