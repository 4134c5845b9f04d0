"""What SQL can say of the operators: registered beside them, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm import iblt, mixing, ngram, pii
from specloom.llm.common import WORD


def edited_texts(spark, sf_dir: str) -> DataFrame:
    """op2's edited texts."""
    rows = iblt.op2_iblt(spark, sf_dir)
    return rows.select("doc_id", "n_chars", "edited_sha256")


def base_scores(spark, sf_dir: str) -> DataFrame:
    """op1's base scores where all documents teach."""
    rows = ngram.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.lit(True))
    return rows.select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """op4's sizes and targets, and whether a document is taken at most twice."""
    rows = mixing.op4_mixing(spark, sf_dir)
    return rows.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("within"))


def pii_counts(spark, sf_dir: str) -> DataFrame:
    """op10's counts of base spans."""
    return pii.op10_bootstrap(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.KINDS])


QUERIES = {"edited_texts": edited_texts, "base_scores": base_scores, "mixing_targets": mixing_targets, "pii_counts": pii_counts}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN CASE WHEN CAST(d[i] AS INT) > 4 THEN 2 * CAST(d[i] AS INT) - 9 ELSE 2 * CAST(d[i] AS INT) END ELSE CAST(d[i] AS INT) END)) % 10 = 0"
ORACLE_SQL = {
    "edited_texts": "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first(t) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nt FROM d) SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2)) AS edited_sha256 FROM n",
    "base_scores": f"WITH w AS (SELECT doc_id, list_append(list_transform(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}'), lambda x: 'w' || x), 'end') AS ws FROM documents), t AS (SELECT doc_id, unnest(ws) AS x FROM w), c AS (SELECT x, count(*) AS c FROM t GROUP BY x), s AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c) SELECT doc_id, count(*) AS n_tokens, count(*) AS n_known, any_value(n) AS train_tokens, round(sum(log10((c + 0.5e0) / (n + 0.5e0 * (v + 1)))), 5) AS base_score FROM t JOIN c USING (x), s GROUP BY doc_id",
    "mixing_targets": f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, n, CAST([5, 2, 1][i % 3 + 1] AS DOUBLE) AS w, 2e0 * n AS most FROM s),
r AS (SELECT *, 1.5e0 * (SELECT sum(n) FROM w) - coalesce(sum(most) OVER (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_, sum(w) OVER (ORDER BY most / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM w),
f AS (SELECT *, most < left_ * w / open_ AS full_ FROM r),
u AS (SELECT *, 1.5e0 * (SELECT sum(n) FROM w) - (SELECT coalesce(sum(most), 0) FROM f WHERE full_) AS rest, (SELECT sum(w) FROM f WHERE NOT full_) AS ws FROM f)
SELECT doc_id, size, n AS source_size, round(CASE WHEN full_ THEN most ELSE rest * w / ws END, 4) AS target, true AS within FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source""",
    "pii_counts": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
 CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0)) AS BIGINT) AS n_ip,
 CAST(len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda m: {_DIGITS}), lambda d: CASE WHEN length(d) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END)) AS BIGINT) AS n_card,
 CAST(len(list_filter(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda m: length({_DIGITS}) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone FROM d""",
}
