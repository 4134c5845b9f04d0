"""The registered queries over the driver's tables, with their DuckDB SQL.

``lineitem`` stands in for two libraries, ``part`` for retention times, ``documents`` for proteins. Full lineitem rows are
distinct, so all their columns break the last ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import peptide as P
from specloom.operators import combine, controls, digest, filters, predict, report, rt, sample, select
from specloom.plans import commands
from specloom.schema import LIBRARY_COLUMNS, PRECURSOR_KEY, TRANSITION_KEY, coerce_numeric_commas, normalize

ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
LIB = """SELECT concat('PEP', CAST(l_partkey AS STRING)) AS ModifiedPeptide, CAST(l_suppkey % 3 + 1 AS INT) AS PrecursorCharge, CAST(l_partkey AS DOUBLE) AS PrecursorMz,
 l_quantity * 10 + l_linenumber AS ProductMz, {intensity} AS LibraryIntensity, CASE WHEN l_returnflag = 'R' THEN 'b' ELSE 'y' END AS FragmentType,
 CAST(l_linenumber AS INT) AS FragmentSeriesNumber, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS INT) AS FragmentCharge,
 l_orderkey, l_linenumber, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate FROM {table} WHERE {where}"""
A = {"intensity": "l_extendedprice", "where": "true"}
B = {"intensity": "l_extendedprice * (1 - l_discount)", "where": "l_quantity > 10"}
K, T, L = ", ".join(PRECURSOR_KEY), ", ".join(TRANSITION_KEY), ", ".join(LIBRARY_COLUMNS)
KEPT = [*LIBRARY_COLUMNS, "l_orderkey", "l_linenumber"]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lib(spark: SparkSession, sf: str, which: dict = A) -> DataFrame:
    return spark.sql(LIB.format(table="{lineitem}", **which), lineitem=_table(spark, sf, "lineitem"))


def lib_a(spark, sf):
    return lib(spark, sf, A)


def lib_b(spark, sf):
    return lib(spark, sf, B)


def rt_table(spark, sf):
    p = _table(spark, sf, "part").where("p_size > 10")
    return p.select(F.concat(F.lit("PEP"), F.col("p_partkey").cast("string")).alias("ModifiedPeptide"), F.col("p_retailprice").alias("rt"))


def proteins(spark, sf):
    d = _table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("protein_id"), F.col("source").alias("description"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))


def words(spark, sf):
    """Short peptides of canonical residues from the proteins, as a precursor source."""
    return digest.precursor_table(proteins(spark, sf), charges="2,3")


# ---- DuckDB
TIES = ", ".join(f"{c} NULLS LAST" for c in ORDER)
DEDUP = f"SELECT * EXCLUDE (dr) FROM (SELECT *, row_number() OVER (PARTITION BY {T} ORDER BY LibraryIntensity DESC NULLS LAST, ProductMz NULLS LAST, {TIES}) AS dr FROM {{t}}) WHERE dr = 1"
RANK = f"row_number() OVER (PARTITION BY {K} ORDER BY LibraryIntensity DESC NULLS LAST, FragmentType, FragmentSeriesNumber, FragmentCharge, ProductMz, {TIES})"
CTE = "WITH lib_a AS ({a}), lib_b AS ({b}), da AS ({da}), db AS ({db}), ra AS (SELECT *, {r} AS rk FROM da), rb AS (SELECT *, {r} AS rk FROM db) ".format(
    a=LIB.format(table="lineitem", **A), b=LIB.format(table="lineitem", **B), da=DEDUP.format(t="lib_a"), db=DEDUP.format(t="lib_b"), r=RANK
)
KEEP = ", ".join(KEPT)
MASS = "map {" + ", ".join(f"'{k}': {v!r}e0" for k, v in P.RESIDUE_MASS.items()) + "}"
PROTEINS = "WITH proteins AS (SELECT CAST(doc_id AS VARCHAR) AS protein_id, source AS description, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents), "
PIECES = "pieces AS (SELECT protein_id, description, list_filter(string_split({cut}, '|'), lambda x: x <> '') AS p FROM proteins), "
CUT = {"trypsin-p": "regexp_replace(sequence, '([KR])', '\\1|', 'g')", "trypsin": "replace(regexp_replace(sequence, '([KR])', '\\1|', 'g'), '|P', 'P')"}
SPANS = "spans AS (SELECT protein_id, description, p[i] || CASE WHEN k = 1 THEN p[i + 1] ELSE '' END AS peptide, k AS missed FROM (SELECT protein_id, description, p, unnest(range(1, len(p) + 1)) AS i FROM pieces), (SELECT unnest([0, 1]) AS k) WHERE i + k <= len(p)), "
FOUND = "found AS (SELECT peptide AS StrippedPeptide, string_agg(DISTINCT protein_id, ';' ORDER BY protein_id) AS ProteinId, CAST(count(DISTINCT protein_id) AS INT) AS ProteinCount, string_agg(DISTINCT description, ';' ORDER BY description) AS ProteinDescription, CAST(min(missed) AS INT) AS MinMissedCleavages, CAST(max(missed) AS INT) AS MaxMissedCleavages FROM spans WHERE length(peptide) BETWEEN 7 AND 30 AND regexp_full_match(peptide, '[ACDEFGHIKLMNPQRSTVWY]+') GROUP BY peptide) "
PEPTIDES = {e: PROTEINS + PIECES.format(cut=c) + SPANS + FOUND for e, c in CUT.items()}
SUM = "list_sum(list_transform(string_split({s}, ''), lambda c: {m}[c] + CASE WHEN c = 'C' THEN 57.021463735 ELSE 0 END))".replace("{m}", MASS)
PRECURSORS = PEPTIDES["trypsin-p"] + ", prec AS (SELECT replace(StrippedPeptide, 'C', 'C(UniMod:4)') AS ModifiedPeptide, StrippedPeptide, z AS PrecursorCharge, (18.010564684 + " + SUM.replace("{s}", "StrippedPeptide") + " + z * 1.007276466621) / z AS PrecursorMz, ProteinId, ProteinCount FROM found, (SELECT CAST(unnest([2, 3]) AS INT) AS z)) "
FRAG = PRECURSORS + ", frag AS (SELECT *, CASE WHEN t = 'b' THEN left(StrippedPeptide, CAST(n AS INT)) ELSE right(StrippedPeptide, CAST(n AS INT)) END AS part FROM (SELECT *, unnest(range(1, length(StrippedPeptide))) AS n FROM prec), (SELECT unnest(['b', 'y']) AS t)) "
MOCK = (
    FRAG + ", mock AS (SELECT ModifiedPeptide, StrippedPeptide, PrecursorCharge, PrecursorMz, (CASE WHEN t = 'y' THEN 18.010564684 ELSE 0 END + " + SUM.replace("{s}", "part") + " + 1.007276466621) AS ProductMz, "
    "1000.0 * ((CASE WHEN t = 'y' THEN 1.0 ELSE 0.78 END) * (CAST(n AS DOUBLE) / (length(StrippedPeptide) - 1)) + 0.05 * CAST(CAST('0x' || left(md5(concat_ws('|', ModifiedPeptide, PrecursorCharge, t, n, 1)), 8) AS BIGINT) AS DOUBLE) / 4294967295.0) AS LibraryIntensity, "
    "t AS FragmentType, CAST(n AS INT) AS FragmentSeriesNumber, CAST(1 AS INT) AS FragmentCharge, ProteinId FROM frag) "
)


def q_max_n(spark, sf):
    return select.top_n(normalize(lib_a(spark, sf)), 7, ORDER).select(*KEPT)


def q_dedup(spark, sf):
    return select.deduplicate(lib_a(spark, sf), ORDER).select(*KEPT)


def q_dedup_stats(spark, sf):
    a = lib_a(spark, sf)
    return a.agg(select.duplicates_removed(a), F.count("*").alias("n_transitions_input"))


def q_rank(spark, sf):
    return select.ranked(lib_a(spark, sf), ORDER).select(*KEPT, F.col("TransitionRank").cast("bigint").alias("TransitionRank"))


def q_union(spark, sf):
    return combine.union(lib_a(spark, sf), lib_b(spark, sf), 7, ORDER).select(*KEPT)


def q_consensus(spark, sf):
    r = combine.consensus(lib_a(spark, sf), lib_b(spark, sf), 7, ORDER)
    return r.select(*KEPT, F.round("ConsensusScore", 9).alias("ConsensusScore"))


def q_input_stats(spark, sf):
    return combine.input_stats(lib_a(spark, sf), lib_b(spark, sf))


def q_random_n(spark, sf):
    return controls.random_n(lib_a(spark, sf), 3, 42, ORDER).select(*KEPT)


def q_reverse(spark, sf):
    return controls.reverse_intensity(lib_a(spark, sf), ORDER).select(*KEPT)


LIMITS = {"fragment_types": "y", "fragment_charges": "1", "min_fragment_series": 2, "max_fragment_series": 6, "min_product_mz": 50.0, "max_product_mz": 400.0}


def q_filter(spark, sf):
    return filters.filter_transitions(lib_a(spark, sf), **LIMITS).select(*KEPT)


def q_filter_stats(spark, sf):
    return filters.filter_stats(lib_a(spark, sf), **LIMITS)


def q_commas(spark, sf):
    a = lib_a(spark, sf).withColumn("LibraryIntensity", F.replace(F.col("LibraryIntensity").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")))
    return coerce_numeric_commas(a).select(*KEPT)


def q_normalize(spark, sf):
    a = lib_a(spark, sf).withColumn("LibraryIntensity", F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("LibraryIntensity"))).withColumn("FragmentCharge", F.col("FragmentCharge") + 0.7)
    return normalize(a).select(*KEPT)


def q_summary(spark, sf):
    return report.library_summary(lib_a(spark, sf), 7)


def q_rollup(spark, sf):
    return report.chunk_rollup(lib_a(spark, sf), "PrecursorCharge")


def q_attach_rt(spark, sf):
    return rt.attach(lib_a(spark, sf), rt_table(spark, sf), "rt", ["ModifiedPeptide"], order=["rt"]).select(*KEPT, "NormalizedRetentionTime")


def q_rt_stats(spark, sf):
    return rt.stats(lib_a(spark, sf), rt_table(spark, sf), "rt", ["ModifiedPeptide"], order=["rt"]).withColumn("pct_matched_precursors", F.round("pct_matched_precursors", 6))


def q_minimal(spark, sf):
    return commands.minimal(lib_a(spark, sf).withColumn("StrippedPeptide", F.col("ModifiedPeptide")).withColumn("ProteinId", F.lit("P")))


def _peptides(enzyme):
    def q(spark, sf):
        return digest.peptides(digest.digest(proteins(spark, sf), enzyme, 1))

    return q


def q_spans(spark, sf):
    whole = proteins(spark, sf).repartition("protein_id")  # each sequence is shuffled once, not its spans
    return digest.digest(whole, "trypsin", 1).groupBy("protein_id", "peptide", "missed").agg(F.count("*").alias("n"))


def q_precursors(spark, sf):
    return words(spark, sf).select("ModifiedPeptide", "StrippedPeptide", "PrecursorCharge", F.round("PrecursorMz", 6).alias("PrecursorMz"), "ProteinId", "ProteinCount")


def q_oxidation(spark, sf):
    rows = digest.precursor_table(proteins(spark, sf), charges="2", variable_oxidation_m=True)
    return rows.select("ModifiedPeptide", "StrippedPeptide", F.round("PrecursorMz", 6).alias("PrecursorMz"), "OxidationMPositions", "NVariableMods", "VariableOxidationM")


def q_rules(spark, sf):
    return digest.precursor_table(proteins(spark, sf), charges="2,3,4", charge_length_rules="4:12,3:9", min_precursor_mz=400.0, max_precursor_mz=1200.0).select("ModifiedPeptide", "PrecursorCharge", F.round("PrecursorMz", 5).alias("PrecursorMz"), "PeptideLength")


def q_digest_stats(spark, sf):
    return digest.digest_stats(proteins(spark, sf), charges="2,3")


def q_mock(spark, sf):
    m = predict.mock(words(spark, sf))
    return m.select("ModifiedPeptide", "PrecursorCharge", F.round("PrecursorMz", 3).alias("PrecursorMz"), F.round("ProductMz", 3).alias("ProductMz"), F.round("LibraryIntensity", 3).alias("LibraryIntensity"), "FragmentType", "FragmentSeriesNumber", "FragmentCharge", "ProteinId")


def q_mock_max_n(spark, sf):
    m = commands.predicted(words(spark, sf), top_n=3)
    return m.select("ModifiedPeptide", "PrecursorCharge", F.round("LibraryIntensity", 3).alias("LibraryIntensity"), "FragmentType", "FragmentSeriesNumber")


def q_rt_mock(spark, sf):
    return predict.predict_rt(words(spark, sf), "mock").select("ModifiedPeptide", "PrecursorCharge", "NormalizedRetentionTime")


def q_rt_input(spark, sf):
    return predict.rt_model_input(words(spark, sf)).select("ModifiedPeptide", "PrecursorCharge", "seq", "modifications")


def q_sample(spark, sf):
    rows = lib_a(spark, sf).select(*PRECURSOR_KEY).distinct()
    return sample.stratified(rows, 100)


def q_unnest(spark, sf):
    e = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("intensities"))
    e = e.withColumn("annotation", F.transform("intensities", lambda x, i: F.concat(F.when(i % 2 == 0, "y").otherwise("b"), (i + 1).cast("string"), F.when(i % 3 == 0, "^2").otherwise(""))))
    rows = predict.unnest(e).withColumn("a", P.annotation(F.col("annotation")))
    return filters.positive_intensity(rows, column="intensities").select("vec_id", F.round("intensities", 6).alias("intensity"), "a.ion", "a.number", "a.charge")


def q_positions(spark, sf):
    e = _table(spark, sf, "events").select("event_id", F.concat_ws(";", ((F.col("event_id") % 9) + 1).cast("string"), ((F.col("event_id") % 5) + 2).cast("string")).alias("text"))
    return e.select("event_id", P.format_positions(P.parse_positions(F.col("text"))).alias("positions"))


def _three_ions(keyed: bool):
    """A caller that answers three y ions for each row: with the row's sequence and charge, or with its position."""

    def make():
        def call(frame):
            three = frame.loc[frame.index.repeat(3)]
            number = [1, 2, 3] * len(frame)
            out = three[["peptide_sequences", "precursor_charges"]].reset_index(drop=True) if keyed else three.index.to_frame(index=False, name="input_index")
            return out.assign(annotation=[f"y{n}" for n in number], intensities=[n * 10.0 for n in number]).iloc[::-1]

        return call

    return make


def _arrays():
    return lambda frame: frame[[]].assign(annotation=[["y1", "y2", "y3"]] * len(frame), intensities=[[10.0, 20.0, 30.0]] * len(frame))


def _model_query(client, schema):
    def q(spark, sf):
        out = predict.ModelPredictor(client, schema, "fixed").predict(words(spark, sf))
        return out.select("ModifiedPeptide", "PrecursorCharge", F.round("ProductMz", 6).alias("ProductMz"), "LibraryIntensity", "FragmentType", "FragmentSeriesNumber", "FragmentCharge")

    return q


def _mean_difference(calibration):
    """Of the calibration's times to half a minute a residue; null without any."""
    return calibration.agg(F.avg(F.col("tr") - F.length("seq") * 0.5)).first()[0]


def _calibrated(off):
    """Half a minute a residue, moved by the mean difference to the calibration."""
    return lambda frame: frame["seq"].str.len() * 0.5 + (float("nan") if off is None else off)


def q_rt_calibrated(spark, sf):
    known = digest.peptides(digest.digest(proteins(spark, sf), "trypsin-p", 0)).select(F.col("StrippedPeptide").alias("seq"), F.lit("").alias("modifications"), (F.length("StrippedPeptide") * 0.75 + 3).alias("tr"))
    rows = predict.predict_rt(words(spark, sf), "deeplc", model=lambda off: _calibrated(off), calibration=known, fit=_mean_difference)
    return rows.select("ModifiedPeptide", "PrecursorCharge", F.round("NormalizedRetentionTime", 6).alias("NormalizedRetentionTime"))


def q_rt_times(spark, sf):
    return predict.rt_stats(predict.predict_rt(words(spark, sf), "mock"))


def q_supported(spark, sf):
    rows = digest.precursor_table(proteins(spark, sf), charges="2", allow_selenocysteine=True)
    return filters.supported_only(rows, drop=True).select("StrippedPeptide", "ContainsSelenocysteine")


def q_unsupported(spark, sf):
    rows = digest.precursor_table(proteins(spark, sf), charges="2", allow_selenocysteine=True).where("ContainsSelenocysteine")
    return rows.select("ModifiedPeptide", "StrippedPeptide", F.round("PrecursorMz", 6).alias("PrecursorMz"))


def q_digest_stats_u(spark, sf):
    return digest.digest_stats(proteins(spark, sf), charges="2", variable_oxidation_m=True, allow_selenocysteine=True)


def _notation(form):
    def q(spark, sf):
        rows = digest.precursor_table(proteins(spark, sf), charges="2", variable_oxidation_m=True, c_mod_format=form, m_mod_format=form)
        return rows.select("ModifiedPeptide", "StrippedPeptide", "OxidationMPositions")

    return q


QUERIES = {
    "max_n": q_max_n, "dedup_transitions": q_dedup, "max_n_dedup_stats": q_dedup_stats, "transition_rank": q_rank, "union2n": q_union, "consensus": q_consensus,
    "two_input_stats": q_input_stats, "random_n": q_random_n, "reverse_intensity": q_reverse, "filter_transitions": q_filter, "filter_stats": q_filter_stats,
    "numeric_commas": q_commas, "normalize_library": q_normalize, "library_summary": q_summary, "chunk_rollup": q_rollup, "attach_rt": q_attach_rt,
    "attach_rt_stats": q_rt_stats, "minimal_projection": q_minimal, "digest_trypsin_p": _peptides("trypsin-p"), "digest_trypsin": _peptides("trypsin"), "digest_spans": q_spans,
    "precursor_table": q_precursors, "precursor_oxidation_m": q_oxidation, "charge_length_filter": q_rules, "digest_stats": q_digest_stats, "mock_predict": q_mock,
    "mock_predict_max_n": q_mock_max_n, "predict_rt_mock": q_rt_mock, "rt_model_input": q_rt_input, "stratified_sample": q_sample, "array_predictions_unnest": q_unnest,
    "parse_positions": q_positions, "model_predict": _model_query(_arrays, "annotation array<string>, intensities array<double>"),
    "koina_long_by_key": _model_query(_three_ions(True), "peptide_sequences string, precursor_charges int, annotation string, intensities double"),
    "koina_long_by_position": _model_query(_three_ions(False), "input_index long, annotation string, intensities double"),
    "rt_calibrated": q_rt_calibrated, "rt_stats": q_rt_times, "supported_only": q_supported, "selenocysteine_precursors": q_unsupported, "digest_stats_oxidation_u": q_digest_stats_u,
} | {f"notation_{form}": _notation(form) for form in P.C_FORMS if form != "unimod"}

_FILTER = "lower(FragmentType) IN ('y') AND FragmentCharge = 1 AND FragmentSeriesNumber BETWEEN 2 AND 6 AND ProductMz BETWEEN 50 AND 400"
_SIZES = f"by_p AS (SELECT {K}, count(*) AS n FROM lib_a GROUP BY {K}) "
_RT = "times AS (SELECT 'PEP' || p_partkey AS mp, min(p_retailprice) AS t, count(*) AS n, count(DISTINCT p_retailprice) AS times FROM part WHERE p_size > 10 GROUP BY 1) "
ORACLE_SQL = {
    "max_n": CTE + f"SELECT {KEEP} FROM ra WHERE rk <= 7",
    "dedup_transitions": CTE + f"SELECT {KEEP} FROM da",
    "max_n_dedup_stats": CTE + "SELECT (SELECT count(*) FROM lib_a) - (SELECT count(*) FROM da) AS n_duplicate_transitions_removed, (SELECT count(*) FROM lib_a) AS n_transitions_input",
    "transition_rank": CTE + f"SELECT {KEEP}, {RANK} AS TransitionRank FROM lib_a",
    "union2n": CTE + f"SELECT {KEEP} FROM (SELECT *, row_number() OVER (PARTITION BY {T} ORDER BY src) AS one FROM (SELECT *, 0 AS src FROM ra WHERE rk <= 7 UNION ALL SELECT *, 1 AS src FROM rb WHERE rk <= 7)) WHERE one = 1",
    "consensus": CTE + f"SELECT {KEEP}, round(score, 9) AS ConsensusScore FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY score DESC, rka NULLS LAST, rkb NULLS LAST, FragmentType, FragmentSeriesNumber, FragmentCharge, ProductMz) AS k FROM (SELECT "
    + ", ".join(f"coalesce(ra.{c}, rb.{c}) AS {c}" for c in KEPT) + ", ra.rk AS rka, rb.rk AS rkb, coalesce(1.0 / ra.rk, 0) + coalesce(1.0 / rb.rk, 0) AS score FROM ra FULL JOIN rb ON " + " AND ".join(f"ra.{c} = rb.{c}" for c in TRANSITION_KEY) + ")) WHERE k <= 7",
    "two_input_stats": CTE + f", pa AS (SELECT DISTINCT {K} FROM lib_a), pb AS (SELECT DISTINCT {K} FROM lib_b) SELECT (SELECT count(*) FROM pa) AS n_precursors_input_a, (SELECT count(*) FROM pb) AS n_precursors_input_b, (SELECT count(*) FROM lib_a) AS n_transitions_input_a, (SELECT count(*) FROM lib_b) AS n_transitions_input_b, (SELECT count(*) FROM (FROM pa INTERSECT FROM pb)) AS n_common_precursors, (SELECT count(*) FROM (FROM pa EXCEPT FROM pb)) AS n_a_only_precursors, (SELECT count(*) FROM (FROM pb EXCEPT FROM pa)) AS n_b_only_precursors",
    "random_n": CTE + f"SELECT {KEEP} FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY md5(concat_ws('|', '42', {T}))) AS r FROM da) WHERE r <= 3",
    "reverse_intensity": CTE + f", r AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY LibraryIntensity, {TIES}) AS r, count(*) OVER (PARTITION BY {K}) AS n FROM lib_a) SELECT {', '.join('b.LibraryIntensity' if c == 'LibraryIntensity' else 'a.' + c for c in KEPT)} FROM r a JOIN r b ON a.ModifiedPeptide = b.ModifiedPeptide AND a.PrecursorCharge = b.PrecursorCharge AND b.r = a.n - a.r + 1",
    "filter_transitions": CTE + f"SELECT {KEEP} FROM lib_a WHERE {_FILTER}",
    "filter_stats": CTE + f"SELECT count(*) AS n_transitions_before_transition_filters, count(*) FILTER (NOT ({_FILTER})) AS n_transitions_filtered_by_transition_filters, count(*) FILTER ({_FILTER}) AS n_transitions_after_transition_filters FROM lib_a",
    "numeric_commas": CTE + f"SELECT {KEEP.replace('LibraryIntensity', 'round(LibraryIntensity, 2) AS LibraryIntensity')} FROM lib_a",
    "normalize_library": CTE + f"SELECT {KEEP} FROM lib_a WHERE l_linenumber <> 3",
    "library_summary": CTE + f", {_SIZES} SELECT count(*) AS n_precursors_output, CAST(sum(n) AS BIGINT) AS n_transitions_output, avg(n) AS mean_transitions_per_precursor, CAST(median(n) AS DOUBLE) AS median_transitions_per_precursor, min(n) AS min_transitions_per_precursor, max(n) AS max_transitions_per_precursor, count(*) FILTER (n < 7) AS n_precursors_with_less_than_n FROM by_p",
    "chunk_rollup": CTE + f", {_SIZES} SELECT count(DISTINCT PrecursorCharge) AS n_chunks, count(*) AS n_precursors, CAST(sum(n) AS BIGINT) AS n_transitions, avg(n) AS mean, CAST(median(n) AS DOUBLE) AS median, min(n) AS least, max(n) AS most FROM by_p",
    "attach_rt": CTE + f", {_RT} SELECT {KEEP}, t AS NormalizedRetentionTime FROM lib_a LEFT JOIN times ON mp = ModifiedPeptide",
    "attach_rt_stats": CTE + f", {_RT}, by_p AS (SELECT {K}, count(*) AS n, count(t) AS m FROM lib_a LEFT JOIN times ON mp = ModifiedPeptide GROUP BY {K}) SELECT CAST(sum(n) AS BIGINT) AS n_library_rows, count(*) AS n_library_precursors, CAST(sum(m) AS BIGINT) AS n_matched_library_rows, count(*) FILTER (m > 0) AS n_matched_precursors, CAST(sum(n) - sum(m) AS BIGINT) AS n_unmatched_library_rows, count(*) FILTER (m = 0) AS n_unmatched_precursors, round(100.0 * count(*) FILTER (m > 0) / count(*), 6) AS pct_matched_precursors, (SELECT CAST(sum(n) AS BIGINT) FROM times) AS n_rt_rows, (SELECT count(*) FROM times) AS n_rt_unique_keys, (SELECT CAST(sum(n - 1) AS BIGINT) FROM times) AS n_rt_duplicate_key_rows, (SELECT count(*) FROM times WHERE times > 1) AS n_rt_keys_with_conflicting_values FROM by_p",
    "minimal_projection": CTE + f"SELECT {L}, ModifiedPeptide AS StrippedPeptide, 'P' AS ProteinId FROM lib_a",
    "digest_trypsin_p": PEPTIDES["trypsin-p"] + "SELECT * FROM found",
    "digest_trypsin": PEPTIDES["trypsin"] + "SELECT * FROM found",
    "digest_spans": PEPTIDES["trypsin"] + "SELECT protein_id, peptide, CAST(missed AS INT) AS missed, count(*) AS n FROM spans GROUP BY ALL",
    "precursor_table": PRECURSORS + "SELECT ModifiedPeptide, StrippedPeptide, PrecursorCharge, round(PrecursorMz, 6) AS PrecursorMz, ProteinId, ProteinCount FROM prec",
    "precursor_oxidation_m": PRECURSORS + ", ox AS (SELECT *, unnest(list_prepend(0, list_filter(range(1, length(StrippedPeptide) + 1), lambda i: StrippedPeptide[i] = 'M'))) AS pos FROM prec WHERE PrecursorCharge = 2) SELECT CASE WHEN pos = 0 THEN ModifiedPeptide ELSE replace(left(StrippedPeptide, CAST(pos AS INT) - 1), 'C', 'C(UniMod:4)') || 'M(UniMod:35)' || replace(substr(StrippedPeptide, CAST(pos AS INT) + 1), 'C', 'C(UniMod:4)') END AS ModifiedPeptide, StrippedPeptide, round(PrecursorMz + CASE WHEN pos = 0 THEN 0 ELSE 15.994914620 / 2 END, 6) AS PrecursorMz, CASE WHEN pos = 0 THEN '' ELSE CAST(pos AS VARCHAR) END AS OxidationMPositions, CAST(pos > 0 AS INT) AS NVariableMods, pos > 0 AS VariableOxidationM FROM ox",
    "charge_length_filter": PRECURSORS.replace("unnest([2, 3])", "unnest([2, 3, 4])") + "SELECT ModifiedPeptide, PrecursorCharge, round(PrecursorMz, 5) AS PrecursorMz, CAST(length(StrippedPeptide) AS INT) AS PeptideLength FROM prec WHERE NOT (PrecursorCharge = 4 AND length(StrippedPeptide) < 12) AND NOT (PrecursorCharge = 3 AND length(StrippedPeptide) < 9) AND PrecursorMz BETWEEN 400 AND 1200",
    "digest_stats": PRECURSORS + "SELECT (SELECT count(*) FROM proteins) AS n_proteins, (SELECT count(*) FROM spans) AS n_raw_peptides, (SELECT count(*) FROM spans WHERE length(peptide) NOT BETWEEN 7 AND 30) AS n_length_filtered, (SELECT count(*) FROM spans WHERE length(peptide) BETWEEN 7 AND 30 AND NOT regexp_full_match(peptide, '[ACDEFGHIKLMNPQRSTVWY]+')) AS n_invalid_aa_filtered, (SELECT count(*) FROM found) AS n_unique_peptides, (SELECT count(*) FROM prec) AS n_precursors_before_filters, CAST(0 AS BIGINT) AS n_charge_length_filtered, CAST(0 AS BIGINT) AS n_precursor_mz_filtered, (SELECT count(*) FROM prec) AS n_precursors_output, (SELECT count(*) FROM found) AS n_unique_modified_peptides, CAST(0 AS BIGINT) AS n_oxidized_modified_peptides, CAST(0 AS BIGINT) AS n_unique_selenocysteine_peptides, CAST(0 AS BIGINT) AS n_selenocysteine_precursors_output",
    "mock_predict": MOCK + "SELECT ModifiedPeptide, PrecursorCharge, round(PrecursorMz, 3) AS PrecursorMz, round(ProductMz, 3) AS ProductMz, round(LibraryIntensity, 3) AS LibraryIntensity, FragmentType, FragmentSeriesNumber, FragmentCharge, ProteinId FROM mock",
    "mock_predict_max_n": MOCK + f"SELECT ModifiedPeptide, PrecursorCharge, round(LibraryIntensity, 3) AS LibraryIntensity, FragmentType, FragmentSeriesNumber FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY LibraryIntensity DESC, FragmentType, FragmentSeriesNumber) AS k FROM mock) WHERE k <= 3",
    "predict_rt_mock": PRECURSORS + "SELECT ModifiedPeptide, PrecursorCharge, 0.5 * length(StrippedPeptide) + 0.25 * (length(StrippedPeptide) - length(replace(StrippedPeptide, 'C', ''))) AS NormalizedRetentionTime FROM prec",
    "rt_model_input": PRECURSORS + "SELECT ModifiedPeptide, PrecursorCharge, StrippedPeptide AS seq, array_to_string(list_transform(list_filter(range(1, length(StrippedPeptide) + 1), lambda i: StrippedPeptide[i] = 'C'), lambda i: i || '|Carbamidomethyl'), '|') AS modifications FROM prec",
    "stratified_sample": CTE + f", rows_ AS (SELECT DISTINCT {K} FROM lib_a), h AS (SELECT *, md5(concat_ws('|', '42', {K})) AS h FROM rows_), q AS (SELECT PrecursorCharge AS c, 100 // (count(*) OVER ()) + CAST(row_number() OVER (ORDER BY PrecursorCharge) <= 100 % (count(*) OVER ()) AS INT) AS q FROM (SELECT DISTINCT PrecursorCharge FROM rows_)), r AS (SELECT *, row_number() OVER (PARTITION BY PrecursorCharge ORDER BY h) AS r FROM h JOIN q ON c = PrecursorCharge) SELECT {K} FROM r ORDER BY CASE WHEN r <= q THEN 0 ELSE 1 END, h LIMIT 100",
    "array_predictions_unnest": "SELECT vec_id, round(x, 6) AS intensity, CASE WHEN i % 2 = 0 THEN 'y' ELSE 'b' END AS ion, CAST(i + 1 AS INT) AS number, CAST(CASE WHEN i % 3 = 0 THEN 2 ELSE 1 END AS INT) AS charge FROM (SELECT vec_id, CAST(embedding[i + 1] AS DOUBLE) AS x, i FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)) WHERE x > 0",
    "parse_positions": "SELECT event_id, least(event_id % 9 + 1, event_id % 5 + 2) || ';' || greatest(event_id % 9 + 1, event_id % 5 + 2) AS positions FROM events",
    "model_predict": PRECURSORS + ", y AS (SELECT *, unnest([1, 2, 3]) AS n FROM prec) SELECT ModifiedPeptide, PrecursorCharge, round(18.010564684 + " + SUM.replace("{s}", "right(StrippedPeptide, CAST(n AS INT))") + " + 1.007276466621, 6) AS ProductMz, CAST(n * 10 AS DOUBLE) AS LibraryIntensity, 'y' AS FragmentType, CAST(n AS INT) AS FragmentSeriesNumber, CAST(1 AS INT) AS FragmentCharge FROM y",
}
WITH_U = PRECURSORS.replace("[ACDEFGHIKLMNPQRSTVWY]+", "[ACDEFGHIKLMNPQRSTVWYU]+").replace("unnest([2, 3])", "unnest([2])")
OXIDISED = ", ox AS (SELECT *, unnest(list_prepend(0, list_filter(range(1, length(StrippedPeptide) + 1), lambda i: StrippedPeptide[i] = 'M'))) AS pos FROM prec WHERE PrecursorCharge = 2) "
ORACLE_SQL |= {
    "koina_long_by_key": ORACLE_SQL["model_predict"], "koina_long_by_position": ORACLE_SQL["model_predict"],
    "rt_calibrated": PRECURSORS + ", known AS (SELECT DISTINCT StrippedPeptide AS s FROM found WHERE MinMissedCleavages = 0), off AS (SELECT avg(length(s) * 0.25e0 + 3) AS v FROM known) SELECT ModifiedPeptide, PrecursorCharge, round(length(StrippedPeptide) * 0.5e0 + v, 6) AS NormalizedRetentionTime FROM prec, off",
    "rt_stats": "SELECT count(*) AS n_precursor_rows_input, count(t) AS n_precursor_rows_with_rt, min(t) AS rt_min, max(t) AS rt_max, median(t) AS rt_median FROM (SELECT CAST(NormalizedRetentionTime AS DOUBLE) AS t FROM (" + ORACLE_SQL["predict_rt_mock"] + "))",
    "supported_only": WITH_U + "SELECT StrippedPeptide, false AS ContainsSelenocysteine FROM prec WHERE NOT contains(StrippedPeptide, 'U')",
    "selenocysteine_precursors": WITH_U + "SELECT ModifiedPeptide, StrippedPeptide, round(PrecursorMz, 6) AS PrecursorMz FROM prec WHERE contains(StrippedPeptide, 'U')",
    "digest_stats_oxidation_u": WITH_U + OXIDISED + "SELECT (SELECT count(*) FROM proteins) AS n_proteins, (SELECT count(*) FROM spans) AS n_raw_peptides, (SELECT count(*) FROM spans WHERE length(peptide) NOT BETWEEN 7 AND 30) AS n_length_filtered, (SELECT count(*) FROM spans WHERE length(peptide) BETWEEN 7 AND 30 AND NOT regexp_full_match(peptide, '[ACDEFGHIKLMNPQRSTVWYU]+')) AS n_invalid_aa_filtered, (SELECT count(*) FROM found) AS n_unique_peptides, (SELECT count(*) FROM ox) AS n_precursors_before_filters, (SELECT count(*) FROM ox) AS n_unique_modified_peptides, (SELECT count(*) FROM ox WHERE pos > 0) AS n_oxidized_modified_peptides, (SELECT count(*) FROM found WHERE contains(StrippedPeptide, 'U')) AS n_unique_selenocysteine_peptides, CAST(0 AS BIGINT) AS n_charge_length_filtered, CAST(0 AS BIGINT) AS n_precursor_mz_filtered, (SELECT count(*) FROM ox) AS n_precursors_output, (SELECT count(*) FROM ox WHERE contains(StrippedPeptide, 'U')) AS n_selenocysteine_precursors_output",
}
for form in P.C_FORMS:
    if form != "unimod":
        c, m = P.C_FORMS[form], P.M_FORMS[form]
        ORACLE_SQL[f"notation_{form}"] = PRECURSORS + OXIDISED + f"SELECT CASE WHEN pos = 0 THEN replace(StrippedPeptide, 'C', '{c}') ELSE replace(left(StrippedPeptide, CAST(pos AS INT) - 1), 'C', '{c}') || '{m}' || replace(substr(StrippedPeptide, CAST(pos AS INT) + 1), 'C', '{c}') END AS ModifiedPeptide, StrippedPeptide, CASE WHEN pos = 0 THEN '' ELSE CAST(pos AS VARCHAR) END AS OxidationMPositions FROM ox"
ORACLE_SQL = {k: v.replace("AS STRING", "AS VARCHAR") for k, v in ORACLE_SQL.items()}
