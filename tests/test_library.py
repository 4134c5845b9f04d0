"""Golden values, invariants, errors and commands."""

import json
from functools import partial

import pandas as pd
import pytest
from compare import duck, spark_rows
from pyspark.sql import functions as F

from specloom.__main__ import main
from specloom.functions import peptide as P
from specloom.operators import combine, controls, digest, filters, predict, report, rt, sample, select
from specloom.plans import bridge, commands, presets
from specloom.schema import DataError, coerce_numeric_commas, normalize
from specloom.sources import tables
from specloom.streaming.chunks import predict_stream

COLUMNS = "ModifiedPeptide string, PrecursorCharge int, PrecursorMz double, ProductMz double, LibraryIntensity double, FragmentType string, FragmentSeriesNumber int, FragmentCharge int, ExtraColumn string"


def toy(spark, scale=1.0):
    rows = [(p, 2, 500.0, 100 + i + (0.1 if i % 2 == 0 else 0.0), scale * (100 - 10 * i), "y" if i % 2 == 0 else "b", i, 1, "x") for p in ("PEPTIDEK", "ACDEK") for i in range(1, 6)]
    return spark.createDataFrame(rows, COLUMNS)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_top_n_and_idempotence(spark):
    once = select.top_n(toy(spark), 3, ["ProductMz"])
    assert once.groupBy("ModifiedPeptide").count().select("count").distinct().collect()[0][0] == 3
    assert "ExtraColumn" in once.columns
    again = select.top_n(once, 3, ["ProductMz"])
    assert sorted(again.collect()) == sorted(once.collect())
    assert sorted(combine.union(toy(spark), toy(spark, 0.8), 3, ["ProductMz"]).collect()) == sorted(once.collect())
    with pytest.raises(ValueError):
        select.top_n(toy(spark), 0)


def test_one_exchange(spark):
    plan = select.top_n(toy(spark), 3, ["ProductMz"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_consensus_scores(spark):
    rows = combine.consensus(toy(spark), toy(spark, 0.8), 2, ["ProductMz"]).where("ModifiedPeptide = 'ACDEK'").orderBy(F.desc("ConsensusScore")).collect()
    assert [r["ConsensusScore"] for r in rows] == [2.0, 1.0]


def test_controls(spark):
    a = toy(spark)
    back = controls.reverse_intensity(controls.reverse_intensity(a))
    assert sorted(back.select(a.columns).collect()) == sorted(a.collect())
    assert sorted(controls.random_n(a, 2).collect()) == sorted(controls.random_n(a.repartition(7), 2).collect())
    assert controls.random_n(a, 9).count() == 10


def test_masses_and_notation(spark):
    lit = F.lit
    for seq, z, want in (("ACDEK", 2, 311.628689), ("MPEPTIDEK", 1, 1059.502688), ("PEPTIDER", 3, 319.494302)):
        assert one(spark, F.round(P.mz(P.neutral_mass(P.residue_masses(lit(seq))), lit(z)), 6)) == want
    assert one(spark, P.noise(lit("PEPTIDEK"), lit(2), lit("y"), lit(3), lit(1))) == pytest.approx(0.5852878202184308)
    for text, want in (("y7", ("y", 7, 1)), ("y7^2", ("y", 7, 2)), ("y7+2", ("y", 7, 2)), ("b3/1", ("b", 3, 1))):
        assert tuple(one(spark, P.annotation(lit(text)))) == want
    assert one(spark, P.annotation(lit("y7-H2O"), strict=True))["charge"] == 1
    assert one(spark, P.parse_positions(lit("3;7.0"))) == [2, 6] and one(spark, P.parse_positions(lit("nan"))) == []
    assert tuple(one(spark, P.rt_input(lit("AC(UniMod:4)DM(UniMod:35)K"), carbamidomethyl=False))) == ("ACDMK", "2|Carbamidomethyl|4|Oxidation")
    assert tuple(one(spark, P.rt_input(lit("(UniMod:1)ACDM(UniMod:40)K")))) == ("ACDMK", "2|Carbamidomethyl")
    assert one(spark, P.mock_rt(lit("ACDMK"), lit("2|Carbamidomethyl|4|Oxidation"))) == 3.0
    assert P.parse_charge_rules("4:12,5:16") == {4: 12, 5: 16}
    for bad in ("4", "0:3", "4:x"):
        with pytest.raises(ValueError):
            P.parse_charge_rules(bad)


def test_digest(spark, tmp_path):
    fasta = tmp_path / "toy.fasta"
    fasta.write_text("dropped\n>sp|P1|ONE first\nMPEPTIDEK\r\nACDEK*\n\n>sp|P2|TWO second\nacdekPEPTIDER\n  >plain third\nMTESTPEPTIDEXK\n")
    found = tables.read_fasta(spark, str(fasta))
    assert sorted(tuple(r) for r in found.collect()) == [("P1", "sp|P1|ONE first", "MPEPTIDEKACDEK"), ("P2", "sp|P2|TWO second", "ACDEKPEPTIDER"), ("plain", "plain third", "MTESTPEPTIDEXK")]
    rows = digest.precursor_table(found, min_length=5, charges="2,3")
    assert rows.count() == 10
    assert rows.where("StrippedPeptide = 'ACDEK'").select("ProteinId", "ProteinCount").first()[:] == ("P1;P2", 2)
    stats = digest.digest_stats(found, min_length=5, charges="2,3").first()
    assert (stats["n_raw_peptides"], stats["n_length_filtered"], stats["n_invalid_aa_filtered"], stats["n_unique_peptides"]) == (7, 0, 1, 5)
    cut = one(spark, digest.pieces(F.lit("MKRPAKPEPKDER"), "trypsin"))
    assert cut == ["MK", "RPAKPEPK", "DER"]
    assert len(one(spark, digest.oxidation_sets(F.lit("MAMMK"), True, 2))) == 1 + 3 + 3
    with pytest.raises(ValueError):
        digest.pieces(F.lit("A"), "pepsin")
    with pytest.raises(FileNotFoundError):
        tables.read_fasta(spark, str(tmp_path / "none.fasta"))


def test_empty_digest_keeps_its_schema(spark):
    none = spark.createDataFrame([], "protein_id string, description string, sequence string")
    assert digest.precursor_table(none).columns[0] == "ModifiedPeptide" and digest.precursor_table(none).count() == 0


def test_numbers_and_normalising(spark):
    rows = toy(spark).withColumn("ProductMz", F.lit("1 000,002558"))
    assert coerce_numeric_commas(rows).first()["ProductMz"] == 1000.002558
    assert normalize(rows.withColumn("ProductMz", F.lit("1,000.5"))).count() == 0
    with pytest.raises(ValueError, match="missing"):
        normalize(rows.drop("ProductMz"))


def test_rt(spark):
    table = spark.createDataFrame([("PEPTIDEK", 2, None), ("PEPTIDEK", 2, "4,2"), ("PEPTIDEK", 2, "5")], "ModifiedPeptide string, PrecursorCharge int, t string")
    row = rt.stats(toy(spark), table, "t").first()
    assert (row["n_matched_precursors"], row["n_rt_duplicate_key_rows"], row["n_rt_keys_with_conflicting_values"], row["pct_matched_precursors"]) == (1, 2, 1, 50.0)
    with pytest.raises(DataError):
        rt.check_match_rate(row.asDict(), 0.99)
    assert rt.attach(toy(spark), table, "t").where("NormalizedRetentionTime is not null").count() == 5


def test_summary_and_sample(spark):
    row = report.library_summary(toy(spark), 6).first()
    assert (row["n_precursors_output"], row["median_transitions_per_precursor"], row["n_precursors_with_less_than_n"]) == (2, 5.0, 2)
    assert report.library_summary(toy(spark).limit(0)).first()["mean_transitions_per_precursor"] == 0.0
    rows = spark.range(100).selectExpr("concat('P', id) ModifiedPeptide", "cast(case when id < 5 then 1 else 2 end as int) PrecursorCharge")
    got = sample.stratified(rows, 20).groupBy("PrecursorCharge").count().collect()
    assert dict(map(tuple, got)) == {1: 5, 2: 15}


def test_model_layouts(spark):
    rows = spark.createDataFrame([("PEPTIDEK", "PEPTIDEK", 2, 464.7, "P")], "ModifiedPeptide string, StrippedPeptide string, PrecursorCharge int, PrecursorMz double, ProteinId string")

    def client():
        return lambda frame: pd.DataFrame({"intensities": [[5.0, 0.0, 7.0]] * len(frame), "annotation": [["y3", "b2", "y4^2"]] * len(frame)})

    out = predict.ModelPredictor(client, "intensities array<double>, annotation array<string>", "m").predict(rows)
    assert sorted((r["FragmentType"], r["FragmentSeriesNumber"], r["FragmentCharge"]) for r in out.collect()) == [("y", 3, 1), ("y", 4, 2)]
    with pytest.raises(DataError):
        predict.check_plain_sequences(rows.withColumn("NVariableMods", F.lit(1)))
    with pytest.raises(DataError):
        predict.check_unique(rows.union(rows))
    with pytest.raises(ValueError):
        predict.get_predictor("other")
    with pytest.raises(ValueError):
        filters.supported_only(rows.withColumn("StrippedPeptide", F.lit("UK")), drop=False)
    bad = spark.createDataFrame([([1.0], ["y1", "y2"])], "intensities array<double>, annotation array<string>")
    with pytest.raises(Exception, match="differ in length"):
        predict.unnest(bad).collect()


def test_presets():
    assert presets.digest_settings("generic-dia-strict")["charge_length_rules"] == "4:12"
    assert presets.predict_settings("skyline-dia-like", fragment_charges="1")["recommended_top_n"] == 6
    with pytest.raises(ValueError):
        presets.digest_settings("gone")


def test_commands(spark, tmp_path, capsys):
    d = str(tmp_path)
    (tmp_path / "p.fasta").write_text(">sp|P1|ONE x\nMPEPTIDEKACDEKLLLLPEPTIDEK\n>sp|P2|TWO y\nAAAACDEKPEPTIDERGGGGGGGGK\n")
    commands.digest_fasta(spark, f"{d}/p.fasta", f"{d}/prec.parquet", preset="generic-dia")
    commands.predict_table(spark, f"{d}/prec.parquet", f"{d}/lib.tsv", top_n=3, single_file=True)
    lib = tables.read_library(spark, f"{d}/lib.tsv")
    assert lib.columns[:10] == ["ModifiedPeptide", "StrippedPeptide", "PrecursorCharge", "PrecursorMz", "ProductMz", "LibraryIntensity", "FragmentType", "FragmentSeriesNumber", "FragmentCharge", "ProteinId"]
    first = commands.predict_chunked(spark, f"{d}/prec.parquet", f"{d}/all.parquet", f"{d}/work", chunks=3, top_n=3)
    again = commands.predict_chunked(spark, f"{d}/prec.parquet", f"{d}/all.parquet", f"{d}/work", chunks=3, top_n=3)
    assert first["n_transitions_output"] == again["n_transitions_output"] == lib.count()
    commands.max_n(spark, f"{d}/lib.tsv", f"{d}/max.parquet", top_n=2)
    commands.union(spark, f"{d}/lib.tsv", f"{d}/max.parquet", f"{d}/u.parquet", top_n=2)
    commands.consensus(spark, f"{d}/lib.tsv", f"{d}/max.parquet", f"{d}/c.parquet", top_n=2)
    commands.random_n(spark, f"{d}/lib.tsv", f"{d}/r.parquet", top_n=2)
    commands.reverse_intensity(spark, f"{d}/lib.tsv", f"{d}/rev.parquet")
    assert commands.predict_rt(spark, f"{d}/prec.parquet", f"{d}/rt.parquet", backend="mock")["n_precursor_rows_with_rt"] == tables.read_table(spark, f"{d}/prec.parquet").count()
    commands.add_rt(spark, f"{d}/lib.tsv", f"{d}/rt.parquet", f"{d}/with_rt.parquet", "NormalizedRetentionTime")
    out = commands.build(spark, f"{d}/p.fasta", f"{d}/built", top_n=3, sample_size=4)
    assert tables.read_table(spark, out["union"]).select("ModifiedPeptide", "PrecursorCharge").distinct().count() == 4
    assert "n_common_precursors" in (tmp_path / "u.summary.tsv").read_text()
    assert json.loads((tmp_path / "u.params.json").read_text())["top_n"] == 2
    assert main(["presets"]) == 0 and "generic-dia" in capsys.readouterr().out
    query = predict_stream(spark, f"{d}/prec.parquet", f"{d}/stream", f"{d}/ckpt", top_n=3)
    query.awaitTermination()
    assert spark.read.parquet(f"{d}/stream").count() == lib.count()


PRECURSORS = "ModifiedPeptide string, StrippedPeptide string, PrecursorCharge int, PrecursorMz double, ProteinId string, Note string"


def asked(spark):
    rows = [(p, p, z, 400.0 + z, f"P{z}", f"{p}{z}") for p in ("PEPTIDEK", "ACDEK", "LLLLK") for z in (2, 3)]
    return spark.createDataFrame(rows, PRECURSORS).repartition(3)


@pytest.mark.parametrize("layout", ["key", "position", "position from one", "array", "probed", "library"])
def test_answers_reach_their_precursor(spark, layout):
    def client():
        def call(frame):
            assert list(frame.columns) == ["peptide_sequences", "precursor_charges", "collision_energies"]
            n = len(frame)
            many = frame.precursor_charges * 10.0 + frame.peptide_sequences.str.len()
            if layout in ("array", "probed"):
                return {"intensities": [[v, v + 0.5] for v in many], "annotation": [["y2", b"b1"] if layout == "x" else ["y2", "b1"]] * n}
            if layout == "library":
                return pd.DataFrame({"ModifiedPeptide": frame.peptide_sequences, "PrecursorCharge": frame.precursor_charges, "PrecursorMz": 400.0, "ProductMz": 100.0, "LibraryIntensity": many, "FragmentType": "y", "FragmentSeriesNumber": 2, "FragmentCharge": 1})
            long = pd.DataFrame({"intensity": [*many, *(many + 0.5)], "ion": ["y2"] * n + ["b1"] * n})
            if layout == "key":
                return long.assign(sequence=[*frame.peptide_sequences] * 2, charge=[*frame.precursor_charges.astype(float)] * 2).sample(frac=1, random_state=1)
            at = [*range(n)] * 2
            return long.assign(input_index=[x + 1 for x in at] if layout.endswith("one") and n == 1 else at)

        return call

    schema = {"array": "intensities array<double>, annotation array<string>", "probed": None, "key": "intensity double, ion string, sequence string, charge double", "library": "ModifiedPeptide string, PrecursorCharge int, PrecursorMz double, ProductMz double, LibraryIntensity double, FragmentType string, FragmentSeriesNumber int, FragmentCharge int"}.get(layout, "intensity double, ion string, input_index long")
    size = 1 if layout.endswith("one") else 2
    rows = predict.ModelPredictor(client, schema, "m", batch_size=size).predict(asked(spark)).collect()
    want = {(r["ModifiedPeptide"], r["PrecursorCharge"]): r["PrecursorCharge"] * 10.0 + len(r["ModifiedPeptide"]) for r in asked(spark).collect()}
    assert len(rows) == len(want) * (1 if layout == "library" else 2)
    for r in rows:
        assert r["LibraryIntensity"] == want[r["ModifiedPeptide"], r["PrecursorCharge"]] + (0.5 if r["FragmentType"] == "b" else 0)
        assert layout == "library" or r["Note"] == f"{r['ModifiedPeptide']}{r['PrecursorCharge']}"


def test_answers_that_fit_nobody(spark):
    def answering(**columns):
        return lambda: lambda frame: pd.DataFrame(columns)

    for columns, schema in (
        ({"annotation": ["y1"], "intensities": [1.0], "sequence": ["XXX"], "charge": [2]}, "annotation string, intensities double, sequence string, charge int"),
        ({"annotation": ["y1"], "intensities": [1.0], "input_index": [99]}, "annotation string, intensities double, input_index int"),
        ({"annotation": ["y1"], "intensities": [1.0]}, "annotation string, intensities double"),
        ({"annotation": [["y1"]] * 99, "intensities": [[1.0]] * 99}, "annotation array<string>, intensities array<double>"),
    ):
        with pytest.raises(Exception, match="precursor|position|sequence and charge"):
            predict.ModelPredictor(answering(**columns), schema, "m").predict(asked(spark)).collect()
    with pytest.raises(Exception, match="several precursors"):
        predict.ModelPredictor(answering(annotation=["y1"], intensities=[1.0], sequence=["ACDEK"], charge=[2]), "annotation string, intensities double, sequence string, charge int", "m").predict(asked(spark).union(asked(spark)).coalesce(1)).collect()
    with pytest.raises(ValueError, match="annotation"):
        predict.ModelPredictor(answering(), "intensities double", "m").predict(asked(spark))
    with pytest.raises(ValueError, match="server_url"):
        predict.get_predictor("koina", model="m")
    with pytest.raises(DataError, match="notation"):
        predict.check_plain_sequences(asked(spark).withColumn("ModifiedPeptide", F.lit("AC(UniMod:4)K")), "modified")
    with pytest.raises(Exception, match="koinapy"):
        predict.get_predictor("koina", model="m", server_url="localhost:1", schema="intensities array<double>, annotation array<string>").predict(asked(spark)).collect()


def test_mock_cut_in_the_row_is_the_cut_of_all(spark):
    rows = asked(spark).withColumn("OxidationMPositions", F.lit("")).union(asked(spark).withColumn("OxidationMPositions", F.lit("")).limit(2))
    limits = {"min_fragment_series": 2, "fragment_types": "b,y", "max_product_mz": 600.0}
    every = select.top_n(filters.filter_transitions(predict.mock(rows, fragment_charges="1,2"), **limits), 4)
    cut = commands.predicted(rows, top_n=4, include_metadata=True, fragment_charges="1,2", **limits)
    assert sorted(map(str, every.select(cut.columns).collect())) == sorted(map(str, cut.collect()))
    odd = asked(spark).withColumn("StrippedPeptide", F.lit("AXK"))
    assert {(r["FragmentType"], r["FragmentSeriesNumber"]) for r in predict.mock(odd).collect()} == {("b", 1), ("y", 1)}


def test_retention_times_of_models(spark):
    rows = asked(spark).withColumns({"seq": F.lit("mine"), "modifications": F.lit("too")})
    known = spark.createDataFrame([("ACDEK", "ACDEK", "7,5"), ("LLLLK", "LLLLK", None)], "ModifiedPeptide string, StrippedPeptide string, t string")

    def model(calibration):
        assert calibration is None or calibration.values.tolist() == [["ACDEK", "2|Carbamidomethyl", 7.5]]
        off = 0.0 if calibration is None else calibration.tr.iloc[0]
        return lambda frame: pd.DataFrame({"other": 0, "rt": frame.seq.str.len() + off})

    for table, off in ((None, 0.0), (known, 7.5)):
        out = predict.predict_rt(rows, "deeplc", model=model, calibration=table, calibration_rt_column="t")
        assert out.columns == [*rows.columns, "NormalizedRetentionTime"]
        assert all(r["NormalizedRetentionTime"] == len(r["StrippedPeptide"]) + off and r["seq"] == "mine" and r["modifications"] == "too" for r in out.collect())
    with pytest.raises(ValueError, match="more than 0"):
        predict.predict_rt(rows, "deeplc", model=model, calibration=known, calibration_rt_column="t", most_calibration=0)
    with pytest.raises(Exception, match="deeplc"):
        predict.predict_rt(rows, "deeplc").collect()


def test_reversal_in_one_exchange(spark):
    rows = toy(spark).withColumn("LibraryIntensity", F.when(F.col("FragmentSeriesNumber") == 2, None).otherwise(F.col("LibraryIntensity")))
    out = controls.reverse_intensity(rows, ["ProductMz"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    by = {r["FragmentSeriesNumber"]: r["LibraryIntensity"] for r in out.where("ModifiedPeptide = 'ACDEK'").collect()}
    assert by == {5: None, 4: 90.0, 3: 70.0, 1: 60.0, 2: 50.0} and {r["ExtraColumn"] for r in out.collect()} == {"x"}


def test_overlap_of_unlike_libraries(spark):
    a, b = toy(spark), toy(spark).where("ModifiedPeptide = 'ACDEK'").union(toy(spark).withColumn("ModifiedPeptide", F.lit("NEWK")).limit(3))
    row = combine.input_stats(a, b).first()
    assert (row["n_common_precursors"], row["n_a_only_precursors"], row["n_b_only_precursors"], row["n_transitions_input_b"]) == (1, 1, 1, 8)


def test_chunks_build_and_sidecars(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "p.fasta").write_text(">sp|P1|ONE x\nMPEPTIDEKACDEUPPKLLLLPEPTIDEK\n>sp|P2|TWO y\nAAAACDEKPEPTIDERGGGGGGGGK\n")
    made = commands.digest_fasta(spark, f"{d}/p.fasta", f"{d}/prec.parquet", preset="Generic-DIA", allow_selenocysteine=True, variable_oxidation_m=True)
    assert made["n_unique_selenocysteine_peptides"] > 0 and made["n_oxidized_modified_peptides"] > 0 and made["n_selenocysteine_precursors_output"] > 0 and made["enzyme"] == "trypsin-p"
    keys = [tuple(r) for r in tables.read_table(spark, f"{d}/prec.parquet").select("ModifiedPeptide", "PrecursorCharge").collect()]
    assert keys == sorted(keys)

    def client():
        return lambda frame: pd.DataFrame({"intensities": [[5.0, 4.0, 3.0]] * len(frame), "annotation": [["y3", "b2", "y3"]] * len(frame)})

    tables.write_table(tables.read_table(spark, f"{d}/prec.parquet").where("NVariableMods = 0").drop("VariableOxidationM", "OxidationMPositions", "NVariableMods"), f"{d}/plain.parquet")
    options = {"chunk_size": 5, "top_n": 2, "backend": "koina", "drop_unsupported_aa": True, "model": {"client": client, "schema": "intensities array<double>, annotation array<string>", "model": "m"}}
    first = commands.predict_chunked(spark, f"{d}/plain.parquet", f"{d}/all.parquet", **options)
    rows = tables.read_table(spark, f"{d}/plain.parquet")
    n, odd = rows.count(), rows.where(filters.unsupported(rows)).count()
    assert (first["n_precursors_input"], first["n_precursors_with_unsupported_aa_input"], first["n_precursors_dropped_unsupported_aa"], first["n_precursors_predicted_input"]) == (n, odd, odd, n - odd) and odd
    assert (first["n_transitions_predicted_raw"], first["n_duplicate_transitions_removed"], first["n_transitions_output"]) == (3 * (n - odd), n - odd, 2 * (n - odd))
    assert {*commands.ROLLED_UP} <= {*first} and first["n_chunks"] == -(-n // 5)
    marker = json.loads((tmp_path / "all.chunked_work" / "chunks_manifest.json").read_text())["chunks"][0]
    assert json.loads(open(marker["done_marker"]).read())["output"] == marker["predicted_chunk_file"] and marker["completed"]
    found = tables.read_table(spark, f"{d}/all.parquet").select("ModifiedPeptide", "PrecursorCharge", F.col("LibraryIntensity") * -1).collect()
    assert [tuple(r) for r in found] == sorted(tuple(r) for r in found)
    (tmp_path / "odd.tsv").write_text(" a \tb\n1\t2\n")
    assert tables.read_table(spark, f"{d}/odd.tsv").columns == ["a", "b"]
    out = commands.build(spark, f"{d}/p.fasta", f"{d}/built", top_n=3, chunk_size=7, digest_options={"charges": "2"}, resume=True)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "built" / "library.build_work").rglob("_SUCCESS")}
    assert commands.build(spark, f"{d}/p.fasta", f"{d}/built", top_n=3, chunk_size=7, digest_options={"charges": "2"}, resume=True) == out
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "built" / "library.build_work").rglob("_SUCCESS")} and before
    assert json.loads((tmp_path / "built" / "library.build.json").read_text())["charges"] == "2"
    assert {r[0] for r in tables.read_table(spark, out["union"]).select("PrecursorCharge").distinct().collect()} == {2}


def test_calibration_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(predict, "predict_rt", partial(predict.predict_rt, most_calibration=10))
    sf = "/root/testdata/sf0.001"
    assert spark_rows(bridge.QUERIES["rt_calibrated"](spark, sf)) == duck(bridge.ORACLE_SQL["rt_calibrated"], sf)


def test_sequences_are_shuffled_once(spark):
    plan = bridge.QUERIES["digest_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(protein_id#") == 1 and plan.count("hashpartitioning(protein_id#") == 1
    spans = [(r["protein_id"], r["peptide"], r["missed"], r["n"]) for r in digest.digest(spark.createDataFrame([("a", "", "AKC")] * 2, "protein_id string, description string, sequence string").repartition("protein_id"), "trypsin", 1).groupBy("protein_id", "peptide", "missed").agg(F.count("*").alias("n")).collect()]
    assert sorted(spans) == [("a", "AK", 0, 2), ("a", "AKC", 1, 2), ("a", "C", 0, 2)]


def test_filtered_peptides_are_only_counted(spark):
    rows = [(str(i), "", "A" * (31 + i) + "K" + "ACDEFGHIK" + "X" * (8 + i)) for i in range(20)]
    stats = digest.digest_stats(spark.createDataFrame(rows, "protein_id string, description string, sequence string").coalesce(1), charges="2")
    row = stats.first()
    assert (row["n_raw_peptides"], row["n_length_filtered"], row["n_invalid_aa_filtered"], row["n_unique_peptides"]) == (100, 46, 34, 1)
    grouped = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [peptide#" not in grouped


def test_columns_that_nobody_reads_do_not_go_to_the_model(spark):
    out = predict.ModelPredictor(bridge._arrays, "annotation array<string>, intensities array<double>", "m").predict(asked(spark))
    plan = out.select("ModifiedPeptide", "LibraryIntensity")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "Project [ModifiedPeptide#" in plan
    assert out.select("ModifiedPeptide", "LibraryIntensity").count() == 18
