"""Precursors to transitions: the mock in expressions, models through Arrow batches, and retention times."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from specloom.functions import peptide as P
from specloom.operators.filters import fitting, positive_intensity
from specloom.schema import LIBRARY_COLUMNS, DataError, csv_ints, csv_words, find_name, numeric, positive, require


class Predictor(Protocol):
    def predict(self, precursors: DataFrame) -> DataFrame: ...


# How intense the mock's ions are.
MOCK_SCALE, MOCK_WEIGHT, MOCK_NOISE = 1000.0, {"y": 1.0, "b": 0.78}, 0.05


def mock(precursors: DataFrame, fragment_types: str = "b,y", fragment_charges: str = "1", max_fragment_series: int | None = None, top_n: int | None = None, limits: dict[str, Any] | None = None) -> DataFrame:
    """Deterministic fragments with made-up intensities; ions with an unknown residue are left out.

    A precursor's fragments are made, filtered by ``limits`` and cut to the ``top_n`` most intense within its row, before they become rows.
    """
    require(precursors, ["ModifiedPeptide", "StrippedPeptide", "PrecursorCharge", "PrecursorMz"])
    ions, charges = csv_words(fragment_types) or ["b", "y"], F.array(*[F.lit(z) for z in csv_ints(fragment_charges) or [1]])
    seq, n = F.col("StrippedPeptide"), F.length("StrippedPeptide")
    last = n - 1 if max_fragment_series is None else F.least(n - 1, F.lit(max_fragment_series))
    fixed = F.coalesce(F.col("FixedCarbamidomethylC").cast("boolean"), F.lit(True)) if "FixedCarbamidomethylC" in precursors.columns else F.lit(True)
    ox = P.parse_positions(F.col("OxidationMPositions").cast("string")) if "OxidationMPositions" in precursors.columns else F.array().cast("array<int>")
    rows = precursors.where((n >= 2) & (last >= 1)).withColumn("_specloom_m", P.residue_masses(seq, fixed, ox))
    rows = rows.withColumns({"_specloom_b": P.running(F.col("_specloom_m")), "_specloom_y": P.running(F.reverse("_specloom_m"), P.WATER)})

    def made(ion: str, number: Column, z: Column) -> Column:
        sums = {"b": F.col("_specloom_b"), "y": F.col("_specloom_y")}.get(ion)
        mz = P.mz(F.get(sums, number), z) if sums is not None else F.lit(None).cast("double")
        value = MOCK_SCALE * (MOCK_WEIGHT.get(ion, MOCK_WEIGHT["b"]) * (number / F.greatest(F.lit(1), n - 1)) * (F.lit(1.0) / z) + MOCK_NOISE * P.noise(F.col("ModifiedPeptide"), F.col("PrecursorCharge"), F.lit(ion), number, z))
        return F.struct((-value).alias("less"), F.lit(ion).alias("FragmentType"), number.alias("FragmentSeriesNumber"), z.alias("FragmentCharge"), mz.alias("ProductMz"))

    def series(ion: str) -> Column:
        return F.transform(F.sequence(F.lit(1), last), lambda k: F.transform(charges, lambda z: made(ion, k, z)))

    found = F.flatten(F.concat(*[series(ion) for ion in ions]))
    found = F.filter(found, lambda f: f["ProductMz"].isNotNull() & ~F.isnan(f["ProductMz"]) & fitting(lambda c: f[c], **(limits or {})))
    if top_n is not None:
        found = F.slice(F.sort_array(found), 1, positive("top_n", top_n))
    extra = [c for c in precursors.columns if c not in (*LIBRARY_COLUMNS, "StrippedPeptide", "PredictionBackend")]
    rows = rows.select("ModifiedPeptide", "StrippedPeptide", "PrecursorCharge", "PrecursorMz", *extra, F.inline(found))
    return rows.select("ModifiedPeptide", "StrippedPeptide", "PrecursorCharge", "PrecursorMz", "ProductMz", (-F.col("less")).alias("LibraryIntensity"), "FragmentType", "FragmentSeriesNumber", "FragmentCharge", *extra, F.lit("mock").alias("PredictionBackend"))


NOTATION = r"[(\[]|UniMod|UNIMOD|\+\d"


def check_plain_sequences(precursors: DataFrame, source: str = "stripped", sequence_input: str = "peptide_sequences") -> None:
    """For models that take bare sequences: none may hold modification notation, and bare ones may not stand for variable modifications."""
    plain = source == "stripped" or sequence_input == "peptide_sequences"
    notation = F.col("StrippedPeptide" if source == "stripped" else "ModifiedPeptide").rlike(NOTATION) if plain else F.lit(False)
    varied = F.lit(False)
    if source == "stripped" and "NVariableMods" in precursors.columns:
        varied = varied | (F.coalesce(F.col("NVariableMods").try_cast("double"), F.lit(0.0)) > 0)
    if source == "stripped" and "VariableOxidationM" in precursors.columns:
        varied = varied | F.coalesce(F.lower(F.col("VariableOxidationM").cast("string")).isin("true", "1", "1.0", "yes"), F.lit(False))
    if source == "stripped" and "OxidationMPositions" in precursors.columns:
        varied = varied | (F.size(P.parse_positions(F.col("OxidationMPositions").cast("string"))) > 0)
    found = precursors.agg(F.count_if(notation), F.count_if(varied)).first()
    if found[0]:
        raise DataError("the model takes plain sequences, but some hold modification notation")
    if found[1]:
        raise DataError("variable modifications are lost in plain sequences")


# Names under which models answer.
ANSWER_NAMES = {
    "intensity": ["intensities", "intensity", "LibraryIntensity", "fragment_intensities"],
    "annotation": ["annotation", "annotations", "ion", "ions", "fragment_annotations"],
    "mz": ["mz", "mzs", "ProductMz", "product_mz", "fragment_mz"],
    "sequence": ["peptide_sequences", "peptide_sequence", "sequence", "sequences"],
    "charge": ["precursor_charges", "precursor_charge", "precursorCharge", "charge", "charges"],
    "index": ["input_index", "input_id", "precursor_index", "row_index", "sample_index"],
}
PART = "_specloom_part_"


def _text(values: pd.Series) -> pd.Series:
    return values.map(lambda x: x.decode(errors="replace") if isinstance(x, bytes) else str(x))


def rows_of_answers(part: pd.DataFrame, answer: pd.DataFrame, sequence: str, names: dict[str, str | None], array: bool) -> np.ndarray:
    """The precursor of a batch that each answer is for: row by row (array layout), or by sequence and charge, or by position."""
    if array:
        if len(answer) != len(part):
            raise ValueError(f"the model answered {len(answer)} rows for {len(part)} precursors")
        return np.arange(len(part))
    if names["sequence"] and names["charge"]:
        keys = pd.MultiIndex.from_arrays([part[sequence].astype(str), part["PrecursorCharge"].astype(int)])
        if keys.has_duplicates:
            raise DataError(f"a sequence and charge stand for several precursors: {keys[keys.duplicated()][0]}")
        asked = pd.MultiIndex.from_arrays([_text(answer[names["sequence"]]), answer[names["charge"]].astype(float).astype(int)])
        at = keys.get_indexer(asked)
        if (at < 0).any():
            raise DataError(f"{int((at < 0).sum())} answers are for no precursor of the batch, as {asked[at < 0][0]}")
    elif names["index"]:
        at = answer[names["index"]].astype(float).astype(int).to_numpy()
        at = at - (at == len(part))  # one past the end: positions count from one
        if ((at < 0) | (at >= len(part))).any():
            raise DataError(f"an answer's position is outside its batch of {len(part)}")
    else:
        raise DataError("a row for each fragment needs the sequence and charge, or a position")
    return at


def model_inputs(part: pd.DataFrame, sequence: str, names: Sequence[str], collision_energy: float) -> pd.DataFrame:
    """What a model gets: sequence, charge and, if the last name is not empty, collision energy."""
    inputs = pd.DataFrame({names[0]: part[sequence].astype(str).to_numpy(), names[1]: part["PrecursorCharge"].astype(int).to_numpy()})
    return inputs.assign(**{names[2]: float(collision_energy)}) if names[2] else inputs


def unnest(answers: DataFrame, intensity: str = "intensities", annotation: str = "annotation", mz: str | None = None) -> DataFrame:
    """Array layout: one row a fragment. Arrays of unlike lengths are an error (null-padding would hide them)."""
    names = [intensity, annotation, *([mz] if mz else [])]
    same = F.lit(True)
    for c in names[1:]:
        same = same & (F.size(intensity) == F.size(c))
    checked = answers.withColumn(intensity, F.when(same, F.col(intensity)).otherwise(F.raise_error(F.lit("prediction arrays differ in length"))))
    rest = [c for c in answers.columns if c not in names]
    return checked.select(*rest, F.inline(F.arrays_zip(*names)))


def check_unique(precursors: DataFrame, source: str = "StrippedPeptide") -> None:
    if not precursors.groupBy(source, "PrecursorCharge").count().where("count > 1").limit(1).isEmpty():
        raise DataError("a sequence and charge stand for several precursors")


MASSES = "_specloom_masses"


def _masses(rows: DataFrame) -> Column:
    fixed = F.coalesce(F.col("FixedCarbamidomethylC").cast("boolean"), F.lit(True)) if "FixedCarbamidomethylC" in rows.columns else F.lit(True)
    ox = P.parse_positions(F.col("OxidationMPositions").cast("string")) if "OxidationMPositions" in rows.columns else F.array().cast("array<int>")
    return P.residue_masses(F.col("StrippedPeptide"), fixed, ox)


def to_library(fragments: DataFrame, annotation: str = "annotation", intensity: str = "intensities", mz: str | None = None, backend: str = "koina", model: str = "", collision_energy: float = 30.0, drop_zero: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """Fragments with their precursor's columns to transitions. Annotations that name no b or y ion are left out."""
    text = F.decode(F.col(annotation), "UTF-8") if dict(fragments.dtypes)[annotation] == "binary" else F.col(annotation)
    rows = fragments.withColumn("_specloom_a", P.annotation(text)).where("_specloom_a is not null")
    rows = rows.withColumns({"FragmentType": F.col("_specloom_a.ion"), "FragmentSeriesNumber": F.col("_specloom_a.number"), "FragmentCharge": F.col("_specloom_a.charge"), "LibraryIntensity": F.col(intensity), "FragmentAnnotation": text})
    made = P.fragment_mz(F.col(MASSES) if MASSES in fragments.columns else _masses(fragments), F.col("FragmentType"), F.col("FragmentSeriesNumber"), F.col("FragmentCharge"))
    rows = rows.withColumn("ProductMz", F.coalesce(F.when(F.col(mz) > 0, F.col(mz).cast("double")), made) if mz else made)
    rows = positive_intensity(rows, drop_zero).where("ProductMz is not null")
    rows = rows.withColumns({"PredictionBackend": F.lit(backend), "PredictionModel": F.lit(model), "CollisionEnergy": F.lit(float(collision_energy))})
    last = ["FragmentAnnotation", "PredictionBackend", "PredictionModel", "CollisionEnergy"]
    first = ["ModifiedPeptide", "StrippedPeptide", *LIBRARY_COLUMNS[1:]]
    return rows.select(*first, *[c for c in extra if c not in (*first, *last)], *last)


class ModelPredictor:
    """A remote or local model behind ``client``, which makes one caller a task: a frame of inputs to a frame of answers.

    ``schema`` says what an answer holds; without it the model is asked about one precursor. Every answer is put beside its
    precursor within its batch, so no plan is evaluated twice and joined.
    """

    def __init__(self, client: Callable, schema: str | None = None, model: str = "", batch_size: int = 1024, sequence_source: str = "stripped", collision_energy: float = 30.0, intensity: str = "intensities", annotation: str = "annotation", mz: str | None = None, drop_zero: bool = True, sequence_input: str = "peptide_sequences", charge_input: str = "precursor_charges", ce_input: str = "collision_energies"):
        if not model:
            raise ValueError("a model name is needed")
        if sequence_source not in ("stripped", "modified"):
            raise ValueError("sequence_source must be stripped or modified")
        positive("batch_size", batch_size)
        self.client, self.schema, self.model, self.batch_size, self.collision_energy, self.drop_zero = client, schema, model, batch_size, collision_energy, drop_zero
        self.source, self.sequence = sequence_source, {"stripped": "StrippedPeptide", "modified": "ModifiedPeptide"}[sequence_source]
        self.inputs, self.preferred = (sequence_input, charge_input, ce_input), {"intensity": intensity, "annotation": annotation, "mz": mz, "sequence": sequence_input, "charge": charge_input}

    def answer_schema(self, precursors: DataFrame) -> T.StructType:
        if self.schema:
            return T.StructType.fromDDL(self.schema)
        one = precursors.limit(1).toPandas()
        if one.empty:
            return T.StructType.fromDDL("intensities array<double>, annotation array<string>")
        frame = pd.DataFrame(self.client()(model_inputs(one, self.sequence, self.inputs, self.collision_energy)))
        listed = {c: [list(x) for x in frame[c]] if isinstance(frame[c].iloc[0], (list, tuple, np.ndarray)) else frame[c] for c in frame.columns} if len(frame) else {}
        return precursors.sparkSession.createDataFrame(pd.DataFrame(listed)).schema

    def predict(self, precursors: DataFrame) -> DataFrame:
        require(precursors, ["ModifiedPeptide", "PrecursorCharge", "PrecursorMz", self.sequence])
        check_plain_sequences(precursors, self.source, self.inputs[0])
        schema = self.answer_schema(precursors)
        kinds = {f.name: f.dataType for f in schema}
        as_library = all(c in kinds for c in LIBRARY_COLUMNS)
        names = {k: find_name(list(kinds), self.preferred.get(k), v) for k, v in ANSWER_NAMES.items()}
        for k in ("intensity", "annotation"):
            if not as_library and names[k] is None:
                raise ValueError(f"the model's answer has no {k}; it holds {list(kinds)}")
        array = not as_library and any(isinstance(kinds[names[k]], T.ArrayType) for k in ("intensity", "annotation"))
        wanted = list(kinds) if as_library else [names[k] for k in ("intensity", "annotation", "mz") if names[k]]
        columns, client, size, sequence, inputs, energy = precursors.columns, self.client, self.batch_size, self.sequence, self.inputs, self.collision_energy

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = client()
            for frame in frames:
                for at in range(0, len(frame), size):
                    part = frame.iloc[at : at + size].reset_index(drop=True)
                    yield pd.DataFrame(call(model_inputs(part, sequence, inputs, energy))).reset_index(drop=True)[wanted]

        if as_library:
            answers = precursors.mapInPandas(run, schema)
            return positive_intensity(answers, self.drop_zero).withColumns({"PredictionBackend": F.lit("koina"), "PredictionModel": F.lit(self.model)})
        kind = T.StructType([T.StructField(PART + c, kinds[c]) for c in wanted])
        arrow = [to_arrow_type(f.dataType) for f in kind]

        def beside(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            call = client()
            for texts, charges in batches:
                frame, counts, found = pd.DataFrame({sequence: texts.to_pandas(), "PrecursorCharge": charges.to_pandas()}), [], []
                for first in range(0, len(frame), size):
                    part = frame.iloc[first : first + size].reset_index(drop=True)
                    answer = pd.DataFrame(call(model_inputs(part, sequence, inputs, energy))).reset_index(drop=True)
                    at = rows_of_answers(part, answer, sequence, names, array)
                    counts.append(np.bincount(at, minlength=len(part)))
                    answer = answer.iloc[np.argsort(at, kind="stable")]
                    found.append(pa.StructArray.from_arrays([pa.Array.from_pandas(answer[c], type=t, safe=False) for c, t in zip(wanted, arrow, strict=True)], [f.name for f in kind]))
                ends = np.concatenate([[0], *counts]).cumsum().astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(found) if found else pa.array([], pa.struct(list(zip(kind.names, arrow, strict=True)))))

        # sequence and charge alone go to Python, the other columns wait beside it; those that nobody reads are not made
        asked = F.arrow_udf(beside, T.ArrayType(kind)).asNondeterministic()(F.col(sequence), F.col("PrecursorCharge"))
        answers = precursors.withColumn(MASSES, _masses(precursors)).withColumn(PART, asked).select(*columns, MASSES, F.inline(PART))  # masses once a precursor
        at = {k: PART + names[k] if names[k] else None for k in ("intensity", "annotation", "mz")}
        if array:
            answers = unnest(answers, at["intensity"], at["annotation"], at["mz"])
        return to_library(answers, at["annotation"], at["intensity"], at["mz"], "koina", self.model, self.collision_energy, self.drop_zero, precursors.columns)


def remote_client(model: str, server_url: str, ssl: bool = True) -> Callable:
    """A client of a model server; its package is looked for when the first batch is sent."""

    def make() -> Callable[[pd.DataFrame], pd.DataFrame]:
        try:
            from koinapy import Koina
        except ImportError as e:
            raise ImportError("the remote predictor needs the koinapy package on driver and executors") from e
        return Koina(model, server_url, ssl=ssl).predict

    return make


def remote(model: str = "", server_url: str = "", ssl: bool = True, client: Callable | None = None, **options: Any) -> ModelPredictor:
    if client is None and not server_url:
        raise ValueError("a server_url is needed")
    return ModelPredictor(client or remote_client(model, server_url, ssl), model=model, **options)


class MockPredictor:
    def __init__(self, **options: Any):
        self.options = options

    def predict(self, precursors: DataFrame) -> DataFrame:
        return mock(precursors, **self.options)


def get_predictor(backend: str, **options: Any) -> Predictor:
    made = {"mock": MockPredictor, "koina": remote}
    if backend not in made:
        raise ValueError(f"backend must be one of {', '.join(made)}")
    return made[backend](**options)


def _rt_columns(df: DataFrame, modified: str, stripped: str | None, carbamidomethyl_c: bool, seq: str, mods: str) -> DataFrame:
    require(df, [modified])
    made = P.rt_input(F.col(modified), F.col(stripped) if stripped and stripped in df.columns else None, carbamidomethyl_c)
    return df.withColumn("_specloom_rt", made).withColumns({seq: F.col("_specloom_rt.seq"), mods: F.col("_specloom_rt.modifications")}).drop("_specloom_rt")


def rt_model_input(precursors: DataFrame, modified: str = "ModifiedPeptide", stripped: str | None = "StrippedPeptide", carbamidomethyl_c: bool = True) -> DataFrame:
    """``precursors`` with what a retention time model takes, seq and modifications."""
    return _rt_columns(precursors, modified, stripped, carbamidomethyl_c, "seq", "modifications")


def calibration_input(table: DataFrame, rt_column: str = "tr", modified: str = "ModifiedPeptide", stripped: str | None = "StrippedPeptide", carbamidomethyl_c: bool = True) -> DataFrame:
    """seq, modifications, tr from a native table or from one like a library."""
    require(table, [rt_column])
    rows = table if "seq" in table.columns and "modifications" in table.columns else rt_model_input(table, modified, stripped, carbamidomethyl_c)
    return rows.select("seq", F.coalesce("modifications", F.lit("")).alias("modifications"), numeric(rt_column).alias("tr")).where("tr is not null")


def deeplc(model_path: str | None = None) -> Callable:
    """A retention time model of the deeplc package, which is looked for when the first batch is sent."""

    def make(calibration: pd.DataFrame | None) -> Callable[[pd.DataFrame], Any]:
        try:
            from deeplc import DeepLC
        except ImportError as e:
            raise ImportError("this retention time backend needs the deeplc package on all executors") from e
        model = DeepLC(path_model=model_path) if model_path else DeepLC()
        if calibration is not None:
            model.calibrate_preds(seq_df=calibration)
            return lambda frame: model.make_preds(seq_df=frame)
        return lambda frame: model.make_preds(seq_df=frame, calibrate=False)

    return make


def _times(answer: Any, n: int) -> np.ndarray:
    """One time a peptide form from whatever layout a model answers in."""
    if isinstance(answer, pd.DataFrame):
        known = [c for c in ("predicted_tr", "rt", "tr", "prediction", "predictions") if c in answer.columns] or list(answer.columns)
        if len(known) > 1 and answer.shape[1] == len(known):
            raise ValueError(f"the model answered several columns, {known}")
        answer = answer[known[0]]
    times = np.asarray(answer, dtype=float).reshape(-1)
    if len(times) != n:
        raise ValueError(f"the model answered {len(times)} times for {n} peptides")
    return times


def predict_rt(precursors: DataFrame, backend: str = "mock", output: str = "NormalizedRetentionTime", model: Callable | None = None, modified: str = "ModifiedPeptide", stripped: str | None = "StrippedPeptide", carbamidomethyl_c: bool = True, calibration: DataFrame | None = None, calibration_rt_column: str = "tr", most_calibration: int = 1_000_000, fit: Callable[[DataFrame], Any] | None = None) -> DataFrame:
    """One prediction a distinct peptide form, joined back to its precursors.

    ``model`` takes the calibration frame (seq, modifications, tr) or None, once a task, and makes a caller: frames of seq and
    modifications to times. The calibration goes whole to every task, so it may have ``most_calibration`` rows at most. With ``fit``
    it may have any number: ``fit`` makes what ``model`` takes instead, from the whole table as a DataFrame.
    """
    seq, mods = "_specloom_seq", "_specloom_mods"
    rows = _rt_columns(precursors.drop(output), modified, stripped, carbamidomethyl_c, seq, mods)
    forms = rows.select(F.col(seq).alias("seq"), F.col(mods).alias("modifications")).distinct()
    if backend == "mock":
        times = forms.withColumn(output, P.mock_rt(F.col("seq"), F.col("modifications")))
    elif backend == "deeplc":
        make, table = model or deeplc(), None
        if calibration is not None:
            table = calibration_input(calibration, calibration_rt_column, modified, stripped, carbamidomethyl_c)
            if fit is not None:
                table = fit(table)
            else:
                table = table.orderBy("seq", "modifications", "tr").limit(most_calibration + 1).toPandas()
                if len(table) > most_calibration:
                    raise ValueError(f"the calibration has more than {most_calibration} rows")
                table = table if len(table) else None
        shared = precursors.sparkSession.sparkContext.broadcast(table)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = make(shared.value)
            for frame in frames:
                yield frame.assign(**{output: _times(call(frame[["seq", "modifications"]]), len(frame))})

        times = forms.mapInPandas(run, f"seq string, modifications string, `{output}` double")
    else:
        raise ValueError(f"retention time backend {backend!r} is not one of mock, deeplc")
    times = times.select(F.col("seq").alias("_specloom_s"), F.col("modifications").alias("_specloom_o"), output)
    joined = rows.join(times, F.col(seq).eqNullSafe(F.col("_specloom_s")) & F.col(mods).eqNullSafe(F.col("_specloom_o")), "left")
    return joined.drop("_specloom_s", "_specloom_o", seq, mods)


def rt_stats(df: DataFrame, output: str = "NormalizedRetentionTime") -> DataFrame:
    return df.agg(F.count("*").alias("n_precursor_rows_input"), F.count(output).alias("n_precursor_rows_with_rt"), F.min(output).alias("rt_min"), F.max(output).alias("rt_max"), F.median(output).alias("rt_median"))


def check_complete(df: DataFrame, output: str = "NormalizedRetentionTime") -> None:
    if not df.where(F.col(output).isNull()).limit(1).isEmpty():
        raise DataError("some rows have no retention time")
