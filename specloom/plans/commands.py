"""The commands: read, transform, write with a summary and a parameter file beside the output."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.operators import combine, controls, digest, filters, predict, report, rt, sample, select
from specloom.plans import presets
from specloom.schema import MINIMAL_COLUMNS, drop_helpers, require
from specloom.sources import tables

log = logging.getLogger("specloom")


@contextmanager
def step(name: str):
    began = time.time()
    log.info("%s ...", name)
    yield
    log.info("%s: %.1f s", name, time.time() - began)


def finish(df: DataFrame, output: str, mode: str, stats: dict[str, Any], params: dict[str, Any], top_n: int | None = None, single_file: bool = False) -> dict[str, Any]:
    """Writes the library, then one aggregation over what was written."""
    spark = df.sparkSession
    with step(f"{mode}: write {output}"):
        tables.write_library(drop_helpers(select.in_library_order(df)), output, single_file)
    summary_path, params_path = tables.sidecar_paths(output)
    row = report.library_summary(tables.read_table(spark, output), top_n).first().asDict()
    summary = {"mode": mode, "output_file": output, **row, **stats}
    tables.write_summary(spark, summary, summary_path)
    tables.write_params(spark, params, params_path)
    return summary


def minimal(df: DataFrame, rt_column: str | None = None) -> DataFrame:
    columns = [*MINIMAL_COLUMNS, *([rt_column] if rt_column else [])]
    require(df, columns)
    return df.select(*columns)


def with_rt_output(df: DataFrame, rt_column: str, output: str) -> DataFrame:
    if rt_column in df.columns:
        return df.withColumn(output, F.col(rt_column))
    require(df, [output])
    return df


def digest_fasta(spark: SparkSession, fasta: str, output: str, preset: str = "none", single_file: bool = False, **options: Any) -> dict[str, Any]:
    limits = {k: options.pop(k, None) for k in presets.DIGEST_DEFAULTS}
    settings = presets.digest_settings(preset, **limits) | options
    proteins = tables.read_fasta(spark, fasta)
    found = digest.precursor_table(proteins, **settings)
    tables.write_table(found.orderBy("ModifiedPeptide", "PrecursorCharge", "ProteinId"), output, single_file)
    summary_path, params_path = tables.sidecar_paths(output)
    summary = {"mode": "digest", "output_file": output, **settings, **digest.digest_stats(proteins, **settings).first().asDict()}
    tables.write_summary(spark, summary, summary_path)
    tables.write_params(spark, {"fasta": fasta, "preset": preset, **settings}, params_path)
    return summary


def predictor_of(backend: str, settings: dict[str, Any], model: str | dict[str, Any] | None = None, server_url: str = "", ssl: bool = True, collision_energy: float = 30.0, batch_size: int = 1024, sequence_source: str = "stripped", koina_sequence_input: str = "peptide_sequences", koina_charge_input: str = "precursor_charges", koina_ce_input: str = "collision_energies", koina_intensity_col: str = "intensities", koina_annotation_col: str = "annotation", koina_mz_col: str | None = None, drop_zero_intensity: bool = True, top_n: int | None = None) -> predict.Predictor:
    """``settings`` are resolved limits; ``model`` is a name, or all options of a predictor with a client of its own."""
    if backend == "mock":
        made = {k: settings[k] for k in ("fragment_types", "fragment_charges", "max_fragment_series")}
        return predict.get_predictor(backend, **made, limits=settings if top_n else None, top_n=top_n)
    if isinstance(model, dict):
        return predict.get_predictor(backend, **model)
    return predict.get_predictor(backend, model=model or "", server_url=server_url, ssl=ssl, collision_energy=collision_energy, batch_size=batch_size, sequence_source=sequence_source, sequence_input=koina_sequence_input, charge_input=koina_charge_input, ce_input=koina_ce_input, intensity=koina_intensity_col, annotation=koina_annotation_col, mz=koina_mz_col, drop_zero=drop_zero_intensity)


def _split(preset: str, options: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
    """Resolved limits, and the options of the predictor."""
    settings = presets.predict_settings(preset, **{k: options.pop(k) for k in presets.PREDICT_DEFAULTS if k in options})
    settings.pop("recommended_top_n")
    return settings, options


def predicted(precursors: DataFrame, backend: str = "mock", preset: str = "none", top_n: int | None = None, include_metadata: bool = False, include_rt: bool = False, rt_column: str = rt.DEFAULT_RT, rt_output_column: str = rt.DEFAULT_RT, drop_unsupported_aa: bool = False, **options: Any) -> DataFrame:
    """Precursors to a library: U guard, predictor, filters, top-N, columns."""
    settings, options = _split(preset, options)
    rows = filters.supported_only(precursors, drop_unsupported_aa, allow=backend == "mock")
    out = predictor_of(backend, settings, top_n=top_n, **options).predict(rows)
    return finished(out, settings, top_n, include_metadata, include_rt, rt_column, rt_output_column)


def finished(out: DataFrame, settings: dict[str, Any], top_n: int | None, include_metadata: bool, include_rt: bool, rt_column: str, rt_output_column: str) -> DataFrame:
    """What a predictor made, with the retention time's column, filtered, cut to the most intense, in the output's columns."""
    if include_rt:
        out = with_rt_output(out, rt_column, rt_output_column)
    out = filters.filter_transitions(out, **settings)
    if top_n is not None:
        out = select.top_n(out, top_n)
    return out if include_metadata else minimal(out, rt_output_column if include_rt else None)


def predict_table(spark: SparkSession, precursors: str, output: str, single_file: bool = False, **options: Any) -> dict[str, Any]:
    rows = tables.read_table(spark, precursors)
    settings = presets.predict_settings(options.get("preset", "none"), **{k: options.get(k) for k in presets.PREDICT_DEFAULTS})
    counts = rows.agg(F.count("*").alias("n_precursors_input"), F.count_if(filters.unsupported(rows)).alias("n_precursors_with_unsupported_aa_input")).first().asDict()
    return finish(predicted(rows, **options), output, "predict", {"backend": options.get("backend", "mock")} | counts, {"precursors": precursors, **settings, **options}, options.get("top_n"), single_file)


def _fingerprint(params: dict[str, Any]) -> str:
    """Of what decides a chunk's content; columns are chosen when chunks are merged."""
    return hashlib.sha256(json.dumps({k: v for k, v in params.items() if k != "include_metadata"}, sort_keys=True, default=str).encode()).hexdigest()


#: The counters that are summed over chunks.
ROLLED_UP = [
    "n_precursors_input", "n_precursors_with_unsupported_aa_input", "n_precursors_dropped_unsupported_aa", "n_precursors_predicted_input",
    "n_transitions_predicted_raw", "n_transitions_predicted", "n_transitions_before_transition_filters", "n_transitions_filtered_by_transition_filters",
    "n_transitions_after_transition_filters", "n_duplicate_transitions_removed", "n_precursors_with_less_than_n", "n_precursors_output", "n_transitions_output",
]


def _predict_chunk(spark: SparkSession, rows: DataFrame, path: str, backend: str, settings: dict[str, Any], top_n: int | None, drop_unsupported_aa: bool, chosen: tuple[bool, str, str], options: dict[str, Any]) -> dict[str, Any]:
    """Predicts once to a raw table, which gives the counters and the chunk's library, and goes then."""
    kept = filters.supported_only(rows, drop_unsupported_aa, allow=backend == "mock")
    raw_path = f"{path.removesuffix('.parquet')}.raw.parquet"
    tables.write_table(predictor_of(backend, settings, **options).predict(kept), raw_path)
    raw = tables.read_table(spark, raw_path)
    tables.write_library(drop_helpers(finished(raw, settings, top_n, True, *chosen)), path)
    unsupported = F.count_if(filters.unsupported(rows))
    counts = rows.agg(F.count("*").alias("n_precursors_input"), unsupported.alias("n_precursors_with_unsupported_aa_input")).first().asDict()
    counts["n_precursors_dropped_unsupported_aa"] = counts["n_precursors_with_unsupported_aa_input"] if drop_unsupported_aa and backend != "mock" else 0
    counts["n_precursors_predicted_input"] = counts["n_precursors_input"] - counts["n_precursors_dropped_unsupported_aa"]
    counts |= filters.filter_stats(raw, **settings).first().asDict()
    counts["n_transitions_predicted_raw"], counts["n_transitions_predicted"] = counts["n_transitions_before_transition_filters"], counts["n_transitions_after_transition_filters"]
    if top_n is not None:
        counts |= filters.filter_transitions(raw, **settings).agg(select.duplicates_removed(raw)).first().asDict()
    counts |= report.library_summary(tables.read_table(spark, path), top_n).first().asDict()
    tables.remove(spark, raw_path)
    return counts


def predict_chunked(spark: SparkSession, precursors: str, output: str, work_dir: str | None = None, chunks: int | None = None, chunk_size: int = 100_000, resume: bool = True, force: bool = False, backend: str = "mock", preset: str = "none", top_n: int | None = None, include_metadata: bool = False, include_rt: bool = False, rt_column: str = rt.DEFAULT_RT, rt_output_column: str = rt.DEFAULT_RT, drop_unsupported_aa: bool = False, single_file: bool = False, **options: Any) -> dict[str, Any]:
    """Precursors dealt to chunks of about ``chunk_size`` rows (or ``chunks`` of them) by hash, so that a precursor is never split.

    The chunks are written once, each in a folder of its own; a chunk is complete when its library and its done marker are there, and
    complete chunks of the same parameters are kept. The output is merged from all chunks when they are complete.
    """
    given = {"backend": backend, "preset": preset, "top_n": top_n, "include_rt": include_rt, "rt_column": rt_column, "rt_output_column": rt_output_column, "drop_unsupported_aa": drop_unsupported_aa, **options}
    settings, options = _split(preset, dict(options))
    work_dir = work_dir or f"{output.removesuffix(tables.form_of(output))}.chunked_work"
    rows = tables.read_table(spark, precursors)
    n_input = rows.count()
    n_chunks = chunks or max(1, -(-n_input // chunk_size))
    mark = _fingerprint({"precursors": precursors, "n_input": n_input, "chunks": n_chunks, **given})[:12]
    dealt = f"{work_dir}/precursors.{mark}.parquet"
    if force or not tables.exists(spark, f"{dealt}/_SUCCESS"):
        chunk = F.pmod(F.xxhash64("ModifiedPeptide", "PrecursorCharge"), F.lit(n_chunks)).cast("int")
        rows.withColumn("_specloom_chunk", chunk).repartition(min(n_chunks, 10_000), "_specloom_chunk").write.mode("overwrite").partitionBy("_specloom_chunk").parquet(dealt)
    all_chunks = spark.read.schema(T.StructType([*rows.schema, T.StructField("_specloom_chunk", T.IntegerType())])).parquet(dealt)
    manifest = []
    for i in range(n_chunks):
        path = f"{work_dir}/chunk_{i:05d}.{mark}.parquet"
        done, summary_path = f"{path}.done.json", f"{path}.summary.tsv"
        if force or not (resume and tables.exists(spark, f"{path}/_SUCCESS") and tables.exists(spark, done)):
            with step(f"chunk {i}"):
                counts = _predict_chunk(spark, all_chunks.where(F.col("_specloom_chunk") == i).drop("_specloom_chunk"), path, backend, settings, top_n, drop_unsupported_aa, (include_rt, rt_column, rt_output_column), options)
            tables.write_summary(spark, {"mode": "predict-chunked", "chunk_index": i, "output_file": path, **counts}, summary_path)
            tables.write_params(spark, {"chunk_index": i, "precursors": precursors, **given}, f"{path}.params.json")
            tables.write_json(spark, {"chunk_id": f"chunk_{i:05d}", "chunk_index": i, "output": path, "summary": summary_path, "n_precursors": counts["n_precursors_input"], "n_transitions_output": counts["n_transitions_output"]}, done)
        manifest.append({"chunk_index": i, "chunk_id": f"chunk_{i:05d}", "precursor_chunk_file": f"{dealt}/_specloom_chunk={i}", "predicted_chunk_file": path, "summary": summary_path, "done_marker": done, "completed": tables.exists(spark, done)})
    tables.write_json(spark, {"chunks": manifest}, f"{work_dir}/chunks_manifest.json")
    if not all(m["completed"] for m in manifest):
        raise RuntimeError("some chunks are not complete; run the same command again")
    columns = None if include_metadata else [*MINIMAL_COLUMNS, *([rt_output_column] if include_rt else [])]
    tables.merge_tables(spark, [m["predicted_chunk_file"] for m in manifest], output, columns, single_file, select.in_library_order)
    rolled = report.roll_up(tables.read_summaries(spark, [m["summary"] for m in manifest]), ROLLED_UP)
    whole = report.library_summary(tables.read_table(spark, output), top_n).first().asDict()  # exact, also the median
    summary_path, params_path = tables.sidecar_paths(output)
    summary = {"mode": "predict-chunked", "output_file": output, "n_chunks": n_chunks, **rolled, **whole}
    tables.write_summary(spark, summary, summary_path)
    tables.write_params(spark, {"precursors": precursors, "chunk_size": chunk_size, "chunks": manifest, **settings, **given}, params_path)
    return summary


def _library_command(mode: str, f: Callable[[DataFrame], DataFrame], dedup: bool = True) -> Callable[..., dict[str, Any]]:
    def run(spark: SparkSession, input: str, output: str, single_file: bool = False, **options: Any) -> dict[str, Any]:
        rows = tables.read_library(spark, input)
        counts = rows.agg(F.count("*").alias("n_transitions_input"), *([select.duplicates_removed(rows)] if dedup else [])).first().asDict()
        return finish(f(rows, **options), output, mode, counts | options, {"input": input, **options}, options.get("top_n"), single_file)

    return run


max_n = _library_command("max-n", lambda df, top_n: select.top_n(df, top_n))
random_n = _library_command("random-n", lambda df, top_n, seed=42: controls.random_n(df, top_n, seed))
reverse_intensity = _library_command("reverse-intensity", lambda df: controls.reverse_intensity(df), dedup=False)


def _pair_command(mode: str, f: Callable, policy: str) -> Callable[..., dict[str, Any]]:
    def run(spark: SparkSession, input_a: str, input_b: str, output: str, top_n: int, single_file: bool = False) -> dict[str, Any]:
        a, b = tables.read_library(spark, input_a), tables.read_library(spark, input_b)
        stats = combine.input_stats(a, b).first().asDict() | {"top_n": top_n, "duplicate_policy": policy}
        return finish(f(a, b, top_n), output, mode, stats, {"input_a": input_a, "input_b": input_b, "top_n": top_n}, top_n, single_file)

    return run


union = _pair_command("union", combine.union, "keep_input_a")
consensus = _pair_command("consensus", combine.consensus, "prefer_input_a")


def add_rt(spark: SparkSession, library: str, rt_table: str, output: str, rt_column: str, key: str = "ModifiedPeptide,PrecursorCharge", rt_output_column: str = rt.DEFAULT_RT, min_match_rate: float = 0.99, single_file: bool = False) -> dict[str, Any]:
    left, right, keys = tables.read_library(spark, library), tables.read_table(spark, rt_table), rt.parse_key(key)
    stats = rt.stats(left, right, rt_column, keys, rt_output_column).first().asDict()
    rt.check_match_rate(stats, min_match_rate)
    return finish(rt.attach(left, right, rt_column, keys, rt_output_column), output, "add-rt", stats, {"library": library, "rt_table": rt_table, "rt_column": rt_column, "key": key}, None, single_file)


def predict_rt(spark: SparkSession, precursors: str, output: str, backend: str = "deeplc", rt_output_column: str = rt.DEFAULT_RT, calibration_table: str | None = None, calibration_rt_column: str = "tr", deeplc_model_path: str | None = None, single_file: bool = False, **options: Any) -> dict[str, Any]:
    if calibration_table:
        options["calibration"] = tables.read_table(spark, calibration_table)
    if backend == "deeplc" and "model" not in options:
        options["model"] = predict.deeplc(deeplc_model_path)
    found = predict.predict_rt(tables.read_table(spark, precursors), backend, rt_output_column, calibration_rt_column=calibration_rt_column, **options)
    tables.write_table(found, output, single_file)
    written = tables.read_table(spark, output)
    predict.check_complete(written, rt_output_column)
    summary = {"mode": "predict-rt", "output_file": output, "rt_backend": backend, "rt_output_column": rt_output_column, "calibrated": bool(calibration_table), **predict.rt_stats(written, rt_output_column).first().asDict()}
    summary_path, params_path = tables.sidecar_paths(output)
    tables.write_summary(spark, summary, summary_path)
    tables.write_params(spark, {"precursors": precursors, "backend": backend, "calibration_table": calibration_table, "calibration_rt_column": calibration_rt_column, "deeplc_model_path": deeplc_model_path, "rt_output_column": rt_output_column}, params_path)
    return summary


def build(spark: SparkSession, fasta: str, output_dir: str, prefix: str = "library", preset: str = "generic-dia", top_n: int = 7, work_dir: str | None = None, chunk_size: int = 100_000, sample_size: int | None = None, random_state: int = 42, rt_backend: str | None = "mock", rt_output_column: str = "PredictedRetentionTime", calibration_table: str | None = None, calibration_rt_column: str = "tr", deeplc_model_path: str | None = None, backend: str = "mock", model_a: str | dict[str, Any] | None = None, model_b: str | dict[str, Any] | None = None, make_union: bool = True, drop_unsupported_aa: bool = True, resume: bool = True, force: bool = False, digest_options: dict[str, Any] | None = None, **options: Any) -> dict[str, Any]:
    """FASTA to precursors, sample, retention times, two predicted libraries and their union. Every step's table is kept; with
    ``resume`` those of the same parameters are not made again. ``options`` go to the predictor (server_url, batch_size, limits ...)."""
    settings = presets.digest_settings(preset, **(digest_options or {}))
    work_dir = work_dir or f"{output_dir}/{prefix}.build_work"
    mark = _fingerprint({"fasta": fasta, "settings": settings, "sample_size": sample_size, "random_state": random_state, "drop": drop_unsupported_aa, "rt": [rt_backend, rt_output_column, calibration_table, calibration_rt_column, deeplc_model_path]})[:12]

    def made(name: str, make: Callable[[], DataFrame]) -> str:
        path = f"{work_dir}/{prefix}.{name}.{mark}.parquet"
        if force or not (resume and tables.exists(spark, f"{path}/_SUCCESS")):
            with step(name):
                tables.write_table(make(), path)
        return path

    every = made("precursors.all", lambda: digest.precursor_table(tables.read_fasta(spark, fasta), **settings))
    active = made("precursors.active", lambda: sample.stratified(tables.read_table(spark, every), sample_size, seed=random_state, drop_unsupported=drop_unsupported_aa))
    if rt_backend:
        found = {"model": predict.deeplc(deeplc_model_path)} if rt_backend == "deeplc" else {}
        found |= {"calibration": tables.read_table(spark, calibration_table), "calibration_rt_column": calibration_rt_column} if calibration_table else {}
        timed = made("precursors.with_rt", lambda: predict.predict_rt(tables.read_table(spark, active), rt_backend, rt_output_column, **found))
    else:
        timed = active
    out = {"precursors": f"{output_dir}/{prefix}.precursors.parquet"}
    tables.write_table(tables.read_table(spark, timed).orderBy("ModifiedPeptide", "PrecursorCharge"), out["precursors"])
    for name, model in (("a", model_a), ("b", model_b)):
        out[name] = f"{output_dir}/{prefix}.{name}.top{top_n}.parquet"
        predict_chunked(spark, timed, out[name], f"{work_dir}/{prefix}.{name}.top{top_n}.work", chunk_size=chunk_size, resume=resume, force=force, backend=backend, preset=preset, top_n=top_n, include_rt=bool(rt_backend), rt_column=rt_output_column, rt_output_column=rt_output_column, drop_unsupported_aa=drop_unsupported_aa, **({} if model is None else {"model": model}), **options)
    if make_union:
        out["union"] = f"{output_dir}/{prefix}.union{2 * top_n}.parquet"
        union(spark, out["a"], out["b"], out["union"], top_n)
    tables.write_params(spark, {"fasta": fasta, "preset": preset, **settings, "top_n": top_n, "sample_size": sample_size, "random_state": random_state, "rt_backend": rt_backend, "backend": backend, "model_a": model_a, "model_b": model_b, "chunk_size": chunk_size, "outputs": out, **options}, f"{output_dir}/{prefix}.build.json")
    return out
