"""Proteins to peptides to charged precursors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import peptide as P

ENZYMES = ("trypsin", "trypsin-p", "trypsinp")


def pieces(sequence: Column, enzyme: str = "trypsin-p") -> Column:
    """The stretches between cleavage sites: after K and R, with ``trypsin`` not before P."""
    if enzyme not in ENZYMES:
        raise ValueError(f"enzyme must be one of {', '.join(ENZYMES)}")
    marked = F.regexp_replace(sequence, "([KR])", "$1|")
    if enzyme == "trypsin":
        marked = F.replace(marked, F.lit("|P"), F.lit("P"))
    return F.filter(F.split(marked, "[|]"), lambda x: x != "")


def digest(proteins: DataFrame, enzyme: str = "trypsin-p", missed_cleavages: int = 1) -> DataFrame:
    """(protein_id, description, peptide, missed): spans of 1 to missed_cleavages + 1 pieces."""
    if missed_cleavages < 0:
        raise ValueError("missed_cleavages must not be negative")
    rows = proteins.select("protein_id", "description", pieces(F.col("sequence"), enzyme).alias("p"))
    span = "flatten(transform(p, (x, i) -> transform(sequence(0, least({k}, size(p) - 1 - i)), k -> named_struct('peptide', array_join(slice(p, i + 1, k + 1), ''), 'missed', k))))"
    return rows.select("protein_id", "description", F.inline(F.expr(span.format(k=int(missed_cleavages)))))


def peptide_filter(min_length: int = 7, max_length: int = 30, allow_selenocysteine: bool = False, remove_invalid: bool = True) -> tuple[Column, Column]:
    """Length fits; residues are known."""
    if not 1 <= min_length <= max_length:
        raise ValueError("lengths must be at least 1, and the least not above the greatest")
    known = F.col("peptide").rlike(f"^[{P.CANONICAL}{'U' if allow_selenocysteine else ''}]+$")
    return F.length("peptide").between(min_length, max_length), known if remove_invalid else F.lit(True)


def peptides(spans: DataFrame, **limits) -> DataFrame:
    """One row a peptide: sorted distinct protein ids and headers, least and most missed cleavages."""
    fits, known = peptide_filter(**limits)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return spans.where(fits).where(known).groupBy(F.col("peptide").alias("StrippedPeptide")).agg(joined("protein_id").alias("ProteinId"), F.size(F.collect_set("protein_id")).alias("ProteinCount"), joined("description").alias("ProteinDescription"), F.min("missed").alias("MinMissedCleavages"), F.max("missed").alias("MaxMissedCleavages"))


def oxidation_sets(sequence: Column, enabled: bool = False, most: int = 1) -> Column:
    """array<array<int>>: no oxidised M, and all combinations of 1 to ``most`` positions (0-based)."""
    if most < 0:
        raise ValueError("max_variable_mods must not be negative")
    none = F.array(F.array().cast("array<int>"))
    if not enabled or most == 0:
        return none
    at = F.filter(F.transform(P.letters(sequence), lambda c, i: F.when(c == "M", i)), lambda x: x.isNotNull())
    last = F.transform(at, lambda x: F.array(x))
    every = F.concat(none, last)
    for _ in range(most - 1):
        last = F.flatten(F.transform(last, lambda s: F.transform(F.filter(at, lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x)))))
        every = F.concat(every, last)
    return every


def precursors(found: DataFrame, charges: str = "2,3,4", carbamidomethyl_c: bool = True, c_mod_format: str = "unimod", variable_oxidation_m: bool = False, max_variable_mods: int = 1, m_mod_format: str = "unimod", charge_length_rules: str | None = "", min_precursor_mz: float | None = None, max_precursor_mz: float | None = None, filtered: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """Peptides by modification and charge, with m/z and the ``extra`` columns. ``filtered`` off keeps what rules and limits drop, with the reason in ``_specloom_drop``."""
    if min_precursor_mz is not None and max_precursor_mz is not None and min_precursor_mz > max_precursor_mz:
        raise ValueError("the least precursor m/z must not be above the greatest")
    seq, ox = F.col("StrippedPeptide"), F.col("_specloom_ox")
    rows = found.withColumn("_specloom_ox", F.explode(oxidation_sets(seq, variable_oxidation_m, max_variable_mods)))
    rows = rows.withColumn("_specloom_mass", P.neutral_mass(P.residue_masses(seq, carbamidomethyl_c, ox)))
    rows = rows.withColumn("PrecursorCharge", F.explode(F.array(*[F.lit(z) for z in P.parse_charges(charges)])))
    rows = rows.withColumn("PrecursorMz", P.mz(F.col("_specloom_mass"), F.col("PrecursorCharge")))
    short = F.lit(False)
    for z, least in P.parse_charge_rules(charge_length_rules).items():
        short = short | ((F.col("PrecursorCharge") == z) & (F.length("StrippedPeptide") < least))
    out = F.lit(False)
    if min_precursor_mz is not None:
        out = out | (F.col("PrecursorMz") < min_precursor_mz)
    if max_precursor_mz is not None:
        out = out | (F.col("PrecursorMz") > max_precursor_mz)
    rows = rows.withColumn("_specloom_drop", F.when(short, "charge_length").when(out, "mz"))
    names = ["ModifiedPeptide", "StrippedPeptide", "PrecursorCharge", "PrecursorMz", "ProteinId", "ProteinCount", "ProteinDescription", "PeptideLength", "MinMissedCleavages", "MaxMissedCleavages", "FixedCarbamidomethylC", "VariableOxidationM", "OxidationMPositions", "NVariableMods", "ContainsSelenocysteine"]
    rows = rows.withColumns({
        "ModifiedPeptide": P.modified_peptide(seq, carbamidomethyl_c, c_mod_format, ox if variable_oxidation_m else None, m_mod_format),
        "PeptideLength": F.length("StrippedPeptide"), "FixedCarbamidomethylC": F.lit(carbamidomethyl_c), "VariableOxidationM": F.size("_specloom_ox") > 0,
        "OxidationMPositions": P.format_positions(ox), "NVariableMods": F.size("_specloom_ox"), "ContainsSelenocysteine": F.contains(seq, F.lit("U")),
    })
    return rows.where(F.col("_specloom_drop").isNull()).select(*names, *extra) if filtered else rows.select(*names, *extra, "_specloom_drop")


def precursor_table(proteins: DataFrame, enzyme: str = "trypsin-p", missed_cleavages: int = 1, min_length: int = 7, max_length: int = 30, allow_selenocysteine: bool = False, remove_invalid_aa: bool = True, **options) -> DataFrame:
    found = peptides(digest(proteins, enzyme, missed_cleavages), min_length=min_length, max_length=max_length, allow_selenocysteine=allow_selenocysteine, remove_invalid=remove_invalid_aa)
    return precursors(found, **options)


def digest_stats(proteins: DataFrame, enzyme: str = "trypsin-p", missed_cleavages: int = 1, min_length: int = 7, max_length: int = 30, allow_selenocysteine: bool = False, remove_invalid_aa: bool = True, **options) -> DataFrame:
    """One row of counters, each in the order of the filters, from one digestion: peptides that are filtered stand for their count alone."""
    fits, known = peptide_filter(min_length, max_length, allow_selenocysteine, remove_invalid_aa)
    spans = digest(proteins, enzyme, missed_cleavages).select("peptide", fits.alias("_specloom_fits"), (fits & known).alias("_specloom_ok"))
    found = spans.groupBy(F.when(F.col("_specloom_ok"), F.col("peptide")).alias("peptide"), "_specloom_fits", "_specloom_ok").agg(F.count("*").alias("_specloom_n"))  # filtered ones are not shuffled
    blank = {c: F.lit(None) for c in ("ProteinId", "ProteinCount", "ProteinDescription", "MinMissedCleavages", "MaxMissedCleavages")}
    found = found.withColumn("StrippedPeptide", F.coalesce("peptide", F.lit(""))).withColumns(blank)
    rows = precursors(found, filtered=False, extra=["_specloom_n", "_specloom_fits", "_specloom_ok"], **options)
    ok, fits, drop = F.col("_specloom_ok"), F.col("_specloom_fits"), F.col("_specloom_drop")
    form = F.col("PrecursorCharge") == P.parse_charges(options.get("charges", "2,3,4"))[0]  # one row a form
    peptide = form & (F.col("NVariableMods") == 0)  # one row a peptide
    spans = {"n_raw_peptides": peptide, "n_length_filtered": peptide & ~fits, "n_invalid_aa_filtered": peptide & fits & ~ok}
    counts = {
        "n_unique_peptides": peptide, "n_unique_selenocysteine_peptides": peptide & F.col("ContainsSelenocysteine"), "n_unique_modified_peptides": form,
        "n_oxidized_modified_peptides": form & (F.col("NVariableMods") > 0), "n_precursors_before_filters": F.lit(True), "n_charge_length_filtered": F.coalesce(drop == "charge_length", F.lit(False)),
        "n_precursor_mz_filtered": F.coalesce(drop == "mz", F.lit(False)), "n_precursors_output": drop.isNull(), "n_selenocysteine_precursors_output": drop.isNull() & F.col("ContainsSelenocysteine"),
    }
    total = [F.coalesce(F.sum(F.when(c, F.col("_specloom_n"))), F.lit(0)).alias(k) for k, c in spans.items()]
    after = rows.agg(*total, *[F.count_if(ok & c).alias(k) for k, c in counts.items()])
    return proteins.agg(F.count("*").alias("n_proteins")).crossJoin(after)  # one row each
