"""Peptide arithmetic and notation as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic residue masses, water, proton and the two modifications.
RESIDUE_MASS = {
    "A": 71.037113805, "R": 156.101111050, "N": 114.042927470, "D": 115.026943065, "C": 103.009184505, "E": 129.042593135, "Q": 128.058577540,
    "G": 57.021463735, "H": 137.058911875, "I": 113.084064015, "L": 113.084064015, "K": 128.094963050, "M": 131.040484645, "F": 147.068413945,
    "P": 97.052763875, "S": 87.032028435, "T": 101.047678505, "W": 186.079312980, "Y": 163.063328575, "V": 99.068413945, "U": 150.953633405,
}
WATER, PROTON, CARBAMIDOMETHYL, OXIDATION = 18.010564684, 1.007276466621, 57.021463735, 15.994914620
# How modified residues are written.
C_FORMS = {"unimod": "C(UniMod:4)", "bracket-unimod": "C[UNIMOD:4]", "name": "C[Carbamidomethyl]", "plain": "C"}
M_FORMS = {"unimod": "M(UniMod:35)", "bracket-unimod": "M[UNIMOD:35]", "name": "M[Oxidation]", "plain": "M"}
ANNOTATION = r"([byBY])\s*(\d+)(?:[^0-9]+(\d+))?"
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"


def _form(forms: Mapping[str, str], name: str, what: str) -> str:
    if name not in forms:
        raise ValueError(f"{what} must be one of {', '.join(forms)}")
    return forms[name]


def letters(sequence: Column) -> Column:
    return F.filter(F.split(sequence, ""), lambda c: c != "")


def _table() -> Column:
    return F.create_map(*[F.lit(x) for kv in RESIDUE_MASS.items() for x in kv])


def residue_masses(sequence: Column, carbamidomethyl: bool | Column = True, oxidised: Column | None = None) -> Column:
    """array<double>; ``oxidised`` holds 0-based positions. An unknown residue is null."""
    fixed = F.lit(carbamidomethyl) if isinstance(carbamidomethyl, bool) else carbamidomethyl

    def mass(c: Column, i: Column) -> Column:
        m = F.element_at(_table(), c) + F.when((c == "C") & fixed, CARBAMIDOMETHYL).otherwise(0.0)
        return m if oxidised is None else m + F.when((c == "M") & F.array_contains(oxidised, i), OXIDATION).otherwise(0.0)

    return F.transform(letters(sequence), mass)


def neutral_mass(masses: Column) -> Column:
    return F.aggregate(masses, F.lit(WATER), lambda a, m: a + m)


def running(masses: Column, start: float = 0.0) -> Column:
    """array<double>: ``start`` and the first 0, 1, 2, ... masses; NaN from an unknown mass on."""
    return F.aggregate(masses, F.array(F.lit(start)), lambda a, m: F.concat(a, F.array(F.element_at(a, -1) + F.coalesce(m, F.lit(float("nan"))))))


def mz(mass: Column, charge: Column) -> Column:
    return (mass + charge * PROTON) / charge


def fragment_mz(masses: Column, ion: Column, number: Column, charge: Column) -> Column:
    """b: the first residues; y: water and the last ones; null outside 1 <= number < length or for other ions."""
    add = lambda part, start: F.aggregate(part, F.lit(start), lambda a, m: a + m)
    n = F.size(masses)
    mass = F.when(ion == "b", add(F.slice(masses, 1, number), 0.0)).when(ion == "y", add(F.slice(masses, n - number + 1, number), WATER))
    return F.when((number >= 1) & (number < n) & (charge >= 1), mz(mass, charge))


def modified_peptide(sequence: Column, carbamidomethyl: bool = True, c_form: str = "unimod", oxidised: Column | None = None, m_form: str = "unimod") -> Column:
    c, m = _form(C_FORMS, c_form, "c_mod_format"), _form(M_FORMS, m_form, "m_mod_format")
    if oxidised is None:
        return F.replace(sequence, F.lit("C"), F.lit(c)) if carbamidomethyl else sequence
    write = lambda x, i: F.when((x == "C") & F.lit(carbamidomethyl), c).when((x == "M") & F.array_contains(oxidised, i), m).otherwise(x)
    return F.array_join(F.transform(letters(sequence), write), "")


def parse_positions(text: Column) -> Column:
    """'3;7' to [2, 6]; null, '', 'nan', 'none' and '-' to []; '3.0' counts as 3."""
    none = F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("", "nan", "none", "-")
    parts = F.filter(F.split(text, ";"), lambda x: F.trim(x) != "")
    return F.when(none, F.array().cast("array<int>")).otherwise(F.transform(parts, lambda x: F.trim(x).cast("double").cast("int") - 1))


def format_positions(positions: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(positions, lambda x: x + 1)), ";")


def annotation(text: Column, default_charge: int = 1, strict: bool = False) -> Column:
    """struct(ion, number, charge) of 'y7', 'y7^2', 'b3/1'; null if there is none. ``strict`` reads a charge after ^, + or / only."""
    pattern = r"([byBY])\s*(\d+)(?:[\^+/](\d+))?" if strict else ANNOTATION
    part = lambda i: F.regexp_extract(text, pattern, i)
    charge = F.when(part(3) == "", F.lit(default_charge)).otherwise(part(3).try_cast("int"))
    return F.when(part(1) != "", F.struct(F.lower(part(1)).alias("ion"), part(2).try_cast("int").alias("number"), charge.alias("charge")))


def noise(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts' text only: the first eight hex digits of their MD5 over 2**32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


# What names a modification inside brackets, as exact ids, names or mass shifts.
TOKENS = {"Carbamidomethyl": r"(unimod:4|carbamidomethyl|\+?57([.,]021\d*)?)", "Oxidation": r"(unimod:35|oxidation|\+?15[.,]99\d*)"}


def rt_input(modified: Column, stripped: Column | None = None, carbamidomethyl: bool | Column = True) -> Column:
    """struct(seq, modifications): residues, and 'position|name' pairs by position, then name. Groups before the first residue are skipped."""
    body = F.regexp_replace(modified, r"^(?:[(\[][^)\]]*[)\]])+", "")
    pattern = F.lit(r"([A-Z])((?:[(\[][^)\]]*[)\]])*)")
    residues, groups = F.regexp_extract_all(body, pattern, F.lit(1)), F.regexp_extract_all(body, pattern, F.lit(2))
    seq = F.array_join(residues, "") if stripped is None else F.coalesce(F.when(F.trim(stripped) != "", F.upper(F.trim(stripped))), F.array_join(residues, ""))
    fixed = F.lit(carbamidomethyl) if isinstance(carbamidomethyl, bool) else carbamidomethyl

    def named(name: str, token: str) -> Column:
        marked = lambda g, i: F.when(F.lower(g).rlike(r"[(\[]" + token + r"[)\]]"), F.struct((i + 1).alias("at"), F.lit(name).alias("name")))
        return F.filter(F.transform(groups, marked), lambda x: x.isNotNull())

    found = [named(name, token) for name, token in TOKENS.items()]
    plain = F.filter(F.transform(letters(seq), lambda c, i: F.when((c == "C") & fixed, F.struct((i + 1).alias("at"), F.lit("Carbamidomethyl").alias("name")))), lambda x: x.isNotNull())
    every = F.array_sort(F.array_distinct(reduce(F.concat, [*found, plain])))
    return F.struct(seq.alias("seq"), F.array_join(F.transform(every, lambda x: F.concat_ws("|", x["at"].cast("string"), x["name"])), "|").alias("modifications"))


def mock_rt(seq: Column, modifications: Column) -> Column:
    parts = F.size(F.split(modifications, "[|]"))
    n = F.when(F.coalesce(modifications, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(parts / 2)))
    return 0.5 * F.length(seq) + 0.25 * n


def parse_charges(text: str) -> list[int]:
    charges = sorted({int(x) for x in text.split(",") if x.strip()})
    if not charges or charges[0] < 1:
        raise ValueError("charges must be positive integers")
    return charges


def parse_charge_rules(text: str | None) -> dict[int, int]:
    """'4:12,5:16': the least length for a charge."""
    rules: dict[int, int] = {}
    for part in (text or "").split(","):
        if part.strip():
            m = re.fullmatch(r"\s*(\d+)\s*:\s*(\d+)\s*", part)
            if not m or int(m[1]) < 1 or int(m[2]) < 1:
                raise ValueError(f"charge-length rule {part!r} is not like 4:12")
            rules[int(m[1])] = int(m[2])
    return rules
