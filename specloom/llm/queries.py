"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from specloom.llm import checks
from specloom.llm.iblt import op2_iblt
from specloom.llm.language import op3_language
from specloom.llm.lattice import NEAR_PAIRS_SQL, lattice_near_pairs, op9_lattice
from specloom.llm.lattice import ORACLE_SQL as LATTICE_SQL
from specloom.llm.mixing import mixing_overlap, op4_mixing
from specloom.llm.ngram import op1_deleted_interpolation
from specloom.llm.pieces import op5_sentencepiece
from specloom.llm.pii import op10_bootstrap
from specloom.llm.repeats import op6_longest_previous_factor
from specloom.llm.simhash import op7_simhash
from specloom.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_iblt": op2_iblt,
    "op3_language": op3_language,
    "op4_mixing": op4_mixing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_longest_previous_factor": op6_longest_previous_factor,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_lattice": op9_lattice,
    "op10_bootstrap": op10_bootstrap,
    "mixing_overlap": mixing_overlap,
    "lattice_near_pairs": lattice_near_pairs,
    **checks.QUERIES,
}

ORACLE_SQL = {"op9_lattice": LATTICE_SQL, "lattice_near_pairs": NEAR_PAIRS_SQL, **checks.ORACLE_SQL}
