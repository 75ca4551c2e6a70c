"""The queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from .lattice_lm import op7_lattice_lm
from .line_dedup import OP1_SQL, op1_line_dedup
from .line_quality import OP10_SQL, op10_quality_rules
from .mixing import OP6_SQL, op6_mixing
from .neighbours import op8_neighbours
from .packing import op4_packing
from .simhash import op2_simhash
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .toxicity import op5_toxicity
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_lattice_lm": op7_lattice_lm,
    "op8_neighbours": op8_neighbours,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op3_warc": OP3_SQL, "op6_mixing": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL}
