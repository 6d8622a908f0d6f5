"""Queries and SQL of this subpackage, for the entry module at the repository top."""

from __future__ import annotations

from polyad.llm.bpe import op5_bpe
from polyad.llm.imatch import op1_imatch
from polyad.llm.lattice import op9_lattice
from polyad.llm.licences import op2_licences
from polyad.llm.licences import oracle as op2_sql
from polyad.llm.packing import op8_packing
from polyad.llm.quality import op3_quality
from polyad.llm.simhash import op10_simhash
from polyad.llm.suffix_dedup import op4_suffix_dedup
from polyad.llm.tool_calls import ORACLE as OP6_SQL
from polyad.llm.tool_calls import op6_tool_calls
from polyad.llm.urls import op7_urls

QUERIES = {
    "op1_imatch": op1_imatch,
    "op5_bpe": op5_bpe,
    "op2_licences": op2_licences,
    "op3_quality": op3_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op6_tool_calls": op6_tool_calls,
    "op7_urls": op7_urls,
    "op8_packing": op8_packing,
    "op9_lattice": op9_lattice,
    "op10_simhash": op10_simhash,
}
ORACLES: dict[str, str] = {"op2_licences": op2_sql(), "op6_tool_calls": OP6_SQL}
