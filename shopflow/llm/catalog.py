"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from shopflow.llm.bpe import op2_bpe
from shopflow.llm.byte_piece import op12_byte_piece
from shopflow.llm.collocations import OP11_SQL, op11_collocations
from shopflow.llm.embed_pigeonhole import op5_embed_pigeonhole
from shopflow.llm.lang_gru import op3_lang_gru
from shopflow.llm.licenses import op9_licenses
from shopflow.llm.mixing import OP4_SQL, op4_fair_mix
from shopflow.llm.pii import op7_pii
from shopflow.llm.quality_lines import OP10_SQL, op10_quality_lines
from shopflow.llm.simhash_pivots import op6_simhash_pivots
from shopflow.llm.suffix_dedup import op1_suffix_dedup
from shopflow.llm.whitening import op13_whitening
from shopflow.llm.zip_warc import op8_zip_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_bpe": op2_bpe,
    "op3_lang_gru": op3_lang_gru,
    "op4_fair_mix": op4_fair_mix,
    "op5_embed_pigeonhole": op5_embed_pigeonhole,
    "op6_simhash_pivots": op6_simhash_pivots,
    "op7_pii": op7_pii,
    "op8_zip_warc": op8_zip_warc,
    "op9_licenses": op9_licenses,
    "op10_quality_lines": op10_quality_lines,
    "op11_collocations": op11_collocations,
    "op12_byte_piece": op12_byte_piece,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op4_fair_mix": OP4_SQL,
    "op10_quality_lines": OP10_SQL,
    "op11_collocations": OP11_SQL,
}
