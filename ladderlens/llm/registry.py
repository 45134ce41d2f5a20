"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from ladderlens.llm.audit import OP11_SQL, op11_filter_audit
from ladderlens.llm.chunking import op4_chunk_fingerprints
from ladderlens.llm.flac import op7_flac_media
from ladderlens.llm.langid import op1_language_id
from ladderlens.llm.mixing import OP2_SQL, op2_source_mixing
from ladderlens.llm.packing import op9_packing
from ladderlens.llm.passages import op8_near_passages
from ladderlens.llm.pii import op10_pii
from ladderlens.llm.records import op3_token_records
from ladderlens.llm.simhash import op5_simhash_near_dedup
from ladderlens.llm.suffixes import op6_suffix_dedup
from ladderlens.llm.topk import OP12_SQL, op12_exact_topk
from ladderlens.llm.variants import op13_spelling_variants

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_source_mixing": op2_source_mixing,
    "op3_token_records": op3_token_records,
    "op4_chunk_fingerprints": op4_chunk_fingerprints,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_flac_media": op7_flac_media,
    "op8_near_passages": op8_near_passages,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_filter_audit": op11_filter_audit,
    "op12_exact_topk": op12_exact_topk,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op2_source_mixing": OP2_SQL, "op11_filter_audit": OP11_SQL, "op12_exact_topk": OP12_SQL}
