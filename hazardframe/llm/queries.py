"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, lexical, line_dedup, packing, passages, quality, sharding, simhash, token_output, urls, vector_codes

QUERIES = {
    "op1_external_shuffle": sharding.op1_external_shuffle,
    "op2_deficit_packing": packing.op2_deficit_packing,
    "op3_passages": passages.op3_passages,
    "op4_simhash": simhash.op4_simhash,
    "op5_bpe_round_trip": bpe.op5_bpe_round_trip,
    "op6_fourier_quality": quality.op6_fourier_quality,
    "op7_url_trees": urls.op7_url_trees,
    "op8_token_files": token_output.op8_token_files,
    "op9_embedding_links": embedding_dedup.op9_embedding_links,
    "op10_grace_dedup": exact_dedup.op10_grace_dedup,
    "op11_block_max_search": lexical.op11_block_max_search,
    "op12_heap_lloyd": vector_codes.op12_heap_lloyd,
    "op13_line_bitmaps": line_dedup.op13_line_bitmaps,
}
ORACLE_SQL = {"op10_grace_dedup": exact_dedup.OP10_SQL, "op11_block_max_search": lexical.OP11_SQL, "op12_heap_lloyd": vector_codes.OP12_SQL, "op13_line_bitmaps": line_dedup.OP13_SQL}
