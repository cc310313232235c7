"""The queries of this subpackage, and SQL for those that have it."""

from . import chat, exact_dedup, langid, lm, media, mixing, near_dedup, packing, pieces, pii, search, token_files, vector_codes

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_pack_sequences": packing.op3_pack_sequences,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_media_columns": media.op5_media_columns,
    "op6_lm_score": lm.op6_lm_score,
    "op7_language_id": langid.op7_language_id,
    "op8_token_files": token_files.op8_token_files,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_chat_format": chat.op10_chat_format,
    "op11_pieces": pieces.op11_pieces,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_search": search.op13_search,
}

ORACLE_SQL = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_search": search.OP13_SQL,
}
