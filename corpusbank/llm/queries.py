"""Registered queries of the subpackage, one per operator, and their SQL twins."""

from corpusbank.llm import (
    bpe, compression_toxicity, conversation_repair, hamming_dedup, hnsw, host_reputation,
    html_main, merkle_manifest, pii_weak, quality_fm, rans, syncmers, systematic_mix,
)

QUERIES = {
    "op1_hnsw_neighbours": hnsw.op1_hnsw_neighbours,
    "op2_bpe_encode_decode": bpe.op2_bpe_encode_decode,
    "op3_quality_fm": quality_fm.op3_quality_fm,
    "op4_host_reputation": host_reputation.op4_host_reputation,
    "op5_closed_syncmers": syncmers.op5_closed_syncmers,
    "op6_rans_token_files": rans.op6_rans_token_files,
    "op7_hamming_dedup": hamming_dedup.op7_hamming_dedup,
    "op8_systematic_mix": systematic_mix.op8_systematic_mix,
    "op9_compression_toxicity": compression_toxicity.op9_compression_toxicity,
    "op10_pii_weak_supervision": pii_weak.op10_pii_weak_supervision,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_html_main_text": html_main.op13_html_main_text,
}
SQL = {
    "op4_host_reputation": host_reputation.SQL,
    "op8_systematic_mix": systematic_mix.SQL,
}
