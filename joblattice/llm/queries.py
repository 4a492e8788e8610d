"""The registered queries of this package, with their checking SQL where there is one."""

from joblattice.llm import bpe, centroids, line_dedup, main_text, mixing, ngram_join, pii, quality, records, secret_scan, sharding, signatures, topk

QUERIES = {
    "op1_top_k": topk.op1,
    "op2_main_text": main_text.op2,
    "op3_byte_bpe": bpe.op3,
    "op4_personal_data": pii.op4,
    "op5_line_dedup": line_dedup.op5,
    "op6_token_records": records.op6,
    "op7_ngram_join": ngram_join.op7,
    "op8_secret_scan": secret_scan.op8,
    "op9_source_mix": mixing.op9,
    "op10_quality_rules": quality.op10,
    "op11_lexical_rank": signatures.op11,
    "op12_centroids": centroids.op12,
    "op13_interleaved_shards": sharding.op13,
}
ORACLE_SQL = {
    "op1_top_k": topk.OP1_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op11_lexical_rank": signatures.OP11_SQL,
    "op12_centroids": centroids.OP12_SQL,
    "op13_interleaved_shards": sharding.OP13_SQL,
}
