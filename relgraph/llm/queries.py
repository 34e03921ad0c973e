"""The queries of this subpackage and their DuckDB forms, for __spark_entry__.py."""

from __future__ import annotations

from . import ann, katz, minhash, mixing, packing, quality, quotes, sharding, simhash, url_filter

QUERIES = {
    "op1_url_language_model": url_filter.op1_url_language_model,
    "op2_simhash": simhash.op2_simhash,
    "op3_katz": katz.op3_katz,
    "op4_soft_mixing": mixing.op4_soft_mixing,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_minhash": minhash.op6_minhash,
    "op7_ivf_pq": ann.op7_ivf_pq,
    "op9_attention_quality": quality.op9_attention_quality,
    "op8_quotation_linking": quotes.op8_quotation_linking,
    "op10_two_pass_shuffle": sharding.op10_two_pass_shuffle,
}

ORACLE_SQL = {
    "op1_url_language_model": url_filter.OP1_SQL,
    "op8_quotation_linking": quotes.OP8_SQL,
}
