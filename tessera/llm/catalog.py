"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from . import ann, annulus, exact_dedup, lattice, minhash, mixing, packing, quality, rules, sharding, toxicity, wavelet, whitening

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_ordinal_quality": quality.op2_ordinal_quality,
    "op3_wavelet_shards": wavelet.op3_wavelet_shards,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_pattern_packing": packing.op5_pattern_packing,
    "op6_boosted_toxicity": toxicity.op6_boosted_toxicity,
    "op7_tiered_shards": sharding.op7_tiered_shards,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_lattice_lm": lattice.op9_lattice_lm,
    "op10_ivf_pq": ann.op10_ivf_pq,
    "op11_annular_codes": annulus.op11_annular_codes,
    "op12_voting_rules": rules.op12_voting_rules,
    "op13_tiled_whitening": whitening.op13_tiled_whitening,
}
ORACLE = {
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_mix_sources": mixing.ORACLE_SQL,
    "op11_annular_codes": annulus.ORACLE_SQL,
    "op12_voting_rules": rules.ORACLE_SQL,
}
