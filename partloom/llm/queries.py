"""Registry of this subpackage's queries and SQL."""

from __future__ import annotations

from . import audio, decontam, divergence, fim, jaccard, packing, pii, quality, sharding, suffix, tokens, toxicity, urls

QUERIES = {
    "op1_quality": quality.query,
    "op2_token_counts": tokens.query,
    "op3_sharding": sharding.query,
    "op4_packing": packing.query,
    "op5_pii": pii.query,
    "op6_audio": audio.query,
    "op7_suffix_dedup": suffix.query,
    "op8_decontamination": decontam.query,
    "op9_toxicity": toxicity.query,
    "op10_jaccard_join": jaccard.query,
    "op11_source_divergence": divergence.query,
    "op12_fill_in_middle": fim.query,
    "op13_url_filter": urls.query,
}
ORACLES: dict[str, str] = {
    "op8_decontamination": decontam.SQL,
    "op10_jaccard_join": jaccard.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_fill_in_middle": fim.SQL,
    "op13_url_filter": urls.SQL,
}
