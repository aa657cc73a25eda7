"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import decontamination, fingerprints, hardnegatives, mixing, passages, pseudonyms, quality, rules, sharding, suffixes, topk, toxicity, turntrie

QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_extendible_shards,
        decontamination.op2_template_leaks,
        passages.op3_compact_windows,
        suffixes.op4_radix_suffixes,
        pseudonyms.op5_feistel_pseudonyms,
        toxicity.op6_toxic_segments,
        fingerprints.op7_simhash_components,
        quality.op8_site_posteriors,
        mixing.op9_curriculum_mix,
        topk.op10_norm_buckets,
        rules.op11_rule_table,
        hardnegatives.op12_packed_negatives,
        turntrie.op13_turn_trie,
    )
}

ORACLES = {"op1_extendible_shards": sharding.oracle(), "op9_curriculum_mix": mixing.oracle(), "op10_norm_buckets": topk.oracle(), "op11_rule_table": rules.oracle(), "op12_packed_negatives": hardnegatives.oracle(), "op13_turn_trie": turntrie.oracle()}
