"""Queries and oracle SQL of this subpackage, for the registry at the repository's top."""

from . import decontamination, jaccard_join, nearest, oracles, packing, pii, quality, sharding, spelling, substring_dedup, token_counts, token_files, toxicity, whitening

MODULES = (pii, sharding, decontamination, substring_dedup, nearest, packing, toxicity, jaccard_join, token_counts, token_files, spelling, whitening, quality)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {"op2_jump_shards": oracles.OP2, "op4_debruijn_dedup": oracles.OP4, "op8_jaccard_join": oracles.OP8, "op11_trie_spelling": oracles.OP11, "op13_quality_ledger": oracles.OP13}
