"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import convtrie, decontam, fingerprints, langid, linechunks, merkle, mixing, neardup, pagetext, secrets, sharding, suffixdedup, toxicity

QUERIES = {
    "op1_near_duplicates": neardup.query,
    "op2_decontaminate": decontam.query,
    "op3_line_chunks": linechunks.query,
    "op4_fingerprints": fingerprints.query,
    "op5_language": langid.query,
    "op6_toxicity": toxicity.query,
    "op7_suffix_dedup": suffixdedup.query,
    "op8_secrets": secrets.query,
    "op9_source_mix": mixing.query,
    "op10_shard_splitters": sharding.query,
    "op11_page_text": pagetext.query,
    "op12_conversation_trie": convtrie.query,
    "op13_merkle_manifest": merkle.query,
}
ORACLE_SQL = {
    "op1_near_duplicates": neardup.ORACLE,
    "op2_decontaminate": decontam.ORACLE,
    "op7_suffix_dedup": suffixdedup.ORACLE,
    "op9_source_mix": mixing.ORACLE,
    "op10_shard_splitters": sharding.ORACLE,
    "op12_conversation_trie": convtrie.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
