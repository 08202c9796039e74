"""Registry of this folder's queries and their DuckDB SQL."""

from __future__ import annotations

from . import chat, collocation, decontaminate, exact, mixing, pii, secrets, simhash, substring, suffix, toxicity, trie, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii.op3_pii,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_suffix_dedup": suffix.op6_suffix_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_chat": chat.op9_chat,
    "op10_secrets": secrets.op10_secrets,
    "op11_collocations": collocation.op11_collocations,
    "op12_warc": warc.op12_warc,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLES = {
    "op1_mixing": mixing.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op8_exact_dedup": exact.SQL,
    "op11_collocations": collocation.SQL,
    "op12_warc": warc.SQL,
    "op13_prefix_trie": trie.SQL,
}
