"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tokenloom.llm import (
    bpe_codec,
    chat_format,
    exact_dedup,
    license_scan,
    mixing,
    quality_rules,
    shard_store,
    simhash_dedup,
    token_files,
    weak_labels,
)

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_license_scan": license_scan.query,
    "op3_token_files": token_files.query,
    "op4_shard_store": shard_store.query,
    "op5_quality_rules": quality_rules.query,
    "op6_weak_labels": weak_labels.query,
    "op7_bpe_codec": bpe_codec.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_simhash_dedup": simhash_dedup.query,
    "op10_source_mixing": mixing.query,
}

SQL = {
    "op1_chat_format": chat_format.sql(),
    "op4_shard_store": shard_store.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op10_source_mixing": mixing.SQL,
}
