"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthstat.llm import (
    bpe, decontam, digests, langid, lines, minhash, pii, quality, toxicity, trie, urls, vectors, whitening
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_embedding_dedup": vectors.op2_embedding_dedup,
        "op3_minhash_dedup": minhash.op3_minhash_dedup,
        "op4_pii": pii.op4_pii,
        "op5_decontaminate": decontam.op5_decontaminate,
        "op6_url_filter": urls.op6_url_filter,
        "op7_quality": quality.op7_quality,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_whitening": whitening.op11_whitening,
        "op12_fingerprints": digests.op12_fingerprints,
        "op13_prefix_trie": trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": vectors.OP2_SQL,
        "op3_minhash_dedup": minhash.OP3_SQL,
        "op5_decontaminate": decontam.OP5_SQL,
        "op6_url_filter": urls.OP6_SQL,
        "op8_line_dedup": lines.OP8_SQL,
        "op13_prefix_trie": trie.OP13_SQL,
    }
