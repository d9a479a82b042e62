"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, audio, bpe, chat, decontaminate, html_text, language, ngram_join, sharding, sort_means, token_counts, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_redirect_equivalence": url_filter.op1_redirect_equivalence,
    "op2_language_by_compression": language.op2_language_by_compression,
    "op3_audio_features": audio.op3_audio_features,
    "op4_two_tier_token_count": token_counts.op4_two_tier_token_count,
    "op5_cgk_decontamination": decontaminate.op5_cgk_decontamination,
    "op6_bayes_ngram_join": ngram_join.op6_bayes_ngram_join,
    "op7_wrapper_extraction": html_text.op7_wrapper_extraction,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op9_warc_round_trip": warc.op9_warc_round_trip,
    "op10_snapshot_collapse": chat.op10_snapshot_collapse,
    "op11_sort_means": sort_means.op11_sort_means,
    "op12_byte_owner_alignment": align.op12_byte_owner_alignment,
    "op13_jump_hash_shards": sharding.op13_jump_hash_shards,
}

ORACLES: dict[str, str] = {
    "op1_redirect_equivalence": url_filter.ORACLE,
    "op6_bayes_ngram_join": ngram_join.ORACLE,
    "op9_warc_round_trip": warc.ORACLE,
    "op10_snapshot_collapse": chat.ORACLE,
    "op11_sort_means": sort_means.ORACLE,
    "op13_jump_hash_shards": sharding.ORACLE,
}
