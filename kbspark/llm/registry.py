"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, classifier, licenses, media, mixing, ngram_join, packing, pii, quality, repair, simhash, tokens
from .common import table

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_mix_sources": lambda s, d: mixing.query(docs(s, d)),
        "op2_media_columns": lambda s, d: media.query(docs(s, d)),
        "op3_quality_rules": lambda s, d: quality.query(docs(s, d), table(s, d, "labels")),
        "op4_license_scan": lambda s, d: licenses.query(docs(s, d)),
        "op5_quality_classifier": lambda s, d: classifier.query(docs(s, d), table(s, d, "labels")),
        "op6_simhash_groups": lambda s, d: simhash.query(docs(s, d)),
        "op7_chat_format": lambda s, d: chat.query(s, table(s, d, "conversations")),
        "op8_pack_sequences": lambda s, d: packing.query(docs(s, d), tokenizer_path()),
        "op9_token_files": lambda s, d: tokens.query(docs(s, d), tokenizer_path()),
        "op10_personal_data": lambda s, d: pii.query(docs(s, d)),
        "op11_ngram_join": lambda s, d: ngram_join.query(docs(s, d)),
        "op12_align_tokenizers": lambda s, d: alignment.query(docs(s, d), tokenizer_path(), tokenizer_path(PIECES)),
        "op13_repair_turns": lambda s, d: repair.query(table(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op7_chat_format": chat.SQL}
