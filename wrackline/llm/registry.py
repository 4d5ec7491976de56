"""The corpus queries by name."""

from __future__ import annotations

from . import byte_bpe, decontaminate, exact_dedup, language_id, licences, merkle, phrases, secrets, simhash, substring_dedup, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_language_id": language_id.op4_language_id,
        "op5_licences": licences.op5_licences,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_secrets": secrets.op9_secrets,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_phrases": phrases.op11_phrases,
        "op12_merkle": merkle.op12_merkle,
        "op13_warc": warc.op13_warc,
    }


def oracle_sql() -> dict:
    return {
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op10_decontaminate": decontaminate.OP10_SQL,
        "op11_phrases": phrases.OP11_SQL,
        "op12_merkle": merkle.OP12_SQL,
        "op13_warc": warc.OP13_SQL,
    }
