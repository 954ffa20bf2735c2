"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from corpusloom.llm import byte_bpe, fingerprints, jaccard_join, language_id, line_dedup, media, mixing, phrases, quality_fm, substring_dedup, token_counts, variants, word_bpe


def queries() -> dict:
    return {
        "op1_quality_fm": quality_fm.op1_quality_fm,
        "op2_language_id": language_id.op2_language_id,
        "op3_suffix_dedup": substring_dedup.op3_suffix_dedup,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_webp_media": media.op5_webp_media,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_source_mix": mixing.op10_source_mix,
        "op11_word_bpe": word_bpe.op11_word_bpe,
        "op12_collocations": phrases.op12_collocations,
        "op13_variants": variants.op13_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": substring_dedup.OP3_SQL, "op6_line_dedup": line_dedup.OP6_SQL, "op9_jaccard_join": jaccard_join.OP9_SQL, "op12_collocations": phrases.OP12_SQL, "op13_variants": variants.OP13_SQL}
