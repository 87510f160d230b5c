"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, embedding_dedup, html_extract, langid, lm_score, mixing, pii, preferences, simhash, token_counts


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            lm_score.op1_lm_score,
            decontam.op2_decontaminate,
            pii.op3_pii,
            langid.op4_langid,
            embedding_dedup.op5_embedding_dedup,
            preferences.op6_preference_format,
            token_counts.op7_token_count,
            simhash.op8_simhash_dedup,
            mixing.op9_mix,
            html_extract.op10_html_extract,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_preference_format": preferences.OP6_SQL, "op9_mix": mixing.OP9_SQL}
