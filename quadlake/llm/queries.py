"""The corpus operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from quadlake.llm import decontam, exact_dedup, lang_id, mixing, ngram_join, pii, quality, sharding, toxicity, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1,
    "op2_warc": warc.op2,
    "op3_decontamination": decontam.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_toxicity": toxicity.op5,
    "op6_quality": quality.op6,
    "op7_language_id": lang_id.op7,
    "op8_sharding": sharding.op8,
    "op9_mixing": mixing.op9,
    "op10_pii": pii.op10,
}
SQL = {
    "op2_warc": warc.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
