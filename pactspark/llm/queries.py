"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pactspark.llm import ann, bpe, langid, line_dedup, media, near_dup, packing, secrets, token_counts, toxicity

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_media": media.op2_media,
    "op3_ann": ann.op3_ann,
    "op4_langid": langid.op4_langid,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_bpe": bpe.op9_bpe,
    "op10_packing": packing.op10_packing,
}

SQL = {
    "op7_line_dedup": line_dedup.OP7_SQL,
}
