"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from quernel.llm import chat, embed_dup, langid, line_dedup, mixing, near_dup, pii, quality, repair, topk, whitening
from quernel.llm.bpe import op3_bpe
from quernel.llm.token_count import op5_token_counts

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_pii": pii.op2_pii,
    "op3_bpe": op3_bpe,
    "op4_chat": chat.op4_chat,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": mixing.op6_mixing,
    "op7_minhash_dedup": near_dup.op7_minhash_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_embedding_dedup": embed_dup.op9_embedding_dedup,
    "op10_langid": langid.op10_langid,
    "op11_repair": repair.op11_repair,
    "op12_whitening": whitening.op12_whitening,
    "op13_quality": quality.op13_quality,
}
SQL: dict[str, str] = {
    "op1_topk": topk.SQL,
    "op4_chat": chat.SQL,
    "op6_mixing": mixing.SQL,
    "op7_minhash_dedup": near_dup.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op9_embedding_dedup": embed_dup.SQL,
    "op11_repair": repair.SQL,
    "op13_quality": quality.SQL,
}
