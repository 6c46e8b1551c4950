"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from brassloom.llm import op3_linededup, op4_chat, op6_mix, op7_topk, op11_ranked, op12_hashtree, op13_variants
from brassloom.llm.op1_langid import op1_langid
from brassloom.llm.op2_merkle import op2_merkle
from brassloom.llm.op5_html import op5_html
from brassloom.llm.op8_jaccard import op8_jaccard
from brassloom.llm.op9_quality import op9_quality
from brassloom.llm.op10_bpe import op10_bpe

QUERIES = {
    "op1_langid": op1_langid,
    "op2_merkle": op2_merkle,
    "op3_linededup": op3_linededup.op3_linededup,
    "op4_chat": op4_chat.op4_chat,
    "op5_html": op5_html,
    "op6_mix": op6_mix.op6_mix,
    "op7_topk": op7_topk.op7_topk,
    "op8_jaccard": op8_jaccard,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_ranked": op11_ranked.op11_ranked,
    "op12_hashtree": op12_hashtree.op12_hashtree,
    "op13_variants": op13_variants.op13_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op3_linededup": op3_linededup.SQL,
    "op4_chat": op4_chat.SQL,
    "op6_mix": op6_mix.SQL,
    "op7_topk": op7_topk.SQL,
    "op11_ranked": op11_ranked.SQL,
    "op12_hashtree": op12_hashtree.SQL,
    "op13_variants": op13_variants.SQL,
}
