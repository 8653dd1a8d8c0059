"""Registry of the operators' queries and their SQL."""

from __future__ import annotations

from ledgerlens.llm import chat, decontam, html_text, huffman, langid, licenses, merkle, mixing, ngram, nndescent, quality, ranked, simhash

QUERIES = {
    "op1_lm_score": ngram.op1_lm_score,
    "op2_mixing": mixing.op2_mixing,
    "op3_language": langid.op3_language,
    "op4_embeddings": nndescent.op4_embeddings,
    "op5_licenses": licenses.op5_licenses,
    "op6_quality": quality.op6_quality,
    "op7_html_text": html_text.op7_html_text,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_token_binary": huffman.op9_token_binary,
    "op10_simhash": simhash.op10_simhash,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_chat": chat.op12_chat,
    "op13_merkle": merkle.op13_merkle,
}
SQL: dict[str, str] = {"op8_decontamination": decontam.OP8_SQL, "op11_ranked_search": ranked.OP11_SQL, "op12_chat": chat.OP12_SQL, "op13_merkle": merkle.OP13_SQL}
