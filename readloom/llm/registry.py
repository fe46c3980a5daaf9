"""The queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from readloom.llm import chat, jaccard, licenses, lines, mixing, negatives, quality, ranking, secrets, sentencepieces, suffixes, tokenfiles, topk

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_topk_search": topk.op3_topk_search,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_chat_format": chat.op5_chat_format,
    "op6_mixing": mixing.op6_mixing,
    "op7_sentencepiece": sentencepieces.op7_sentencepiece,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_ranked_search": ranking.op11_ranked_search,
    "op12_token_files": tokenfiles.op12_token_files,
    "op13_hard_negatives": negatives.op13_hard_negatives,
    # Those parts of op6 and op9 that SQL can express.
    "mixing_weights": mixing.mixing_weights,
    "license_base": licenses.license_base,
}
ORACLES = {"op1_ngram_jaccard": jaccard.OP1_SQL, "op3_topk_search": topk.OP3_SQL, "op4_quality_rules": quality.OP4_SQL, "op5_chat_format": chat.OP5_SQL, "op10_line_dedup": lines.OP10_SQL, "op11_ranked_search": ranking.OP11_SQL, "op13_hard_negatives": negatives.OP13_SQL, "mixing_weights": mixing.WEIGHTS_SQL, "license_base": licenses.BASE_SQL}
