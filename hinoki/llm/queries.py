"""The queries of this subpackage, for __spark_entry__.py."""

from . import ann, bpe, conversation, decontaminate, fim, jaccard, lm_score, packing, pii, quality, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_packing": packing.op2_packing,
    "op10_quality": quality.op10_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_bpe": bpe.op4_bpe,
    "op9_lm_score": lm_score.op9_lm_score,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op5_ann": ann.op5_ann,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_url_filter": url_filter.op7_url_filter,
    "op11_conversation_repair": conversation.op11_conversation_repair,
    "op12_pii": pii.op12_pii,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
ORACLES = {"op8_decontaminate": decontaminate.ORACLE, "op7_url_filter": url_filter.ORACLE, "op13_fill_in_middle": fim.ORACLE}
