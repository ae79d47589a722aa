"""The queries of this subpackage and their SQL."""

import corpus_pipeline

from . import bpe, exact_dedup, language_id, lm_score, mixing, near_dedup, pii, substring_dedup, topk, toxicity

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_language_id": language_id.op2_language_id,
    "op3_mixing": mixing.op3_mixing,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_pii": pii.op7_pii,
    "op8_top_k": topk.op8_top_k,
    "op9_bpe": bpe.op9_bpe,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op3_mixing": mixing.OP3_SQL, "op5_exact_dedup": exact_dedup.OP5_SQL, "op8_top_k": topk.OP8_SQL}
