"""The queries of the numbered operators, and SQL for those that SQL can express."""

from dealforge.llm.fingerprints import op2_fingerprints
from dealforge.llm.lexical import OP13_SQL, op13_ranked_search
from dealforge.llm.mixing import OP1_SQL, op1_mixing
from dealforge.llm.language import op5_language_id
from dealforge.llm.neardup import op6_minhash_near_dedup
from dealforge.llm.packing import op9_best_fit_packing
from dealforge.llm.pii import OP8_SQL, op8_pii
from dealforge.llm.quality import OP10_SQL, op10_quality_rules
from dealforge.llm.resampling import op11_importance_resampling
from dealforge.llm.secrets import op3_secret_scans
from dealforge.llm.suffixes import op12_suffix_array_dedup
from dealforge.llm.token_counts import op4_token_counts
from dealforge.llm.toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_fingerprints, op3_secret_scans, op4_token_counts, op5_language_id, op6_minhash_near_dedup, op7_toxicity, op8_pii, op9_best_fit_packing, op10_quality_rules, op11_importance_resampling, op12_suffix_array_dedup, op13_ranked_search)
}
ORACLE = {"op1_mixing": OP1_SQL, "op8_pii": OP8_SQL, "op10_quality_rules": OP10_SQL, "op13_ranked_search": OP13_SQL}
