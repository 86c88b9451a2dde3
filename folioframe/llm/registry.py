"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from folioframe.llm import merkle, negatives
from folioframe.llm.decontaminate import op7_benchmark_decontamination
from folioframe.llm.hmm import op6_hidden_markov
from folioframe.llm.langid import op8_language_id
from folioframe.llm.merkle import op13_merkle_manifest
from folioframe.llm.negatives import op12_hard_negatives
from folioframe.llm.packing import op11_packing
from folioframe.llm.pieces import op9_sentencepiece
from folioframe.llm.rules import op2_quality_rules
from folioframe.llm.sharding import op4_feistel_sharding
from folioframe.llm.simhash import op5_simhash_near_dedup
from folioframe.llm.spans import op1_substring_dedup
from folioframe.llm.suffixes import op10_suffix_array_dedup
from folioframe.llm.toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_quality_rules, op3_toxicity, op4_feistel_sharding, op5_simhash_near_dedup,
        op6_hidden_markov, op7_benchmark_decontamination, op8_language_id, op9_sentencepiece, op10_suffix_array_dedup,
        op11_packing, op12_hard_negatives, op13_merkle_manifest,
    )
}

ORACLE_SQL: dict[str, str] = negatives.ORACLE_SQL | merkle.ORACLE_SQL
