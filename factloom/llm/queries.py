"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from factloom.llm.context_mixing import op5_lm_scoring
from factloom.llm.decontaminate import SQL as OP7_SQL
from factloom.llm.decontaminate import op7_benchmark_decontamination
from factloom.llm.language_id import op4_language_id
from factloom.llm.licenses import op9_license_scan
from factloom.llm.personal_data import op2_personal_data
from factloom.llm.packing import op6_best_fit_packing
from factloom.llm.shard import op10_sharding
from factloom.llm.simhash_dedup import op3_simhash_dedup
from factloom.llm.topk_search import SQL as OP1_SQL
from factloom.llm.topk_search import op1_topk_search
from factloom.llm.toxicity import op8_toxicity

QUERIES = {
    "op5_lm_scoring": op5_lm_scoring,
    "op1_topk_search": op1_topk_search,
    "op2_personal_data": op2_personal_data,
    "op4_language_id": op4_language_id,
    "op8_toxicity": op8_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op9_license_scan": op9_license_scan,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op10_sharding": op10_sharding,
}
ORACLES: dict[str, str] = {
    "op1_topk_search": OP1_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
}
