"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from .decontamination import op3_decontamination
from .exact_dedup import op5_exact_dedup
from .language_id import op10_language_id
from .lm_scoring import op7_lm_scoring
from .minhash_dedup import op4_minhash_dedup
from .oracles import ORACLES
from .packing import op1_best_fit_packing
from .quality import op8_quality_classifier
from .secret_scan import op6_secret_scan
from .sharding import op9_sharding
from .token_output import op2_token_output

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_output": op2_token_output,
    "op3_decontamination": op3_decontamination,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
}
