"""Queries of the training-data operators."""

from __future__ import annotations

from . import decontaminate, hard_negatives, mixing
from .best_fit_packing import op12_best_fit_packing
from .decontaminate import op9_decontaminate
from .embedding_dedup import op3_embedding_dedup
from .hard_negatives import op11_hard_negatives
from .lm_scoring import op8_lm_scoring
from .mixing import op1_mixing
from .ngram_jaccard import op2_ngram_jaccard
from .periodic_runs import op13_periodic_runs
from .quality_crf import op6_quality_crf
from .secret_scan import op4_secret_scan
from .substring_dedup import op10_substring_dedup
from .token_counts import op7_token_counts
from .token_output import op5_token_output

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_token_output": op5_token_output,
    "op6_quality_crf": op6_quality_crf,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontaminate": op9_decontaminate,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.oracle(),
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
}
