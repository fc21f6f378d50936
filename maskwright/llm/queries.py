"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op10_decontamination
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .html_text import op9_html_text
from .jaccard_join import OP5_SQL, op5_jaccard_join
from .line_dedup import OP4_SQL, op4_line_dedup
from .ngram_lm import op6_ngram_lm
from .packing import op7_best_fit_packing
from .secret_scan import OP2_SQL, op2_secret_scan
from .suffix_dedup import OP11_SQL, op11_suffix_dedup
from .token_counts import op3_token_counts
from .toxicity import op1_toxicity
from .whitening import op13_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_ngram_lm": op6_ngram_lm,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_html_text": op9_html_text,
    "op10_decontamination": op10_decontamination,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}
SQL = {
    "op2_secret_scan": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_suffix_dedup": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
