"""Text privacy analytics on Spark."""

from .functions.checks import card_brand, iban_check, is_abn, is_acn, is_bsb, is_credit_card, is_medicare, is_medicare_enrolment, is_passport, is_tfn, luhn
from .functions.generalise import generalise
from .functions.masking import partial_mask, stable_hash
from .functions.text import aligned, fold, folded_contains, folded_span, normalise, original_span, pinned, total_overlap
from .operators.context import context_findings, rule_counts
from .operators.cohorts import cohort_sizes, release, selectivities
from .operators.intervals import clear_of, meeting
from .operators.lexicon import Lexicon, Term
from .operators.lexicon_table import LexiconTable
from .operators.phrases import find_phrases
from .operators.residual import Disclosure, decide, measure, protect, summarise
from .operators.resolve import resolve
from .operators.risk import assess, filter_by_band, risk_json
from .operators.tagger import Tagger
from .plans.api import audit_json, findings_json, persistable, redact, redact_frame, redact_records, redact_text, roll_up, scan, summarise_texts, summary, with_findings, worst_risk
from .plans.policy import CATEGORIES, Policy, survey_policy

__all__ = [n for n in dir() if not n.startswith("_")]
