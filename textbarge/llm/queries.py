"""The operators' queries over the driver tables, and the SQL that states their results."""

from __future__ import annotations

from .chat import OP3_SQL, op3_chat_formatting
from .colloc import OP13_SQL, op13_phrase_collocations
from .decontam import OP1_SQL, op1_benchmark_decontamination
from .htmltext import op9_html_extraction
from .lm import op6_lm_scoring
from .packing import op2_packing
from .quality import op4_quality_classifier
from .simhash import op7_simhash_near_dedup
from .spelling import op12_spelling_variants
from .tokenfiles import op8_token_files
from .topk import OP10_SQL, op10_exact_top_k
from .toxicity import op5_toxicity
from .urlfilter import op11_url_filters

QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_packing, op3_chat_formatting, op4_quality_classifier, op5_toxicity,
    op6_lm_scoring, op7_simhash_near_dedup, op8_token_files, op9_html_extraction, op10_exact_top_k, op11_url_filters, op12_spelling_variants, op13_phrase_collocations,
)}
ORACLE: dict[str, str] = {"op1_benchmark_decontamination": OP1_SQL, "op3_chat_formatting": OP3_SQL, "op10_exact_top_k": OP10_SQL, "op13_phrase_collocations": OP13_SQL}
