"""The registered queries of this subpackage, and their SQL where it has any."""

from __future__ import annotations

from .decontam import op3_benchmark_decontamination
from .embed_dedup import op10_embedding_near_dedup
from .html_extract import op1_html_extraction
from .language_id import op8_language_id
from .linededup import op6_line_dedup
from .lm_score import op7_ctw_scoring
from .ngram_join import op2_ngram_jaccard_join
from .packing import op4_best_fit_packing
from .quality import op9_quality_classifier
from .sharding import OP5_SQL, op5_extendible_sharding
from .spelling import OP11_SQL, op11_spelling_variants
from .token_align import op12_token_alignment
from .url_filter import OP13_SQL, op13_url_filter

QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_best_fit_packing, op5_extendible_sharding,
    op6_line_dedup, op7_ctw_scoring, op8_language_id, op9_quality_classifier, op10_embedding_near_dedup,
    op11_spelling_variants, op12_token_alignment, op13_url_filter)}

SQL = {"op5_extendible_sharding": OP5_SQL, "op11_spelling_variants": OP11_SQL, "op13_url_filter": OP13_SQL}
