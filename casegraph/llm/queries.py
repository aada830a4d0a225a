"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from casegraph.llm.decontamination import op5_decontamination
from casegraph.llm.hard_negatives import ORACLE as NEGATIVES_SQL
from casegraph.llm.hard_negatives import op12_hard_negatives
from casegraph.llm.html_extraction import op7_html_extraction
from casegraph.llm.language_id import op4_language_id
from casegraph.llm.media import op3_media_columns
from casegraph.llm.packing import op6_best_fit_packing
from casegraph.llm.quality import op2_quality
from casegraph.llm.sharding import ORACLE as SHARDING_SQL
from casegraph.llm.sharding import op8_sharding
from casegraph.llm.simhash import op1_simhash_dedup
from casegraph.llm.suffix_dedup import op13_suffix_dedup
from casegraph.llm.token_alignment import op11_token_alignment
from casegraph.llm.token_counts import op10_token_counts
from casegraph.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_quality": op2_quality,
    "op3_media_columns": op3_media_columns,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_html_extraction": op7_html_extraction,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLES = {"op8_sharding": SHARDING_SQL, "op12_hard_negatives": NEGATIVES_SQL}
