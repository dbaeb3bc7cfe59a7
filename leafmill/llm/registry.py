"""Queries of the subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from leafmill.llm.divergence import OP13_SQL, op13_source_divergence
from leafmill.llm.first_fit import op12_packing
from leafmill.llm.html_text import op7_html_extraction
from leafmill.llm.line_dedup import op1_line_dedup
from leafmill.llm.mixing import op5_mixing
from leafmill.llm.neighbours import op3_nearest_neighbours
from leafmill.llm.periodic import op11_periodic_runs
from leafmill.llm.pieces import op2_sentencepiece
from leafmill.llm.quality import op9_quality
from leafmill.llm.repeats import op4_suffix_array_dedup
from leafmill.llm.sharding import op6_sharding
from leafmill.llm.simhash_docs import op8_simhash_near_dedup
from leafmill.llm.weighted_prints import op10_fingerprints

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op7_html_extraction": op7_html_extraction,
    "op2_sentencepiece": op2_sentencepiece,
    "op9_quality": op9_quality,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_packing": op12_packing,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {"op13_source_divergence": OP13_SQL}
