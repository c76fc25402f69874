"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from auralake.llm.cross_entropy import op8_cross_entropy
from auralake.llm.iso_media import op1_iso_media
from auralake.llm.langid import op10_centroid_langid
from auralake.llm.line_runs import OP7_SQL, op7_line_runs
from auralake.llm.packing import op6_vector_packing
from auralake.llm.simhash import op2_vantage_simhash
from auralake.llm.superkmers import op9_superkmers
from auralake.llm.tiling import op5_greedy_tiling
from auralake.llm.url_rules import OP3_SQL, op3_url_rules
from auralake.llm.wordpiece import op4_wordpiece_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_iso_media,
        op2_vantage_simhash,
        op3_url_rules,
        op4_wordpiece_counts,
        op5_greedy_tiling,
        op6_vector_packing,
        op7_line_runs,
        op8_cross_entropy,
        op9_superkmers,
        op10_centroid_langid,
    )
}

ORACLE_SQL = {"op3_url_rules": OP3_SQL, "op7_line_runs": OP7_SQL}
