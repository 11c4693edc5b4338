"""The queries of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from .decontaminate import op10_decontaminate
from .line_dedup import OP7_SQL, op7_line_dedup
from .lm_score import op2_lm_score
from .mixing import OP9_SQL, op9_mixing
from .near_dedup import op6_near_dedup
from .quality_rules import op4_quality_rules
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .toxicity import op3_toxicity
from .warc import op5_warc

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_lm_score, op3_toxicity, op4_quality_rules, op5_warc, op6_near_dedup, op7_line_dedup, op8_suffix_dedup, op9_mixing, op10_decontaminate)}

ORACLE = {"op7_line_dedup": OP7_SQL, "op9_mixing": OP9_SQL}
