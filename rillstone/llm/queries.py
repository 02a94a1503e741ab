"""The queries that the driver runs, and SQL for those that SQL can express."""

from __future__ import annotations

from . import oracles
from .classifier import op9_quality_classifier
from .langid import op6_language_id
from .mixing import op4_source_mixing
from .orderhash import op1_order_minhash
from .packing import op2_best_fit_packing
from .pii import op8_pii_surrogates
from .quality import op10_quality_rules
from .simhash import op7_simhash
from .suffix import op3_suffix_dedup
from .tokenfile import op5_token_file

QUERIES = {"op1_order_minhash": op1_order_minhash, "op2_best_fit_packing": op2_best_fit_packing, "op3_suffix_dedup": op3_suffix_dedup, "op4_source_mixing": op4_source_mixing, "op5_token_file": op5_token_file, "op6_language_id": op6_language_id, "op7_simhash": op7_simhash, "op8_pii_surrogates": op8_pii_surrogates, "op9_quality_classifier": op9_quality_classifier, "op10_quality_rules": op10_quality_rules}
ORACLE_SQL: dict[str, str] = {"op3_suffix_dedup": oracles.SUFFIX_DEDUP, "op10_quality_rules": oracles.QUALITY_RULES}
