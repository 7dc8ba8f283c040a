"""Queries of this subpackage, for ``__spark_entry__``."""

from .ann import op11_ann
from .bpe import op6_bpe
from .decontaminate import op2_decontaminate
from .language_id import op8_language_id
from .licenses import ORACLE as OP1_ORACLE
from .licenses import op1_license_scan
from .lm_score import op10_lm_score
from .near_dup import ORACLE as OP5_ORACLE
from .near_dup import op5_near_dup
from .quality import op9_quality_rules
from .ranked_search import ORACLE as OP13_ORACLE
from .ranked_search import op13_ranked_search
from .sharding import op4_sharding
from .spelling import op12_spelling_groups
from .token_counts import op7_token_counts
from .token_store import op3_token_store

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_store": op3_token_store,
    "op4_sharding": op4_sharding,
    "op5_near_dup": op5_near_dup,
    "op6_bpe": op6_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_score": op10_lm_score,
    "op11_ann": op11_ann,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": OP1_ORACLE,
    "op5_near_dup": OP5_ORACLE,
    "op13_ranked_search": OP13_ORACLE,
}
