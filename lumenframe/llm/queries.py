"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from .fingerprint import op10_fingerprint
from .language import op3_language
from .mix import op7_mix
from .near_text import op4_near_dedup
from .near_vector import op2_near_vectors
from .oracles import ORACLES
from .pack import op5_pack
from .pii import op9_pii
from .quality import op1_quality
from .secrets import op8_secrets
from .token_counts import op6_token_counts

QUERIES = {"op1_quality": op1_quality, "op3_language": op3_language, "op2_near_vectors": op2_near_vectors, "op4_near_dedup": op4_near_dedup, "op5_pack": op5_pack, "op6_token_counts": op6_token_counts, "op7_mix": op7_mix, "op8_secrets": op8_secrets, "op9_pii": op9_pii, "op10_fingerprint": op10_fingerprint}
__all__ = ["ORACLES", "QUERIES"]
