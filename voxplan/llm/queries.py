"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import variants
from .alignment import op11_alignment
from .decontam import op5_decontaminate
from .minhash import op7_minhash
from .neighbours import op12_collision_neighbours
from .packing import op8_packing
from .pii import op2_pii
from .quality import op6_quality
from .scoring import op9_context_tree
from .secrets import op4_secrets
from .simhash import op10_simhash
from .suffixes import op3_suffixes
from .urls import op1_url_rules
from .variants import op13_spelling_variants

_ALL = (
    op1_url_rules, op2_pii, op3_suffixes, op4_secrets, op5_decontaminate, op6_quality, op7_minhash, op8_packing, op9_context_tree, op10_simhash,
    op11_alignment, op12_collision_neighbours, op13_spelling_variants,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op13_spelling_variants": variants.SQL}
