"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm.lm_score import op3_lm_score
from tessera.llm.matroska import op1_matroska
from tessera.llm.mixture import OP4_SQL, op4_mixture
from tessera.llm.packing import op6_packing
from tessera.llm.pii import OP5_SQL, op5_pii
from tessera.llm.quality import op7_quality
from tessera.llm.secrets_scan import OP9_SQL, op9_secrets
from tessera.llm.simhash import op8_simhash
from tessera.llm.toxicity import op2_toxicity
from tessera.llm.warc_merkle import OP10_SQL, op10_fixity

OPERATORS = (
    op1_matroska, op2_toxicity, op3_lm_score, op4_mixture, op5_pii,
    op6_packing, op7_quality, op8_simhash, op9_secrets, op10_fixity,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixture": OP4_SQL, "op5_pii": OP5_SQL, "op9_secrets": OP9_SQL, "op10_fixity": OP10_SQL}
