"""The corpus queries by name, with SQL where SQL can express them."""

from __future__ import annotations

from huntframe.llm import op1_token_counts as op1
from huntframe.llm import op10_best_fit_packing as op10
from huntframe.llm import op11_spelling_variants as op11
from huntframe.llm import op12_bpe_codec as op12
from huntframe.llm import op13_ranked_search as op13
from huntframe.llm import op2_license_scans as op2
from huntframe.llm import op3_lm_scoring as op3
from huntframe.llm import op4_language_id as op4
from huntframe.llm import op5_source_mixing as op5
from huntframe.llm import op6_url_filters as op6
from huntframe.llm import op7_exact_topk as op7
from huntframe.llm import op8_document_fingerprints as op8
from huntframe.llm import op9_minhash_dedup as op9

MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13)


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
