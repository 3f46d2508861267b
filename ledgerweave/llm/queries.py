"""The thirteen registered training-data queries and their SQL."""

from __future__ import annotations

from ledgerweave.llm import exact_top_k, fill_in_middle, gam_quality, itq_near_dup, perspective_rotation, piece_sampling, revisit_resolution, sainte_lague_mix, simhash_dedup, spotsigs, token_alignment, training_order, url_rules

_MODULES = (exact_top_k, fill_in_middle, gam_quality, itq_near_dup, perspective_rotation, piece_sampling, revisit_resolution, sainte_lague_mix, simhash_dedup, spotsigs, token_alignment, training_order, url_rules)


def queries() -> dict:
    return {name: getattr(m, name) for m in _MODULES for name in vars(m) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE_SQL for m in _MODULES if hasattr(m, "ORACLE_SQL") for name in queries() if hasattr(m, name)}
