"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from plumbline.llm import decontaminate, exact_dedup, language_id, license_scan, line_dedup, lm_scoring, mixing, quality, simhash, token_counts

MODULES = (lm_scoring, line_dedup, token_counts, exact_dedup, simhash, quality, license_scan, language_id, mixing, decontaminate)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
