"""All queries of this subpackage: ``QUERIES`` and ``ORACLE`` of its modules."""

from __future__ import annotations

from helixlake.llm import exact_dedup, html_text, jaccard_join, line_dedup, media, merkle, mixing, packing, quality, secret_scan, token_counts, token_files, vector_codes

MODULES = (packing, exact_dedup, mixing, token_files, quality, media, line_dedup, secret_scan, html_text, jaccard_join, merkle, vector_codes, token_counts)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLE.items()}
