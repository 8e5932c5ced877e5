"""Queries and SQL of this package, by name."""

from __future__ import annotations

from . import ann, bpe, dialogue, fingerprints, jaccard_join, mixing, sanitisation, sharding, suffix_dedup, token_counts, toxicity, warc, whitening

MODULES = (fingerprints, bpe, ann, token_counts, sharding, toxicity, jaccard_join, suffix_dedup, warc, mixing, dialogue, sanitisation, whitening)


def queries() -> dict:
    return {k: getattr(m, k) for m in MODULES for k in sorted(vars(m)) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
