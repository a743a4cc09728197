"""The queries and SQL of the text operators."""

from rastrum.llm import bpe, exact_dedup, langid, licenses, line_dedup, mixing, parsing, quality, simhash, url_filter

MODULES = (bpe, langid, parsing, simhash, licenses, quality, exact_dedup, mixing, url_filter, line_dedup)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
