"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from blockframe.llm import exact_dedup, jaccard_join, langid, mixing, pieces, substring_dedup, suffix_sort, token_files, topk, url_filter

_MODULES = (substring_dedup, exact_dedup, suffix_sort, jaccard_join, pieces, token_files, langid, url_filter, mixing, topk)
QUERIES = {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
