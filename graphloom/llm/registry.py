"""Queries of the training-data operators and their SQL."""

from . import byte_bpe, chat_formatting, decontamination, line_dedup, near_dedup, quality_classifier, quality_rules, sharding, token_counts, token_files

_MODULES = (token_counts, quality_rules, byte_bpe, near_dedup, decontamination, quality_classifier, sharding, chat_formatting, token_files, line_dedup)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
