"""Queries and DuckDB SQL of the training-data operators, gathered from their modules."""

from __future__ import annotations

from axonflow.llm import bpe, chat, exact_dedup, fim, hamming, html_extract, line_dedup, minhash, packing, repair, secrets, toxicity, warc

MODULES = (warc, hamming, line_dedup, secrets, bpe, packing, minhash, chat, toxicity, exact_dedup, repair, html_extract, fim)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
