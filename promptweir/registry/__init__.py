"""Registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from promptweir.registry import classification, evaluation, lexicon, pairing, prompts, streams, verdicts

MODULES = (pairing, lexicon, prompts, classification, verdicts, evaluation, streams)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
