"""The queries opN_*, with SQL where SQL can express them."""

from __future__ import annotations

from . import (
    bpe,
    decontaminate,
    fim,
    fingerprint,
    importance,
    langid,
    minhash,
    mixing,
    pii,
    secrets,
    topk,
    tokencount,
    toxicity,
)

_MODULES = (minhash, secrets, topk, toxicity, mixing, tokencount, bpe, pii, langid, fingerprint, decontaminate, importance, fim)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
