"""The queries and oracles of all training-data operators."""

from __future__ import annotations

from secflow.llm import bpe, chat, ivfpq, langid, line_dedup, merkle, minhash, mixing, quality, substring, token_shards, variants, webp

MODULES = [bpe, chat, ivfpq, langid, line_dedup, merkle, minhash, mixing, quality, substring, token_shards, variants, webp]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict:
    return {name: q for m in MODULES for name, q in m.ORACLES.items()}
