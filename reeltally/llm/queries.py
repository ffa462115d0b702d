"""Importing this module fills the registry."""

import corpus_pipeline
from reeltally.llm import (  # noqa: F401
    bpe,
    centroids,
    chat,
    exact_dedup,
    html_text,
    near_dedup,
    packing,
    pieces,
    repeats,
    resampling,
    sharding,
    top_k,
    toxicity,
)
from reeltally.llm.registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
