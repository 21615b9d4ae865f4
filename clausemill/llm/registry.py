"""Queries and oracles of the llm subpackage."""

from __future__ import annotations

from . import bpe, decontaminate, fim, fingerprints, html_text, jaccard, langid, quality_net, quality_rules, substring, token_rollups, toxicity, whitening

MODULES = (bpe, decontaminate, quality_rules, html_text, substring, jaccard, langid, toxicity, quality_net, token_rollups, fingerprints, whitening, fim)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}


def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
