"""Clause retrieval, answer assembly and evaluation as set-based Spark jobs."""
