"""Tessera: a Spark-first engine for posting analytics, retrieval, ranking and text corpora."""
