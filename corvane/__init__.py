"""Corvane: a Spark-first engine for evidence tables and corpus preparation."""
