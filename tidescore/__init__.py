"""Batch-scoring data work on Spark: build, score, check, join, audit, store."""
