"""Governed-corpus analytics on Spark: DataFrame operators and streaming jobs."""
