"""Retrieval and answer-evaluation analytics as Spark DataFrame jobs."""
