"""Questloom: guarded SQL and batch semantic retrieval over business records, on Spark.

Every operator takes and returns DataFrames and works on whole tables of
questions and records at once.  Models (embedder, scorer, language model) are
functions supplied by the caller.
"""
