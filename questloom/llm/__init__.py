"""Operators for preparing training text at scale, and the queries that apply them.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
