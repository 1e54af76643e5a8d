"""Operators for text that trains language models.

Nothing outside this folder imports it; ``queries`` and ``oracle_sql`` of :mod:`paperlane.llm.registry`
are what the driver's entry adds where the folder exists.
"""
