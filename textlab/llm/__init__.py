"""Operators for preparing training text at scale.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames; the registered queries are in :mod:`textlab.llm.queries`
and their DuckDB statements in :mod:`textlab.llm.oracle`.
"""
