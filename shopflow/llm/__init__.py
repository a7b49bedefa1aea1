"""Operators for preparing training data: ten operators, each with its registered query.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries
when it can be imported.
"""
