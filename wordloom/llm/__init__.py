"""Operators that prepare text for language-model training.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
when it can be imported.
"""
