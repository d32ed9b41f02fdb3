"""Operators for preparing large-language-model training data.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries only when it can be imported.
"""
