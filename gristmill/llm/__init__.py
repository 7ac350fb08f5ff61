"""Corpus operators for training data.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries if the package is there.
"""
