"""Operators for preparing language-model training corpora with Spark.

Nothing else in ``riskframe`` imports this subpackage.
"""
