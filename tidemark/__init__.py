"""Interpretable binary classification on PySpark: critical ranges, vote rules, metrics and experiments."""
