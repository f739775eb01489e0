"""Operators that learn from a DataFrame and the models they leave."""
