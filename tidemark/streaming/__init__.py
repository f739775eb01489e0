"""Rectifying and scoring on streams."""
