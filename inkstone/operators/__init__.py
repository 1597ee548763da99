"""Relational and text operators, DataFrame to DataFrame."""
