"""Scalar functions on columns: text, mathematics markup, answers, JSON repair."""
