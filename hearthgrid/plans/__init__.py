"""Compositions of operators: preparation, recommendation, evaluation."""
