"""Operators that Spark lacks: folds, samples, fixpoints."""
