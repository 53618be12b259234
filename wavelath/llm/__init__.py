"""Operators for preparing language-model training data. Nothing else in wavelath imports this."""
