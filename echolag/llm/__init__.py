"""Operators for preparing language-model training data, their queries and the SQL equal to them."""
