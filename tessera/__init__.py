"""Spark operators over account-level asset portfolios."""
