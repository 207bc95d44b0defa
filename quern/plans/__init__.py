"""Whole plans: the batch search engine and the registered queries."""
