"""Whole plans: question answering, evaluation and the query registry."""
