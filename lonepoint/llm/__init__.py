"""Operators of a training-data pipeline over texts, vectors, pages and conversations."""
