"""Operators of a training-data pipeline over documents, web pages and conversations."""
