"""Whole flows composed from operators, and the registered queries."""
