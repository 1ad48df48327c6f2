"""Operators for training data made from conversations and documents.

Optional: nothing outside this subpackage imports it.
"""
