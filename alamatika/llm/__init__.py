"""Corpus operators: address requests and their logs prepared as training text.

Nothing else in the library imports this subpackage.
"""
