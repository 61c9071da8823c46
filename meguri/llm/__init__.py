"""Operators for preparing training data.

Self-contained: the rest of the library works without this folder.
"""
