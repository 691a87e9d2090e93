"""Operators for preparing large text, page and audio corpora for training.

Nothing else in the library imports this subpackage.
"""
