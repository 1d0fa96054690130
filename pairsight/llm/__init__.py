"""Operators for preparing training corpora.

Nothing outside this folder imports it; ``queries`` registers what it offers.
"""
