"""Operators for preparing language-model training data.

Ten operators, one module each, plus ``queries`` (what the driver registers). Nothing outside this
subpackage imports it.
"""
