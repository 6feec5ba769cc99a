"""Operators for large-scale training-data preparation.

Ten operators, each in a module of its own, and their registered queries in
``queries``.  Nothing outside this folder imports it.
"""
