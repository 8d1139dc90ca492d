"""Operators for preparing training text and vectors.

Nothing else in the library imports this subpackage.  ``queries.py`` registers
one query per operator; every operator module also has a general interface.
"""
