"""Operators for cleaning, de-duplicating, mixing and packaging training text.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries, ``oracles`` their SQL twins.
"""
