"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage. ``queries`` holds the
registered queries, ``oracles`` their SQL where SQL can express them.
"""
