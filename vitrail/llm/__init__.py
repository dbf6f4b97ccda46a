"""Training-data operators: tokenising, de-duplication, scoring, filtering.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
