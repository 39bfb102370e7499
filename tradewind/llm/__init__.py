"""Training-data operators: ten large-scale corpus operations and their queries.

Nothing else in the library imports this subpackage.
"""
