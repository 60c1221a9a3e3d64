"""Training-data operators: each module holds one operator, ``queries`` registers them.

Nothing else in the package imports this subpackage.
"""
