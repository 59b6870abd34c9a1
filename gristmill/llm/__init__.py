"""Training-data operators: dedup, packing, mixing, scoring, search and the pipeline over them.

Nothing else in the library imports this subpackage.
"""
